"""Joins J1-J15 and set operations U1-U5 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog.registry import query
from scriptorium.catalog.sqltext import inter, iou, smaller
from scriptorium.functions import boxes as B
from scriptorium.operators import joins as J
from scriptorium.operators.ranking import number_by_row
from scriptorium.plans import evidence as E
from scriptorium.plans import sampling as P
from scriptorium.plans.labels import current_labels, validated_saves, with_record
from scriptorium.sources.words import extract_once

PAGE = ["paper_id", "page_number"]

# Two regions per page, cut at y=700.
REGIONS_SQL = """
    regions as (select paper_id, page_number, cast(2*page_number-1 as int) test_number, 0 rx, 0 ry, 1000 rw, 700 rh from fx_pages
      union all select paper_id, page_number, cast(2*page_number as int), 0, 700, 1000, 700 from fx_pages)"""


def half_page_regions(fx):
    halves = F.explode(F.array(F.struct(F.lit(1).alias("d"), F.lit(0).alias("top")), F.struct(F.lit(0).alias("d"), F.lit(700).alias("top"))))
    return fx.pages().select("paper_id", "page_number", halves.alias("h")).select(
        "paper_id", "page_number", (2 * F.col("page_number") - F.col("h.d")).alias("test_number"),
        B.box(F.lit(0), F.col("h.top"), F.lit(1000), F.lit(700)).alias("region"),
    )


@query("j1_page_result_match", """
    with r as (select doc_id, case when doc_id%9=0 then source||'x' else source end source from documents where text<>'' union all select -1-page_id, url from pages)
    select coalesce(d.doc_id, r.doc_id) doc_id, case when d.doc_id is null then 'unexpected_result' when r.doc_id is null then 'missing_result'
      when d.source<>r.source then 'source_mismatch' else 'ok' end status from documents d full outer join r on d.doc_id=r.doc_id""")
def _(fx):
    d = fx.table("documents")
    r = (
        d.where("text <> ''")
        .select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat("source", F.lit("x"))).otherwise(F.col("source")).alias("source"))
        .union(fx.table("pages").select(-1 - F.col("page_id"), "url"))
    )
    return J.match_results(d, r, ["doc_id"], "source")


@query("j2_region_words", f"""
    with {REGIONS_SQL},
    w as (select paper_id, page_number, word_index, x wx, y wy, width ww, height wh from fx_words)
    select paper_id, page_number, test_number, word_index, greatest(wx,rx) x, greatest(wy,ry) y, least(wx+ww,rx+rw)-greatest(wx,rx) width, least(wy+wh,ry+rh)-greatest(wy,ry) height
    from w join regions using (paper_id, page_number) where {inter('w','r')}>0 and {smaller('w','r')}>=0.60e0""")
def _(fx):
    return E.words_in_regions(fx.words(), half_page_regions(fx)).select(
        "paper_id", "page_number", "test_number", "word_index", "box.x", "box.y", "box.width", "box.height"
    )


@query("j3_uncovered_components", f"""
    with c as (select paper_id, page_number, component_no, x cx, y cy, width cw, height ch from fx_components),
    w as (select paper_id, page_number, x wx, y wy, width ww, height wh from fx_words)
    select paper_id, page_number, component_no from c where not exists (select 1 from w where w.paper_id=c.paper_id and w.page_number=c.page_number
      and {inter('c','w')}>0 and {smaller('c','w')}>=0.50e0)""")
def _(fx):
    components = fx.components().select(*PAGE, F.lit(1).alias("test_number"), "component_no", F.col("component").alias("box"))
    words = fx.words().select(*PAGE, F.lit(1).alias("test_number"), B.box("x", "y", "width", "height").alias("box"))
    return E.uncovered_components(components, words).select(*PAGE, "component_no")


@query("j4_visual_lines", """
    with t as (select distinct paper_id, page_number, y+height/2e0 cy, height h from fx_words where block_number is null or paragraph_number is null or line_number is null),
    w as (select paper_id, page_number, word_index, y+height/2e0 wy, height wh from fx_words)
    select paper_id, page_number, cy, h, count(*) members, cast(sum(word_index) as bigint) checksum from t join w using (paper_id, page_number)
    where abs(wy-cy)<=greatest(h,wh)*0.6e0 group by all""")
def _(fx):
    _, members = E.same_line_members(fx.words())
    part = F.split("line_id", ":")
    h = part[2].cast("int")
    return (
        members.where(F.col("line_id").startswith("c:"))
        .withColumn("h", h).withColumn("cy", part[1].cast("double") / 2)
        .groupBy(*PAGE, "cy", "h").agg(F.count(F.lit(1)).alias("members"), F.sum("word_index").alias("checksum"))
    )


@query("j5_preceding_marker", """
    with w as (select paper_id, page_number, word_index, y from fx_body),
    m as (select paper_id, page_number, y my, min(struct_pack(x:=x,n:=true_number)) f from fx_headings group by all)
    select paper_id, page_number, word_index, max(struct_pack(y:=my,n:=f.n)).n nearest_test
    from w left join m on w.paper_id=m.paper_id and w.page_number=m.page_number and my<=w.y group by w.paper_id, w.page_number, word_index"""
    .replace("select paper_id, page_number, word_index, max", "select w.paper_id, w.page_number, word_index, max"))
def _(fx):
    markers = fx.headings().select(*PAGE, F.col("x").alias("marker_x"), F.col("y").alias("marker_y"), F.col("true_number").alias("test_number"))
    return J.preceding_marker(fx.body().select(*PAGE, "word_index", "y"), markers, PAGE, F.col("y")).drop("y")


@query("j6_mixed_windows", """
    with l as (select paper_id, page_number, coalesce(nullif(block_number,0),y+1) b, coalesce(nullif(paragraph_number,0),1) p, coalesce(nullif(line_number,0),y+1) l,
        min(x) x0, min(y) y0, max(x+width) x1, max(y+height) y1, min(word_index) first_word from fx_words group by all),
    c as (select paper_id, page_number, component_no, x, y, width, height, case when x<1000*0.18e0 or x+width>1000*0.82e0 then 1e0 else 0.55e0 end iso from fx_components),
    j as (select l.*, c.x cx, c.y cy, c.width cw, c.height ch, least(1e0,0.5e0+iso/2) score,
        row_number() over (partition by paper_id, page_number order by iso desc, y0, first_word, component_no) rn
      from l join c using (paper_id, page_number) where abs((y0+(y1-y0)/2e0)-(c.y+c.height/2e0))<=greatest(120,(y1-y0)*3))
    select paper_id, page_number, score, least(x0,cx) x, least(y0,cy) y, greatest(x1,cx+cw)-least(x0,cx) width, greatest(y1,cy+ch)-least(y0,cy) height from j where rn=1""")
def _(fx):
    return P.best_mixed_window(P.scored_lines(fx.words()), isolated(fx)).select(*PAGE, "score", "box.x", "box.y", "box.width", "box.height")


def isolated(fx):
    edge = (F.col("component.x") < 1000 * F.lit(0.18)) | (B.right("component") > 1000 * F.lit(0.82))
    return fx.components().select(
        *PAGE, "component_no", F.col("component").alias("box"), F.when(edge, 1.0).otherwise(0.55).alias("isolation")
    )


@query("j7_word_proximity", """
    with c as (select paper_id, page_number, component_no, x+width/2e0 px, y+height/2e0 py from fx_components),
    w as (select paper_id, page_number, confidence, x+width/2e0 wx, y+height/2e0 wy from fx_words),
    d as (select c.paper_id, c.page_number, component_no, confidence, sqrt((px-wx)*(px-wx)+(py-wy)*(py-wy)) d from c left join w on c.paper_id=w.paper_id and c.page_number=w.page_number)
    select paper_id, page_number, component_no, round(greatest(0e0,1-coalesce(min(d),500e0)/500e0),6) ocr_proximity, cast(count(*) filter (where d<=180) as int) nearby_words,
      coalesce(bool_or(confidence>=0.78e0) filter (where d<=180), false) confident_nearby from d group by all""")
def _(fx):
    key = [*PAGE, "component_no"]
    return P.word_proximity(fx.components(), fx.words(), key).withColumn("ocr_proximity", F.round("ocr_proximity", 6))


@query("j8_guide_overlap", f"""
    with g as (select sample_id, box_idx, hx, hy, hw, hh from fx_numbered_boxes),
    e as (select paper_id sample_id, evidence_no, evidence_type, x px, y py, width pw, height ph from fx_region_evidence where evidence_type<>'unknown')
    select sample_id, box_idx, cast(coalesce(sum({inter('h','p')}) filter (where evidence_type='printed'),0) as bigint) printed_area,
      coalesce(string_agg(cast(evidence_no as varchar), ',' order by evidence_no) filter (where evidence_type='student_candidate'),'') students
    from g join e using (sample_id) where {inter('h','p')}>0 group by all""")
def _(fx):
    evidence = fx.region_evidence().where("evidence_type <> 'unknown'").select(F.col("paper_id").alias("sample_id"), "evidence_no", "evidence_type", "box")
    pairs = J.overlap_pairs(fx.boxes().select("sample_id", "box_idx", "human_box"), evidence, ["sample_id"], "human_box", "box")
    students = F.array_sort(F.collect_list(F.when(F.col("evidence_type") == "student_candidate", F.col("evidence_no"))))
    return pairs.groupBy("sample_id", "box_idx").agg(
        F.coalesce(F.sum(F.when(F.col("evidence_type") == "printed", B.intersection_area("human_box", "box"))), F.lit(0)).cast("long").alias("printed_area"),
        F.array_join(students.cast("array<string>"), ",").alias("students"),
    )


@query("j9_overlapping_pairs", f"""
    select h.sample_id, count(*) pairs, count(*) filter (where {iou('h.h','p.p')}>=0.5e0) pairs_at_50, round(sum({iou('h.h','p.p')}),6) total_iou
    from fx_numbered_boxes h join fx_numbered_boxes p on h.sample_id=p.sample_id where {inter('h.h','p.p')}>0 group by 1""")
def _(fx):
    pairs = J.overlap_pairs(fx.human_boxes(), fx.predicted_boxes(), ["sample_id"], "human_box", "predicted_box").withColumn("iou", B.iou("human_box", "predicted_box"))
    return pairs.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("iou") >= 0.5).alias("pairs_at_50"), F.round(F.sum("iou"), 6).alias("total_iou")
    )


@query("j10_marker_band", """
    with t as (select paper_id, page_number, true_number, y ty from fx_headings),
    d as (select paper_id, page_number, true_number dn, case when doc_id%4=0 then y+90 else y+doc_id%70 end dy from fx_headings)
    select paper_id, page_number, true_number truth_number, dn detected_number, cast(abs(ty-dy) as double) distance from t join d using (paper_id, page_number)
    where abs(ty-dy)<=greatest(80,25*3)""")
def _(fx):
    from scriptorium.plans.evaluation import marker_edges

    shifted = F.when(F.col("doc_id") % 4 == 0, F.col("y") + 90).otherwise(F.col("y") + F.col("doc_id") % 70)
    truth = fx.headings().select(*PAGE, F.col("true_number").alias("truth_idx"), F.col("true_number").alias("truth_number"), B.box("x", "y", F.lit(80), F.lit(25)).alias("truth_box"))
    found = fx.headings().select(*PAGE, F.col("true_number").alias("detected_idx"), F.col("true_number").alias("detected_number"), B.box("x", shifted, F.lit(80), F.lit(25)).alias("detected_box"))
    return marker_edges(truth, found, False).select(*PAGE, "truth_number", "detected_number", "distance")


@query("j11_id_coverage", """
    select doc_id, 'missing' problem from documents where doc_id not in (select doc_id from labels)
    union all select doc_id*1000000+1, 'unexpected' from labels where quality=0""")
def _(fx):
    expected = fx.table("documents").select("doc_id")
    actual = fx.table("labels").select("doc_id").union(fx.table("labels").where("quality = 0").select(F.col("doc_id") * 1000000 + 1))
    return J.coverage(expected, actual, "doc_id")


@query("j12_valid_approvals", """
    with f as (select r.sample_id, sha256(record) fp from fx_records r join fx_current c on r.event_id=c.event_id),
    a as (select sample_id, sha256(record) fp, row_number() over (partition by sample_id order by event_id) rn from fx_records)
    select f.sample_id, f.fp fingerprint from f join a on f.sample_id=a.sample_id and f.fp=a.fp and (a.rn=1 or cast(right(a.sample_id,1) as int)%2=0) group by all""")
def _(fx):
    from scriptorium.plans.labels import still_valid

    valid = valid_saves(fx)
    current = with_record(current_labels(valid, ["ts", "event_id"]))
    log = with_record(valid)
    first = log.groupBy("sample_id").agg(F.min_by("fingerprint", "event_id").alias("approved_fingerprint"))
    even = log.where(F.substring("sample_id", -1, 1).cast("int") % 2 == 0).select("sample_id", F.col("fingerprint").alias("approved_fingerprint"))
    return still_valid(current, first.union(even)).select("sample_id", "fingerprint")


def valid_saves(fx):
    return validated_saves(fx.saves(), fx.label_samples()).where("reject_reason is null").drop("reject_reason")


@query("j13_inventory_changes", """
    with a as (select doc_id, sha256(text) h from documents where doc_id%10<>0),
    b as (select doc_id, sha256(case when doc_id%7=0 then text||'!' else text end) h from documents where doc_id%10<>1)
    select coalesce(a.doc_id,b.doc_id) doc_id, case when a.doc_id is null then 'added' when b.doc_id is null then 'removed' when a.h=b.h then 'same' else 'changed' end status
    from a full outer join b on a.doc_id=b.doc_id""")
def _(fx):
    d = fx.table("documents")
    before = d.where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    after = d.where("doc_id % 10 <> 1").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return J.status_compare(before, after, ["doc_id"], "h").select("doc_id", "status")


@query("j14_sample_lookup", "select l.doc_id, d.lang, d.source, l.quality, l.toxic from labels l join documents d on l.doc_id=d.doc_id")
def _(fx):
    return fx.table("labels").join(fx.table("documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source", "quality", "toxic")


@query("j15_shared_page_result", """
    select l_orderkey, l_linenumber, l_suppkey, p_name, cast(length(p_name) as int) units from lineitem join part on l_partkey=p_partkey""")
def _(fx):
    def run(pages):
        return pages.join(fx.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").withColumn("units", F.length("p_name"))

    return extract_once(fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), ["l_partkey"], run).where("p_name is not null").drop("l_partkey")


# Set operations -------------------------------------------------------------------------------


@query("u1_missing_numbers", """
    select p.paper_id, n test_number from (select distinct paper_id from fx_pages) p, (select unnest(range(1,17))::int n) e
    where not exists (select 1 from fx_headings h where h.paper_id=p.paper_id and h.true_number=n and h.kw<>'zzzz')""")
def _(fx):
    from scriptorium.plans.structure import missing_numbers

    # A heading whose word cannot be read marks nothing.
    return missing_numbers(fx.pages(), fx.headings().where("kw <> 'zzzz'").select("paper_id", F.col("true_number").alias("test_number")))


@query("u2_rejected_by_identity", """
    with c as (select paper_id, true_number, row_number() over (partition by paper_id order by page_number, y, x, k)-1 no, conf from fx_headings)
    select paper_id, cast(no as int) candidate_no, true_number from c where not (conf>=50 and no%2=0)""")
def _(fx):
    c = number_by_row(fx.headings(), ["paper_id"], "page_number", [F.col("y"), F.col("x"), F.col("k")], "candidate_no")
    chosen = c.where("conf >= 50 and candidate_no % 2 = 0")
    return c.join(chosen.select("paper_id", "candidate_no"), ["paper_id", "candidate_no"], "left_anti").select("paper_id", "candidate_no", "true_number")


@query("u3_duplicate_union", """
    select paper_id, cast(conf%16+1 as int) test_number from fx_headings group by all having count(*)>1
    union select paper_id, cast(conf%5+1 as int) from fx_headings where conf>=60 group by all having count(*)>1""")
def _(fx):
    from scriptorium.plans.structure import duplicate_numbers

    h = fx.headings()
    a = duplicate_numbers(h.select("paper_id", (F.col("conf") % 16 + 1).alias("test_number")))
    b = duplicate_numbers(h.where("conf >= 60").select("paper_id", (F.col("conf") % 5 + 1).alias("test_number")))
    return a.select("paper_id", "test_number").union(b.select("paper_id", "test_number")).distinct()


@query("u4_set_equality", """
    select (select count(*) from (select doc_id from documents except select doc_id from labels)) missing,
      (select count(*) from (select doc_id from labels except select doc_id from documents)) unexpected""")
def _(fx):
    return J.coverage(fx.table("documents").select("doc_id"), fx.table("labels").select("doc_id"), "doc_id").agg(
        F.count_if(F.col("problem") == "missing").alias("missing"), F.count_if(F.col("problem") == "unexpected").alias("unexpected")
    )


@query("u5_evidence_union", """
    select source, paper_id, page_number, count(*) n, cast(sum(width) as bigint) width from (select 'word' source, paper_id, page_number, width from fx_words
      union all select 'component', paper_id, page_number, width from fx_components) group by all""")
def _(fx):
    words = fx.words().select(F.lit("word").alias("source"), *PAGE, "width")
    parts = fx.components().select(F.lit("component").alias("source"), *PAGE, F.col("component.width").alias("width"))
    return words.unionByName(parts).groupBy("source", *PAGE).agg(F.count(F.lit(1)).alias("n"), F.sum("width").alias("width"))
