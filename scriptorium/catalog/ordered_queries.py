"""Window functions, ordered folds and top-n: W1-W19, O1-O6."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog.join_queries import PAGE
from scriptorium.catalog.registry import query
from scriptorium.catalog.sqltext import crop, iou
from scriptorium.functions import boxes as B
from scriptorium.operators import sequences as Q
from scriptorium.operators.matching import match_boxes
from scriptorium.operators.ranking import number_by_row, top_n
from scriptorium.operators.rules import page_sequence_ok
from scriptorium.plans import evidence as E
from scriptorium.plans import sampling as P
from scriptorium.plans import structure as R
from scriptorium.plans.evaluation import marker_edges, match_markers, ordering_accuracy


@query("w1_best_line", """
    with l as (select paper_id, page_number, coalesce(nullif(block_number,0),y+1) b, coalesce(nullif(paragraph_number,0),1) p, coalesce(nullif(line_number,0),y+1) l,
        count(*) n, round(coalesce(avg(confidence),0e0)*least(1e0,count(*)/6e0),9) score, min(y) y0, min(word_index) first_word from fx_words group by all)
    select paper_id, page_number, n words_in_line, score from (select *, row_number() over (partition by paper_id, page_number order by score desc, y0, first_word) rn from l) where rn=1""")
def _(fx):
    lines = P.scored_lines(fx.words()).withColumn("printed_score", F.round("printed_score", 9))
    return P.best_line(lines, "printed_score").select(*PAGE, "words_in_line", "score")


@query("w2_control_words", """
    select paper_id, page_number, word_index, cast(rn as int) control_no from (
      select *, row_number() over (partition by paper_id, page_number order by confidence desc, y, x, word_index) rn from fx_words where confidence>=0.90e0 and width>=15 and height>=8)
    where rn<=2""")
def _(fx):
    return P.control_words(fx.words()).select(*PAGE, "word_index", "control_no")


@query("w3_sequence_confidence", """
    with c as (select paper_id, true_number, conf/100e0 confidence, row_number() over (partition by paper_id order by page_number, y, x)-1 no from fx_headings),
    s as (select *, true_number-lag(true_number) over w b, lead(true_number) over w-true_number a from c window w as (partition by paper_id order by no)),
    v as (select *, case b when 1 then 1e0 when 2 then 0.7e0 else 0.4e0 end sb, case a when 1 then 1e0 when 2 then 0.7e0 else 0.4e0 end sa from s),
    q as (select *, case when a is not null and b is not null then (sa+sb)/2e0 when b is not null then sb when a is not null then sa else 0.5e0 end seq from v)
    select paper_id, cast(no as int) candidate_no, seq sequence_confidence, round(least(1e0,0.85e0*confidence+0.15e0*seq),9) confidence from q""")
def _(fx):
    c = number_by_row(fx.headings(), ["paper_id"], "page_number", [F.col("y"), F.col("x")], "candidate_no")
    c = c.select("paper_id", "candidate_no", F.col("true_number").alias("test_number"), (F.col("conf") / 100.0).alias("confidence"))
    return Q.with_sequence_confidence(c).select("paper_id", "candidate_no", "sequence_confidence", F.round("confidence", 9).alias("confidence"))


def heading_markers(fx):
    m = fx.headings().withColumn("marker_y", F.col("y"))
    return number_by_row(m, ["paper_id"], "page_number", [F.col("marker_y")], "candidate_no").select(
        *PAGE, "candidate_no", F.col("true_number").alias("test_number"), "marker_y"
    )


@query("w4_region_cut", """
    with m as (select paper_id, page_number, true_number, y, lead(page_number) over w np, lead(y) over w ny from fx_headings window w as (partition by paper_id order by page_number, y)),
    n as (select paper_id, count(*) pages from fx_pages group by 1),
    s as (select m.*, cast(coalesce(np,pages) as int) last_page from m join n using (paper_id)),
    e as (select *, unnest(range(page_number,last_page+1)) p from s),
    r as (select e.paper_id, cast(p as int) page_number, true_number test_number, cast(case when p=e.page_number then y else 0 end as int) top, cast(case when p=np then ny else height end as int) bottom
      from e join fx_pages g on g.paper_id=e.paper_id and g.page_number=e.p)
    select paper_id, page_number, test_number, top y, bottom-top height from r where paper_id not in (select paper_id from r where bottom<=top)""")
def _(fx):
    regions, _flat = R.segment_regions(fx.pages(), heading_markers(fx))
    return regions.select(*PAGE, "test_number", "region.y", "region.height")


GUIDE_SQL = """
    o as (select *, y-lag(y) over (partition by paper_id order by y) d from fx_guides),
    g as (select *, sum(case when d>125 then 1 else 0 end) over (partition by paper_id order by y) group_no from o),
    groups as (select paper_id, cast(group_no as int) group_no, count(*) line_count, min(x) "left", max(x+width) "right", min(y) first_y, max(y) last_y from g group by paper_id, group_no)"""


@query("w5_guide_groups", f"with {GUIDE_SQL} select * from groups")
def _(fx):
    region = fx.guide_regions()
    gap = F.greatest(F.lit(45), F.floor(F.col("region.height") * 0.25).cast("int"))
    return Q.line_groups(fx.guides().join(region, E.TEST), E.TEST, gap).drop("page_number", "test_number")


GUIDE_BOX_SQL = GUIDE_SQL + """,
    boxed as (select paper_id, group_no, "left" hx, greatest(90,first_y-sp) hy, "right"-"left" hw, least(590,last_y+sp)-greatest(90,first_y-sp) hh
      from (select *, greatest(20,cast(floor((last_y-first_y)/greatest(1,line_count-1)) as int)) sp from groups where line_count>=2)),
    touching as (select b.paper_id, b.group_no, sum({inter}) filter (where evidence_type='printed') printed_area, list(evidence_no order by evidence_no) filter (where evidence_type='student_candidate') students
      from boxed b join (select paper_id, evidence_no, evidence_type, x px, y py, width pw, height ph from fx_region_evidence) e on b.paper_id=e.paper_id and {inter}>0 group by all),
    guide_candidates as (select b.*, coalesce(printed_area,0) printed_area, coalesce(students,[]) students from boxed b left join touching using (paper_id, group_no))"""


def _guide_box_sql():
    from scriptorium.catalog.sqltext import inter

    return GUIDE_BOX_SQL.replace("{inter}", inter("h", "p"))


@query("w6_guide_boxes", f"""with {_guide_box_sql()} select paper_id, cast(hx as int) x, cast(hy as int) y, cast(hw as int) width, cast(hh as int) height,
      case when len(students)>0 then 0.82e0 else 0.68e0 end confidence,
      concat_ws(',','writing_guides',case when printed_area/cast(hw*hh as double)<0.15e0 then 'low_printed_density' end, case when len(students)>0 then 'student_evidence_cluster' else 'blank_writing_space' end) signals,
      array_to_string(students,',') students from guide_candidates""")
def _(fx):
    c = E.guide_candidates(fx.guide_regions(), fx.guides(), fx.region_evidence())
    return c.select(
        "paper_id", "box.x", "box.y", "box.width", "box.height", "confidence", F.array_join("signals", ",").alias("signals"),
        F.array_join(F.col("source_indices").cast("array<string>"), ",").alias("students"),
    )


@query("w7_student_clusters", """
    select paper_id, evidence_no, greatest(0,x-18) x, greatest(90,y-18) y, least(1000,x+width+18)-greatest(0,x-18) width, least(590,y+height+18)-greatest(90,y-18) height, 0.78e0 confidence
    from fx_region_evidence where evidence_type='student_candidate'""")
def _(fx):
    return E.student_clusters(fx.guide_regions(), fx.region_evidence()).select(
        "paper_id", F.col("source_indices")[0].alias("evidence_no"), "box.x", "box.y", "box.width", "box.height", "confidence"
    )


MERGE_SQL = _guide_box_sql() + """,
    candidates as (select paper_id, hx x, hy y, hx+hw r, hy+hh b, group_no seq, students idx, case when len(students)>0 then 0.82e0 else 0.68e0 end c from guide_candidates
      union all select paper_id, greatest(0,x-18), greatest(90,y-18), least(1000,x+width+18), least(590,y+height+18), 1000000000+evidence_no, [evidence_no], 0.78e0
        from fx_region_evidence where evidence_type='student_candidate'),
    listed as (select paper_id, list(struct_pack(x:=x,y:=y,r:=r,b:=b,c:=c,idx:=idx) order by y,x,seq) items from candidates group by paper_id),
    folded as (select paper_id, list_reduce(list_transform(items, lambda q: [q]), lambda acc, n:
        case when least(least(1000,acc[len(acc)].r+12),n[1].r)>greatest(greatest(0,acc[len(acc)].x-12),n[1].x) and least(least(590,acc[len(acc)].b+12),n[1].b)>greatest(greatest(90,acc[len(acc)].y-12),n[1].y)
        then list_concat(acc[1:len(acc)-1],[struct_pack(x:=least(acc[len(acc)].x,n[1].x), y:=least(acc[len(acc)].y,n[1].y), r:=greatest(acc[len(acc)].r,n[1].r), b:=greatest(acc[len(acc)].b,n[1].b),
          c:=greatest(acc[len(acc)].c,n[1].c), idx:=list_sort(list_distinct(list_concat(acc[len(acc)].idx,n[1].idx))))])
        else list_concat(acc,n) end) merged from listed),
    merged as (select paper_id, unnest(merged) m, unnest(range(len(merged))) opened from folded)"""


@query("w8_merge_touching", f"with {MERGE_SQL} select paper_id, cast(m.x as int) x, cast(m.y as int) y, cast(m.r-m.x as int) width, cast(m.b-m.y as int) height, m.c confidence, array_to_string(m.idx,',') students from merged")
def _(fx):
    regions, evidence = fx.guide_regions(), fx.region_evidence()
    candidates = E.guide_candidates(regions, fx.guides(), evidence).unionByName(E.student_clusters(regions, evidence))
    return Q.merge_touching(candidates, E.TEST).select(
        "paper_id", "box.x", "box.y", "box.width", "box.height", "confidence", F.array_join(F.col("source_indices").cast("array<string>"), ",").alias("students")
    )


def chain_candidates(fx):
    """Candidates with noisy numbers, in position order."""
    noisy = F.when(F.col("conf") % 4 == 0, F.col("conf") % 16 + 1).otherwise(F.col("true_number")).cast("int")
    c = number_by_row(fx.headings(), ["paper_id"], "page_number", [F.col("y"), F.col("x"), F.col("k")], "candidate_no")
    return c.select("paper_id", "candidate_no", noisy.alias("test_number"), (F.col("conf") / 100.0).alias("confidence"))


def chain_sql(source: str) -> str:
    """Best chain per paper from ``source`` (paper_id, no, num, conf) by an ordered fold."""
    support = "(case n[1].num-q.num when 1 then 1e0 when 2 then 0.7e0 else 0.4e0 end)"
    return f"""
    items as (select paper_id, list([struct_pack(num:=num, score:=case when num=1 then conf+0.1e0 else conf end, chain:=[no])] order by no) items from {source} group by 1),
    walked as (select paper_id, list_reduce(items, lambda acc, n: list_concat(acc, list_transform(list_sort(list_concat(
        list_transform(list_filter(acc, lambda q: q.num<n[1].num), lambda q: struct_pack(neg:=-(q.score+n[1].score+0.25e0*{support}), chain:=list_append(q.chain,n[1].chain[1]))),
        [struct_pack(neg:=-n[1].score, chain:=n[1].chain)]))[1:1], lambda b: struct_pack(num:=n[1].num, score:=-b.neg, chain:=b.chain)))) acc from items),
    accepted as (select paper_id, unnest(list_sort(list_transform(acc, lambda q, i: struct_pack(neg:=-q.score, i:=i, chain:=q.chain)))[1].chain) no from walked)"""


CHAIN_CANDIDATES_SQL = """
    c as (select paper_id, page_number, cast(row_number() over (partition by paper_id order by page_number, y, x, k)-1 as int) no,
        cast(case when conf%4=0 then conf%16+1 else true_number end as int) num, conf/100e0 conf from fx_headings),
    e as (select * from c where num between 1 and 16 and conf>=0.10e0)"""


@query("w9_increasing_chain", f"with {CHAIN_CANDIDATES_SQL}, {chain_sql('e')} select paper_id, no candidate_no from accepted")
def _(fx):
    return Q.increasing_chain(chain_candidates(fx), R.EXPECTED, 0.10)


# Greedy matching as a fold over the ordered pairs of a sample.
MATCH_SQL = f"""
    pairs as (select h.sample_id, h.box_idx hi, p.box_idx pi, {iou('h.h', 'p.p')} iou from fx_numbered_boxes h join fx_numbered_boxes p on h.sample_id=p.sample_id),
    levels as (select unnest([0e0,0.25e0,0.5e0]) threshold),
    listed as (select sample_id, threshold, list([struct_pack(s:=iou,h:=hi,p:=pi)] order by -iou,hi,pi) items from pairs, levels where iou>0 and iou>=threshold group by all),
    folded as (select sample_id, threshold, list_reduce(items, lambda acc, n: case when len(list_filter(acc, lambda q: q.h=n[1].h or q.p=n[1].p))=0 then list_concat(acc,n) else acc end) m from listed),
    matches as (select sample_id, threshold, unnest(m) m from folded)"""


@query("w10_box_matches", f"with {MATCH_SQL} select sample_id, threshold, m.h human_idx, m.p predicted_idx, round(m.s,9) iou from matches")
def _(fx):
    m = match_boxes(fx.human_boxes(), fx.predicted_boxes(), ["sample_id"], [0.0, 0.25, 0.5])
    return m.withColumn("iou", F.round("iou", 9))


TRUTH_SQL = """
    t as (select paper_id, page_number, row_number() over (partition by paper_id order by page_number, y)-1 ti, true_number tn, y ty from fx_headings),
    d as (select paper_id, page_number, row_number() over (partition by paper_id order by page_number, dy, tn)-1 di, tn dn, dy from (
      select paper_id, page_number, case when conf%4=0 then cast(conf%16+1 as int) else true_number end tn, case when doc_id%4=0 then y+90 else y+doc_id%70 end dy from fx_headings)),
    edges as (select paper_id, ti, di, tn, dn, cast(abs(ty-dy) as double) dist from t join d using (paper_id, page_number) where abs(ty-dy)<=80),
    {name}_listed as (select paper_id, list([struct_pack(t:=ti,d:=di,tn:=tn,dn:=dn)] order by ti, dist, di) items from edges where {cond} group by 1),
    {name} as (select paper_id, unnest(list_reduce(items, lambda acc, n: case when len(list_filter(acc, lambda q: q.t=n[1].t or q.d=n[1].d))=0 then list_concat(acc,n) else acc end)) m from {name}_listed)"""


def structure_truth(fx):
    return number_by_row(fx.headings(), ["paper_id"], "page_number", [F.col("y")], "truth_idx").select(
        *PAGE, "truth_idx", F.col("true_number").alias("truth_number"), B.box("x", "y", F.lit(80), F.lit(25)).alias("truth_box")
    )


def structure_found(fx):
    h = fx.headings().withColumn("dy", F.when(F.col("doc_id") % 4 == 0, F.col("y") + 90).otherwise(F.col("y") + F.col("doc_id") % 70)).withColumn(
        "dn", F.when(F.col("conf") % 4 == 0, F.col("conf") % 16 + 1).otherwise(F.col("true_number")).cast("int")
    )
    return number_by_row(h, ["paper_id"], "page_number", [F.col("dy"), F.col("dn")], "detected_idx").select(
        *PAGE, "detected_idx", F.col("dn").alias("detected_number"), B.box("x", "dy", F.lit(80), F.lit(25)).alias("detected_box")
    )


@query("w11_truth_order_matches", "with " + TRUTH_SQL.format(name="spatial", cond="true") + " select paper_id, cast(m.t as int) truth_idx, cast(m.d as int) detected_idx from spatial")
def _(fx):
    return match_markers(marker_edges(structure_truth(fx), structure_found(fx), False))


_C12 = crop("hx", "hy", "hw", "hh")
NMS_SQL = f"""
    c as (select cast(sample_id%500 as bigint) page_id, sample_id*1000+box_idx no, {_C12['x']} x, {_C12['y']} y, {_C12['w']} w, {_C12['h']} h, cast((hx*7+hy) as int)%100/100e0 score from fx_numbered_boxes),
    listed as (select page_id, list([struct_pack(x:=x,y:=y,w:=w,h:=h,no:=no)] order by score desc, no) items from c group by page_id),
    folded as (select page_id, list_reduce(items, lambda acc, n: case when len(list_filter(acc, lambda k:
        greatest(0,least(k.x+k.w,n[1].x+n[1].w)-greatest(k.x,n[1].x))*greatest(0,least(k.y+k.h,n[1].y+n[1].h)-greatest(k.y,n[1].y))
        / cast(k.w*k.h+n[1].w*n[1].h-greatest(0,least(k.x+k.w,n[1].x+n[1].w)-greatest(k.x,n[1].x))*greatest(0,least(k.y+k.h,n[1].y+n[1].h)-greatest(k.y,n[1].y)) as double)>0.72e0))=0
      then list_concat(acc,n) else acc end) m from listed)
    select page_id, unnest(m).no proposal_no from folded"""


def crowded_proposals(fx):
    """Context crops of all boxes on 500 crowded pages."""
    score = (F.col("human_box.x") * 7 + F.col("human_box.y")) % 100 / 100.0
    return fx.boxes().select(
        (F.col("sample_id") % 500).alias("page_id"),
        (F.col("sample_id") * 1000 + F.col("box_idx")).alias("proposal_no"),
        B.context_crop("human_box", F.lit(1000), F.lit(1400)).alias("region"),
        score.alias("score"),
    )


@query("w12_overlap_suppression", "with " + NMS_SQL)
def _(fx):
    proposals = crowded_proposals(fx).withColumn("category", F.lit("any"))
    return P.drop_overlapping(proposals, keys=["page_id"], tie=("proposal_no",)).select("page_id", "proposal_no")


def risk_proposals(fx):
    from scriptorium.catalog.function_queries import mark_rows

    return mark_rows(fx).where(F.size("signals") > 0).select(
        *PAGE, F.col("component_no").alias("proposal_no"), "component",
        B.bounded_crop("component", F.lit(1000), F.lit(1400)).alias("region"), "category", "signals", F.col("risk").alias("score"),
    )


_C13 = crop("x", "y", "width", "height", True)


def _same_evidence_sql(k: str, n: str, limit: str) -> str:
    i = f"(greatest(0,least({k}.x+{k}.w,{n}.x+{n}.w)-greatest({k}.x,{n}.x))*greatest(0,least({k}.y+{k}.h,{n}.y+{n}.h)-greatest({k}.y,{n}.y)))"
    return (
        f"({i}/cast({k}.w*{k}.h+{n}.w*{n}.h-{i} as double)>{limit} or {i}/cast(least({k}.w*{k}.h,{n}.w*{n}.h) as double)>0.84e0 "
        f"or (sqrt(pow({k}.cx-{n}.cx,2)+pow({k}.cy-{n}.cy,2))<0.28e0*least({n}.w,{n}.h) and list_has_any({k}.sig,{n}.sig)))"
    )


def _risk_sql() -> str:
    from scriptorium.catalog.function_queries import MARK_SQL

    return MARK_SQL + f""",
    r as (select paper_id, page_number, component_no no, category, sorted_signals sig, n_signals, x+width/2e0 cx, y+height/2e0 cy, {_C13['x']} rx, {_C13['y']} ry, {_C13['w']} rw, {_C13['h']} rh,
        least(1e0, case category when 'mixed_teacher_context_risk' then 0.22e0 when 'tick_cross_correction_risk' then 0.18e0 when 'margin_score_risk' then 0.16e0
          when 'chromatic_ink_risk' then 0.14e0 else 0.08e0 end + least(0.35e0,n_signals*0.055e0) + 0.12e0*chroma + 0.10e0*margin_prox + 0.08e0*least(1e0,angled/4e0)) score from g where n_signals>0)"""


@query("w13_evidence_suppression", f"""with {_risk_sql()},
    listed as (select paper_id, page_number, list([struct_pack(no:=no,x:=rx,y:=ry,w:=rw,h:=rh,cx:=cx,cy:=cy,sig:=sig,category:=category,score:=score)] order by -score, -n_signals, ry, rx, category, no) items from r group by all),
    folded as (select paper_id, page_number, list_reduce(items, lambda acc, n: case when len(list_filter(acc, lambda k: {_same_evidence_sql('k', 'n[1]', '0.52e0')}))=0 then list_concat(acc,n) else acc end) m from listed),
    kept as (select paper_id, page_number, unnest(m) m from folded)
    select paper_id, page_number, m.no proposal_no, m.category category, round(m.score,9) score from kept""")
def _(fx):
    return P.drop_same_evidence(risk_proposals(fx)).select(*PAGE, "proposal_no", "category", F.round("score", 9).alias("score"))


def expansion_pool(fx):
    categories = F.array(*[F.lit(c) for c in P.EXPANSION_CATEGORIES])
    score = (F.col("human_box.x") * 7 + F.col("human_box.y")) % 100 / 100.0
    return fx.boxes().select(
        (F.col("sample_id") % 20).alias("dataset_id"),
        F.concat(F.lit("paper-"), (F.col("sample_id") % 340 / 20).cast("int").cast("string")).alias("paper_alias"),
        (F.col("sample_id") % 7 + 1).cast("int").alias("page_number"),
        (F.col("sample_id") * 1000 + F.col("box_idx")).alias("proposal_no"),
        F.element_at(categories, (F.col("box_idx") % 5 + 1).cast("int")).alias("category"),
        B.context_crop("human_box", F.lit(1000), F.lit(1400)).alias("region"),
        score.alias("score"),
    )


QUOTAS = {"printed_candidate": 10, "student_candidate": 12, "teacher_mark_risk_candidate": 12, "mixed_uncertain_candidate": 6, "blank_answer_candidate": 8}


_QUOTA_SQL = "case n[1].cat " + " ".join(f"when {i + 1} then {q}" for i, q in enumerate(QUOTAS.values())) + " end"
_C14 = crop("hx", "hy", "hw", "hh")
_IOU14 = (
    "(greatest(0,least(k.x+k.w,n[1].x+n[1].w)-greatest(k.x,n[1].x))*greatest(0,least(k.y+k.h,n[1].y+n[1].h)-greatest(k.y,n[1].y)))"
)


W14_SQL = f"""
    p as (select sample_id%20 dataset_id, 'paper-'||cast(floor(sample_id%340/20e0) as int) alias, cast(sample_id%7+1 as int) page, sample_id*1000+box_idx no, cast(box_idx%5+1 as int) cat,
        {_C14['x']} x, {_C14['y']} y, {_C14['w']} w, {_C14['h']} h, (hx*7+hy)%100/100e0 score from fx_numbered_boxes),
    listed as (select dataset_id, list([struct_pack(no:=no,alias:=alias,page:=page,cat:=cat,x:=x,y:=y,w:=w,h:=h,score:=score)] order by cat, -score, alias, page, y, x, no) items from p group by 1),
    folded as (select dataset_id, list_reduce(items, lambda acc, n: case when len(list_filter(acc, lambda k: k.cat=n[1].cat))<({_QUOTA_SQL}) and len(list_filter(acc, lambda k: k.alias=n[1].alias))<5
        and len(list_filter(acc, lambda k: k.alias=n[1].alias and k.page=n[1].page and {_IOU14}/cast(k.w*k.h+n[1].w*n[1].h-{_IOU14} as double)>0.55e0))=0 then list_concat(acc,n) else acc end) m from listed)"""


@query("w14_balanced_selection", f"""with {W14_SQL}
    select dataset_id, m.no proposal_no, ['printed_candidate','student_candidate','teacher_mark_risk_candidate','mixed_uncertain_candidate','blank_answer_candidate'][m.cat] category, cast(i as int) pick_no
    from (select dataset_id, unnest(m) m, generate_subscripts(m,1) i from folded)""")
def _(fx):
    return P.select_expansion(expansion_pool(fx), QUOTAS).select("dataset_id", "proposal_no", "category", "pick_no")


_TARGETS = list(P.MARK_RISK_TARGETS.items())
_RANK15 = "case category " + " ".join(f"when '{c}' then {i}" for i, (c, _q) in enumerate(_TARGETS)) + " end"
_TARGET15 = "case n[1].cat " + " ".join(f"when '{c}' then {q}" for c, q in _TARGETS) + " end"


@query("w15_quota_then_fill", f"""with {_risk_sql()},
    p as (select paper_id%5 dataset_id, 'paper-'||paper_id alias, page_number page, paper_id*100000+page_number*10000+no pno, * exclude (no) from r),
    t as (select *, 0 phase, {_RANK15} turn from p union all select *, 1, 0 from p),
    listed as (select dataset_id, list([struct_pack(no:=pno,alias:=alias,page:=page,cat:=category,phase:=phase,x:=rx,y:=ry,w:=rw,h:=rh,cx:=cx,cy:=cy,sig:=sig)] order by phase, turn, -score, -n_signals, alias, page, ry, rx, pno) items from t group by 1),
    folded as (select dataset_id, list_reduce(items, lambda acc, n: case when
        (case when n[1].phase=0 then len(list_filter(acc, lambda k: k.cat=n[1].cat))<({_TARGET15}) else len(acc)<48 end)
        and len(list_filter(acc, lambda k: k.alias=n[1].alias))<3 and len(list_filter(acc, lambda k: k.alias=n[1].alias and k.page=n[1].page))<2
        and len(list_filter(acc, lambda k: k.alias=n[1].alias and k.page=n[1].page and {_same_evidence_sql('k', 'n[1]', '0.42e0')}))=0 then list_concat(acc,n) else acc end) m from listed)
    select dataset_id, m.no proposal_no, m.cat category, cast(i as int) pick_no from (select dataset_id, unnest(m[1:48]) m, generate_subscripts(m[1:48],1) i from folded)""")
def _(fx):
    pool = risk_proposals(fx).select(
        (F.col("paper_id") % 5).alias("dataset_id"), F.concat(F.lit("paper-"), F.col("paper_id").cast("string")).alias("paper_alias"), "page_number",
        (F.col("paper_id") * 100000 + F.col("page_number") * 10000 + F.col("proposal_no")).alias("proposal_no"), "component", "region", "category", "signals", "score",
    )
    return P.select_mark_risk(pool).select("dataset_id", "proposal_no", "category", "pick_no")


@query("w16_sample_ids", """
    select lang, doc_id, printf('evidence_v2_%03d', row_number() over (partition by lang order by source, n_chars, doc_id)) sample_id from documents""")
def _(fx):
    from scriptorium.functions.ids import numbered

    d = fx.table("documents").select("lang", "doc_id", "source", "n_chars")
    r = number_by_row(d, ["lang"], "source", [F.col("n_chars"), F.col("doc_id")], "rank", start=1)
    return r.select("lang", "doc_id", numbered("evidence_v2", F.col("rank")).alias("sample_id"))


@query("w17_ordering_accuracy", "with " + TRUTH_SQL.format(name="spatial", cond="true") + """,
    s as (select ta.paper_id, a, b from (select paper_id, list(tn order by ti) a from t group by 1) ta join (select paper_id, list(dn order by di) b from d group by 1) da on ta.paper_id=da.paper_id),
    l as (select paper_id, a, b, list_reduce(list_prepend(list_transform(range(0,len(b)+1), lambda j: 0::bigint), list_transform(a, lambda q: [q::bigint])), lambda prev, q: list_transform([list_transform(range(1,len(prev)+1), lambda j: case when j=1 then 0 else greatest(prev[j], case when b[j-1]=q[1] then prev[j-1]+1 else 0 end) end)], lambda t0: list_transform([list_transform(range(1,len(t0)+1), lambda j: greatest(t0[j], case when j>1 then t0[j-1] else 0 end))], lambda t1: list_transform([list_transform(range(1,len(t1)+1), lambda j: greatest(t1[j], case when j>2 then t1[j-2] else 0 end))], lambda t2: list_transform([list_transform(range(1,len(t2)+1), lambda j: greatest(t2[j], case when j>4 then t2[j-4] else 0 end))], lambda t3: list_transform([list_transform(range(1,len(t3)+1), lambda j: greatest(t3[j], case when j>8 then t3[j-8] else 0 end))], lambda t4: list_transform([list_transform(range(1,len(t4)+1), lambda j: greatest(t4[j], case when j>16 then t4[j-16] else 0 end))], lambda t5: t5)[1])[1])[1])[1])[1])[1])[len(b)+1] lcs from s)
    select paper_id, cast(lcs as int) lcs, round(lcs/cast(greatest(len(a),len(b)) as double),9) accuracy from l""")
def _(fx):
    def listed(df, idx, number, name):
        return df.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(idx, number))), lambda v: v[number]).alias(name))

    t = listed(structure_truth(fx), "truth_idx", "truth_number", "a")
    d = listed(structure_found(fx), "detected_idx", "detected_number", "b")
    return t.join(d, "paper_id").select(
        "paper_id", Q.lcs_length(F.col("a"), F.col("b")).alias("lcs"), F.round(ordering_accuracy(F.col("a"), F.col("b")), 9).alias("accuracy")
    )


@query("w18_page_order", """
    select paper_id, min(page_number)=1 and max(page_number)=count(*) and count(distinct page_number)=count(*) pages_ok, count(*) page_count from fx_headings group by 1
    union all select paper_id, min(page_number)=1 and max(page_number)=count(*) and count(distinct page_number)=count(*), count(*) from fx_pages group by 1""")
def _(fx):
    return page_sequence_ok(fx.headings(), ["paper_id"], "page_number").unionByName(page_sequence_ok(fx.pages(), ["paper_id"], "page_number"))


@query("w19_source_selection", """
    with s as (select p_partkey, p_brand, sha256(p_name) sha, p_size, p_partkey%17=0 pinned from part)
    select p_brand, p_partkey, concat('paper-', chr(cast(96+rn as int))) alias from (
      select *, row_number() over (partition by p_brand order by pinned desc, sha, p_size, p_partkey) rn from s) where rn<=12""")
def _(fx):
    s = fx.table("part").select("p_partkey", "p_brand", F.sha2("p_name", 256).alias("sha"), "p_size", (F.col("p_partkey") % 17 == 0).alias("pinned"))
    picked = top_n(s, ["p_brand"], [F.col("pinned").desc(), F.col("sha"), F.col("p_size"), F.col("p_partkey")], 12)
    return picked.select("p_brand", "p_partkey", F.concat(F.lit("paper-"), F.chr(F.lit(96) + F.col("rank"))).alias("alias"))


# Orders -----------------------------------------------------------------------------------------


@query("o1_candidate_order", "select doc_id, k, cast(row_number() over (partition by paper_id order by page_number, y, x, true_number)-1 as int) candidate_no from fx_headings")
def _(fx):
    return number_by_row(fx.headings(), ["paper_id"], "page_number", [F.col("y"), F.col("x"), F.col("true_number")], "candidate_no").select("doc_id", "k", "candidate_no")


@query("o2_evidence_order", """
    select paper_id, evidence_no, x, y, cast(row_number() over (partition by paper_id order by y, x, evidence_type, evidence_no)-1 as int) reading_no from fx_region_evidence""")
def _(fx):
    e = fx.region_evidence().select("paper_id", "evidence_no", "box.x", "box.y", "evidence_type")
    return number_by_row(e, ["paper_id"], "y", [F.col("x"), F.col("evidence_type"), F.col("evidence_no")], "reading_no").drop("evidence_type")


@query("o3_component_order", """
    select paper_id, page_number, component_no, cast(row_number() over (partition by paper_id, page_number order by y, x, width, height, component_no)-1 as int) position from fx_components""")
def _(fx):
    c = fx.components().select(*PAGE, "component_no", "component.x", "component.y", "component.width", "component.height")
    return number_by_row(c, PAGE, "y", [F.col("x"), F.col("width"), F.col("height"), F.col("component_no")], "position").select(*PAGE, "component_no", "position")


@query("o4_proposal_order", """
    with c as (select *, cast(sample_id%500 as bigint) page_id from fx_numbered_boxes)
    select page_id, sample_id, box_idx, cast(row_number() over (partition by page_id order by hy, hx, hw desc, sample_id, box_idx)-1 as int) position from c""")
def _(fx):
    c = fx.boxes().select(
        (F.col("sample_id") % 500).alias("page_id"), "sample_id", "box_idx", F.col("human_box.y").alias("y"), F.col("human_box.x").alias("x"), F.col("human_box.width").alias("w")
    )
    return number_by_row(c, ["page_id"], "y", [F.col("x"), F.col("w").desc(), F.col("sample_id"), F.col("box_idx")], "position").select("page_id", "sample_id", "box_idx", "position")


@query("o5_quota_limit", "select l_returnflag, l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber) rn from lineitem) where rn<=25")
def _(fx):
    rows = top_n(fx.table("lineitem"), ["l_returnflag"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 25)
    return rows.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("o6_first_n", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 40")
def _(fx):
    return fx.table("documents").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(40)


