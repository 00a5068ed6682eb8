"""End-to-end operators E1-E14 and E21 over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from scriptorium.catalog import function_queries as FQ
from scriptorium.catalog.aggregate_queries import _KEYED, _ROWS, A19_SQL, LINE_SQL, structure_rows, typed_boxes
from scriptorium.catalog.join_queries import PAGE, REGIONS_SQL, half_page_regions, isolated
from scriptorium.catalog.ordered_queries import MERGE_SQL, QUOTAS, W14_SQL, chain_sql, expansion_pool
from scriptorium.catalog.registry import query
from scriptorium.catalog.sqltext import crop, inter, smaller
from scriptorium.functions import boxes as B
from scriptorium.plans import evaluation as V
from scriptorium.plans import evidence as E
from scriptorium.plans import sampling as P
from scriptorium.plans import structure as R

_AN = "[\\p{L}\\p{N}]"
CANDIDATE_SQL = f"""{_KEYED},
    o as (select *, row_number() over (partition by paper_id, page_number, kb, kp, kl order by word_number nulls last, x, word_index) pos,
        count(*) over (partition by paper_id, page_number, kb, kp, kl) len from k),
    li as (select paper_id, page_number, kb, kp, kl, any_value(len) len, list(struct_pack(pos:=pos,idx:=word_index,t:=text,c:=confidence,x:=x,y:=y,w:=width,h:=height) order by pos) head from o where pos<=5 group by all),
    st as (select *, case when regexp_matches(head[1].t,'{_AN}') then 1 when regexp_matches(coalesce(head[2].t,''),'{_AN}') then 2 end s from li),
    fi as (select *, head[s] a, list_filter(head, lambda q: q.pos>s and q.pos<=s+3 and regexp_matches(q.t,'{_AN}'))[1] b from st where s is not null),
    cl as (select *, regexp_replace(a.t,'[^\\p{{L}}\\p{{N}}]','','g') clean, regexp_replace(coalesce(b.t,''),'[^\\p{{L}}\\p{{N}}]','','g') clean2 from fi),
    co as (select *, lower(regexp_extract(clean,'^(\\p{{L}}+)([^\\p{{L}}].*)$',1)) ckey, regexp_extract(clean,'^(\\p{{L}}+)([^\\p{{L}}].*)$',2) cnum from cl),
    ke as (select *, case when ckey<>'' then ckey else regexp_replace(lower(a.t),'[^\\p{{L}}]','','g') end key, case when ckey<>'' then cnum when length(clean2) between 1 and 2 then clean2 end num
      from co where ckey<>'' or b is not null),
    si as (select *, case when length(key)=0 then 0e0 else greatest(0e0,1-cast(levenshtein(regexp_replace(key,'[^a-z]','#','g'),'test') as double)/greatest(length(key),4)) end sim,
        case when regexp_full_match(translate(num,'oOlI','0011'),'[0-9]{{1,2}}') then cast(translate(num,'oOlI','0011') as int) end n,
        case when regexp_full_match(num,'[0-9]+') then 1e0 else 0.8e0 end nc,
        case when ckey<>'' then a.c else coalesce((a.c+b.c)/2e0, a.c, b.c) end oc,
        case when ckey<>'' then a.x else least(a.x,b.x) end x, case when ckey<>'' then a.y else least(a.y,b.y) end y,
        case when ckey<>'' then a.t else a.t||' '||b.t end raw from ke),
    ge as (select *, ((case when len<=3 then 1e0 else 0.45e0 end)+(case when x<=1000*0.7e0 then 1e0 else 0.5e0 end)+(case when y>=1400*0.92e0 then 0.1e0 else 1e0 end))/3e0 geo from si where sim>=0.75e0 and n between 1 and 99),
    cand as (select paper_id, page_number, n test_number, raw raw_text, x, y, geo, sim, nc, oc,
        least(1e0,(0.35e0*sim+0.2e0*nc+0.2e0*coalesce(oc,0.5e0)+0.25e0*geo)*(case when len>s+3 then 0.65e0 else 1e0 end)*(case when a.y>=1400*0.92e0 then 0.55e0 else 1e0 end)) confidence,
        case when key in ('lest','tesl','tost') then 'ocr_confusion' when key<>'test' then 'fuzzy_keyword' when nc<1 then 'ocr_confusion' when ckey<>'' then 'compact_token' else 'exact_tokens' end strategy,
        cast(row_number() over (partition by paper_id order by page_number, y, x, n, a.idx)-1 as int) no from ge)"""


def _chain(threshold: str) -> str:
    return f"""
    elig as (select paper_id, no, test_number num, confidence conf from cand where test_number between 1 and 16 and confidence>={threshold}), {chain_sql('elig')},
    mark as (select c.* from cand c join accepted a on a.paper_id=c.paper_id and a.no=c.no),
    regs as (select m.paper_id, p.page_number, m.test_number, case when p.page_number=m.page_number then y else 0 end top, case when p.page_number=np then ny else 1400 end bottom
      from (select *, lead(page_number) over w np, lead(y) over w ny from mark window w as (partition by paper_id order by no)) m
      join fx_pages p on p.paper_id=m.paper_id and p.page_number between m.page_number and coalesce(np, (select count(*) from fx_pages q where q.paper_id=m.paper_id)))"""


@query("e1_detect_markers", f"""with {CANDIDATE_SQL} select paper_id, page_number, test_number, raw_text, cast(x as int) marker_x, cast(y as int) marker_y, round(confidence,9) confidence, round(sim,9) text_similarity, nc numeric_confidence,
      round(oc,9) ocr_confidence, round(geo,9) geometry_confidence, strategy, no candidate_no from cand""")
def _(fx):
    c = R.detect_markers(fx.pages(), fx.words())
    rounded = ["confidence", "text_similarity", "ocr_confidence", "geometry_confidence"]
    return c.select(*PAGE, "test_number", "raw_text", "marker_x", "marker_y", "numeric_confidence", "strategy", "candidate_no", *[F.round(x, 9).alias(x) for x in rounded])


@query("e2_select_markers", f"""with {CANDIDATE_SQL}, {_chain('0.62e0')},
    w as (select *, test_number-lag(test_number) over v b, lead(test_number) over v-test_number f from mark window v as (partition by paper_id order by no)),
    s as (select *, case b when 1 then 1e0 when 2 then 0.7e0 else 0.4e0 end sb, case f when 1 then 1e0 when 2 then 0.7e0 else 0.4e0 end sf from w),
    z as (select *, case when b is not null and f is not null then (sb+sf)/2e0 when b is not null then sb when f is not null then sf else 0.5e0 end seq from s)
    select paper_id, page_number, no candidate_no, test_number, printf('Test %02d',test_number) label, seq sequence_confidence, round(least(1e0,0.85e0*confidence+0.15e0*seq),9) confidence from z""")
def _(fx):
    accepted, _r, _d = R.select_markers(R.detect_markers(fx.pages(), fx.words()))
    return accepted.select(*PAGE, "candidate_no", "test_number", "label", "sequence_confidence", F.round("confidence", 9).alias("confidence"))


@query("e3_segment_regions", f"""with {CANDIDATE_SQL}, {_chain('0.62e0')} select paper_id, page_number, test_number, cast(top as int) y, cast(bottom-top as int) height from regs
      where paper_id not in (select paper_id from regs where bottom<=top)""")
def _(fx):
    accepted, _r, _d = R.select_markers(R.detect_markers(fx.pages(), fx.words()))
    regions, _v = R.segment_regions(fx.pages(), accepted)
    return regions.select(*PAGE, "test_number", "region.y", "region.height")


# A result read from another file on a page whose number of words is a multiple of 61; its paper is left out.
@query("e4_exam_structure", f"""with {CANDIDATE_SQL}, {_chain('0.60e0')},
    dup as (select paper_id, test_number from cand group by all having count(*)>1),
    wrong as (select distinct paper_id from (select paper_id, page_number from fx_words group by all having count(*)%61=0)),
    per as (select paper_id from fx_pages where paper_id not in (select paper_id from wrong) group by 1 having min(page_number)=1 and max(page_number)=count(*)),
    good as (select * from regs where paper_id not in (select paper_id from regs where bottom<=top)),
    c as (select paper_id, page_number, string_agg(concat(no,':',test_number), ',' order by no) candidates from cand group by all),
    m as (select paper_id, page_number, string_agg(concat(no,':',test_number), ',' order by no) markers from mark group by all),
    r as (select paper_id, page_number, string_agg(concat(test_number,':',top,':',bottom-top), ',' order by test_number) regions from good group by all),
    mi as (select paper_id, string_agg(cast(n as varchar), ',' order by n) missing from per, range(1,17) t(n) where not exists (select 1 from mark k where k.paper_id=per.paper_id and k.test_number=n) group by 1),
    du as (select paper_id, string_agg(cast(test_number as varchar), ',' order by test_number) duplicates from dup group by 1)
    select g.paper_id, g.page_number, coalesce(candidates,'') candidates, coalesce(markers,'') markers, coalesce(regions,'') regions, coalesce(missing,'') missing, coalesce(duplicates,'') duplicates
    from fx_pages g join per using (paper_id) left join c using (paper_id, page_number) left join m using (paper_id, page_number) left join r using (paper_id, page_number)
      left join mi using (paper_id) left join du using (paper_id)""")
def _(fx):
    path = F.concat_ws("/", "paper_id", "page_number")
    counted = fx.words().groupBy(*PAGE).agg((F.count(F.lit(1)) % 61 == 0).alias("wrong"))
    results = fx.pages().join(counted, PAGE, "left").select(*PAGE, F.when(F.col("wrong"), "elsewhere").otherwise(path).alias("source_path"))
    s = R.exam_structure(fx.pages().withColumn("source_path", path), fx.words(), results=results)

    def joined(name: str, *fields: str):
        return F.array_join(F.transform(name, lambda v: F.concat_ws(":", *[reduce(lambda a, k: a[k], f.split("."), v) for f in fields])), ",").alias(name)

    def numbers(name: str):
        return s[name].groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list("test_number")).cast("array<string>"), ",").alias(name))

    out = s["rollup"].select(
        *PAGE, joined("candidates", "candidate_no", "test_number"), joined("markers", "candidate_no", "test_number"), joined("regions", "test_number", "region.y", "region.height")
    )
    return out.join(numbers("missing"), "paper_id", "left").join(numbers("duplicates"), "paper_id", "left").fillna("", ["missing", "duplicates"])


# Evidence: ink of words and components from arithmetic on their position.
_INK = "((x*7+y)%101)/100e0 red, ((x*3+y*5)%101)/100e0 sat, ((x*11+y)%101)/100e0 blue, ((y*7)%101)/100e0 dark, ((x+y*2)%101)/100e0 edge, ((x*5+y*3)%101)/100e0 fg, cast((x+y)%12 as int) components"


def _ink(x, y):
    def h(e):
        return (e % 101) / F.lit(100.0)

    return F.struct(
        h(x * 3 + y * 5).alias("mean_saturation"), h(x * 5 + y * 3).alias("foreground_ratio"), h(x * 7 + y).alias("red_foreground_ratio"),
        h(x * 11 + y).alias("blue_foreground_ratio"), h(y * 7).alias("dark_foreground_ratio"), h(x + y * 2).alias("local_contrast"),
        h(x + y * 2).alias("edge_density"), ((x + y) % 12).cast("int").alias("connected_component_count"),
    )


def evidence_inputs(fx):
    words = fx.words()
    ink = words.select(*PAGE, "word_index", _ink(F.col("x"), F.col("y")).alias("ink"))
    below = (F.col("component.y") >= 700).cast("int")
    components = fx.components().select(
        *PAGE, (2 * F.col("page_number") - 1 + below).alias("test_number"), "component_no", F.col("component").alias("box"),
        _ink(F.col("component.x"), F.col("component.y")).alias("ink"),
    )
    return words, half_page_regions(fx), ink, components


_E5 = f"""{LINE_SQL}, {REGIONS_SQL},
    w as (select *, {_INK}, x wx, y wy, width ww, height wh, case when block_number is not null and paragraph_number is not null and line_number is not null
        then 'n:'||block_number||':'||paragraph_number||':'||line_number else 'c:'||(y*2+height)||':'||height end line_id from fx_words),
    lw as (select w.*, test_number, greatest(wx,rx) bx, greatest(wy,ry) "by", least(wx+ww,rx+rw)-greatest(wx,rx) bw, least(wy+wh,ry+rh)-greatest(wy,ry) bh
      from w join regions using (paper_id, page_number) where {inter('w', 'r')}>0 and {smaller('w', 'r')}>=0.60e0),
    cc as (select paper_id, page_number, component_no, cast(2*page_number-1+(y>=700)::int as int) test_number, x, y, width, height, x cx, y cy, width cw, height ch, {_INK} from fx_components),
    loose as (select * from cc where not exists (select 1 from lw where lw.paper_id=cc.paper_id and lw.page_number=cc.page_number and lw.test_number=cc.test_number
        and least(cx+cw,bx+bw)>greatest(cx,bx) and least(cy+ch,"by"+bh)>greatest(cy,"by")
        and cast((least(cx+cw,bx+bw)-greatest(cx,bx))*(least(cy+ch,"by"+bh)-greatest(cy,"by")) as double)/least(cw*ch,bw*bh)>=0.50e0)),
    feat as (select lw.paper_id, lw.page_number, test_number, bx, "by", bw, bh, word_index, red, sat, blue, dark, edge, components, confidence ocr_conf,
        greatest(0e0,least(1e0,1-(hi+bi+si)/3e0)) regularity, hi, bi, si, least(1e0,wa/cast(greatest(1,cast(x1-x0 as bigint)*(y1-y0)) as double)) density,
        least(1e0,components/greatest(2e0,length(text)*1.5e0)) fragmentation, case when n=1 then 1e0 else greatest(0e0,1-(n-1)/5e0) end isolation,
        case when x<=1000*0.08e0 or x+width>=1000*0.92e0 then 1e0 else 0e0 end margin from lw join v using (paper_id, page_number, line_id)
      union all select paper_id, page_number, test_number, x, y, width, height, -1, red, sat, blue, dark, edge, components, null, 0e0, 0.5e0, 0.5e0, 0.5e0, fg,
        least(1e0,components/6e0), 1e0, case when x<=1000*0.08e0 or x+width>=1000*0.92e0 then 1e0 else 0e0 end from loose),
    {FQ.class_sql('feat', '((bi+hi+si)/3e0)')}"""


@query("e5_separate_evidence", f"""with {_E5} select paper_id, page_number, test_number, evidence_type, count(*) n, round(sum(confidence),6) total_confidence, cast(sum(bx) as bigint) sx, cast(sum("by") as bigint) sy,
      count(*) filter (where word_index<0) from_ink from classified group by all""")
def _(fx):
    words, regions, ink, components = evidence_inputs(fx)
    e = E.separate_evidence(fx.pages(), words, regions, ink, components)
    return e.groupBy(*PAGE, "test_number", "evidence_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("total_confidence"), F.sum("box.x").alias("sx"), F.sum("box.y").alias("sy"),
        F.count_if(F.size("source_word_indices") == 0).alias("from_ink"),
    )


@query("e6_answer_regions", f"""with {MERGE_SQL} select paper_id, cast(opened as int) answer_no, cast(m.x as int) x, cast(m.y as int) y, cast(m.r-m.x as int) width,
      cast(m.b-m.y as int) height, m.c confidence, array_to_string(m.idx,',') students from merged""")
def _(fx):
    a = E.answer_regions(fx.guide_regions(), fx.guides(), fx.region_evidence())
    return a.select("paper_id", "answer_no", "box.x", "box.y", "box.width", "box.height", "confidence", F.array_join(F.col("source_indices").cast("array<string>"), ",").alias("students"))


@query("e7_bundle_violations", """
    select paper_id, 'evidence' child, evidence_no child_no from fx_region_evidence where x+width>950 or y+height>560
    union all select paper_id, 'answer', no from (select *, cast(row_number() over (partition by paper_id order by y, x, width)-1 as int) no from fx_guides)
      where y<90 or x+width>950 or y+height>560""")
def _(fx):
    from scriptorium.operators.ranking import number_by_row

    narrow = fx.guide_regions().withColumn("region", B.box(F.lit(0), F.lit(90), F.lit(950), F.lit(470)))
    guides = fx.guides().withColumn("y", F.col("line_box.y"))
    answers = number_by_row(guides, E.TEST, "y", [F.col("line_box.x"), F.col("line_box.width")], "answer_no").withColumnRenamed("line_box", "box")
    return E.bundle_violations(narrow, fx.region_evidence(), answers).select("paper_id", "child", "child_no")


# Discovery ----------------------------------------------------------------------------------------

_CROP8 = crop("x0", "y0", "(x1-x0)", "(y1-y0)")
_E8 = f"""{CANDIDATE_SQL},
    l8 as (select paper_id, page_number, coalesce(nullif(block_number,0),y+1) b8, coalesce(nullif(paragraph_number,0),1) p8, coalesce(nullif(line_number,0),y+1) q8, count(*) n,
        coalesce(avg(confidence),0e0)*least(1e0,count(*)/6e0) ps, 0.65e0*(1-coalesce(avg(confidence),0.5e0))+0.35e0*(case when count(*)<2 then 0e0 else least(1e0,stddev_pop(height)/20e0) end) ir,
        min(x) x0, min(y) y0, max(x+width) x1, max(y+height) y1, min(word_index) fw from fx_words group by all),
    c8 as (select paper_id, page_number, component_no, x, y, width, height, case when x<1000*0.18e0 or x+width>1000*0.82e0 then 1e0 else 0.55e0 end iso from fx_components),
    j8 as (select l8.paper_id, l8.page_number, least(x0,c8.x) x0, least(y0,c8.y) y0, greatest(x1,c8.x+c8.width) x1, greatest(y1,c8.y+c8.height) y1, least(1e0,0.5e0+iso/2) score,
        row_number() over (partition by l8.paper_id, l8.page_number order by iso desc, y0, fw, component_no) rn
      from l8 join c8 using (paper_id, page_number) where abs((y0+(y1-y0)/2e0)-(c8.y+c8.height/2e0))<=greatest(120,(y1-y0)*3)),
    best as (select paper_id, page_number, 'printed_candidate' category, x0, y0, x1, y1, ps score, case when n>=8 then 'paragraph' else 'short_answer' end tags from l8 qualify row_number() over (partition by paper_id, page_number order by round(ps,12) desc, y0, fw)=1
      union all select paper_id, page_number, 'student_candidate', x0, y0, x1, y1, ir, case when n>=8 then 'paragraph' else 'short_answer' end from l8 qualify row_number() over (partition by paper_id, page_number order by round(ir,12) desc, y0, fw)=1
      union all select paper_id, page_number, 'teacher_mark_risk_candidate', x, y, x+width, y+height, iso, 'colored_ink_present' from c8 qualify row_number() over (partition by paper_id, page_number order by iso desc, component_no)=1
      union all select paper_id, page_number, 'mixed_uncertain_candidate', x0, y0, x1, y1, score, 'colored_ink_present' from j8 where rn=1),
    prop as (select paper_id, page_number, category, {_CROP8['x']} x, {_CROP8['y']} y, {_CROP8['w']} w, {_CROP8['h']} h, greatest(0e0,least(1e0,score)) score, tags from best
      union all select paper_id, page_number, 'blank_answer_candidate', 55, cast((paper_id*131+page_number*57)%1220 as int), 890, 180, cast((paper_id*7+page_number)%100 as double)/100, 'sparse_region,writing_guides_present' from fx_pages),
    list8 as (select paper_id, page_number, list([struct_pack(category:=category,x:=x,y:=y,w:=w,h:=h,score:=score,tags:=tags)] order by score desc, category) items from prop group by all),
    fold8 as (select paper_id, page_number, unnest(list_reduce(items, lambda acc, n: case when len(list_filter(acc, lambda k: (greatest(0,least(k.x+k.w,n[1].x+n[1].w)-greatest(k.x,n[1].x))*greatest(0,least(k.y+k.h,n[1].y+n[1].h)-greatest(k.y,n[1].y)))
        /cast(k.w*k.h+n[1].w*n[1].h-greatest(0,least(k.x+k.w,n[1].x+n[1].w)-greatest(k.x,n[1].x))*greatest(0,least(k.y+k.h,n[1].y+n[1].h)-greatest(k.y,n[1].y)) as double)>0.72e0))=0 then list_concat(acc,n) else acc end)) m from list8)"""


@query("e8_discover_candidates", f"""with {_E8} select f.paper_id, f.page_number, m.category category, m.x x, m.y y, m.w width, m.h height, round(m.score,9) score, concat_ws(',', m.tags, case when m.x<1000*0.12e0 then 'margin_region' end) tags,
      (select max(struct_pack(y:=c.y, n:=-c.x*1000-c.test_number, t:=c.test_number)).t from cand c where c.paper_id=f.paper_id and c.page_number=f.page_number and c.y<=m.y) test_number from fold8 f""")
def _(fx):
    pages, words = fx.pages(), fx.words()
    bands = pages.select(
        *PAGE, B.box(F.lit(55), ((F.col("paper_id") * 131 + F.col("page_number") * 57) % 1220).cast("int"), F.lit(890), F.lit(180)).alias("box"),
        (((F.col("paper_id") * 7 + F.col("page_number")) % 100).cast("double") / 100).alias("score"),
    )
    found = P.discover_candidates(pages, words, R.detect_markers(pages, words), isolated(fx), bands)
    return found.select(
        *PAGE, "category", "region.x", "region.y", "region.width", "region.height", F.round("score", 9).alias("score"),
        F.array_join("context_tags", ",").alias("tags"), "test_number",
    )


_C9 = crop("x", "y", "width", "height", True)
_E9 = f"""{CANDIDATE_SQL},
    gate as (select * from fx_components where not (width<4 or height<4 or contour_area<16 or contour_area>1000e0*1400*0.008e0 or width>1000*0.28e0 or height>1400*0.18e0)),
    near as (select g.paper_id, g.page_number, g.component_no, min(d) nd, count(*) filter (where d<=180) nb, coalesce(bool_or(confidence>=0.78e0) filter (where d<=180),false) cn from
      (select g.paper_id, g.page_number, g.component_no, w.confidence, sqrt(pow(g.x+g.width/2e0-(w.x+w.width/2e0),2)+pow(g.y+g.height/2e0-(w.y+w.height/2e0),2)) d
        from gate g join fx_words w on g.paper_id=w.paper_id and g.page_number=w.page_number) g group by all),
    q as (select gate.*, cast(coalesce(nb,0) as int) nearby, greatest(0e0,1-coalesce(nd,500e0)/500) ocr_prox, coalesce(cn,false) conf_near from gate left join near using (paper_id, page_number, component_no)),
    {FQ.mark_sql('q')},
    risky as (select paper_id, page_number, component_no proposal_no, category, array_to_string(sorted_signals,',') signals, x, y, width, height, round(least(1e0, case category when 'mixed_teacher_context_risk' then 0.22e0 when 'tick_cross_correction_risk' then 0.18e0
        when 'margin_score_risk' then 0.16e0 when 'chromatic_ink_risk' then 0.14e0 else 0.08e0 end + least(0.35e0,n_signals*0.055e0) + 0.12e0*chroma + 0.10e0*margin_prox + 0.08e0*least(1e0,angled/4e0)),6) score from g where n_signals>0),
    controls as (select paper_id, page_number, 1099511627776+row_number() over (partition by paper_id, page_number order by confidence desc, y, x, word_index) proposal_no, x, y, width, height from fx_words where confidence>=0.90e0 and width>=15 and height>=8),
    every as (select * from risky union all select paper_id, page_number, proposal_no, 'hard_negative_control', 'high_confidence_print_nearby,printed_or_guide_hard_negative', x, y, width, height,
        round(0.25e0+0.15e0*greatest(0e0,least(1e0,1-least(x+width/2e0,1000-(x+width/2e0))/500e0)),6) from controls where proposal_no<=1099511627778)"""


@query("e9_discover_mark_risk", f"""with {_E9} select paper_id, page_number, proposal_no, category, signals, score, {_C9['x']} x, {_C9['y']} y, {_C9['w']} width, {_C9['h']} height,
      (select max(struct_pack(y:=c.y, n:=-c.x*1000-c.test_number, t:=c.test_number)).t from cand c where c.paper_id=e.paper_id and c.page_number=e.page_number and c.y<=e.y) test_number from every e""")
def _(fx):
    return mark_risk(fx).select(
        *PAGE, "proposal_no", "category", F.array_join(F.array_sort("signals"), ",").alias("signals"), F.round("score", 6).alias("score"),
        "region.x", "region.y", "region.width", "region.height", "test_number",
    )


def mark_risk(fx):
    pages, words = fx.pages(), fx.words()
    return P.discover_mark_risk(pages, words, R.detect_markers(pages, words), fx.components())


@query("e10_select_sample", f"""with {W14_SQL},
    picked as (select dataset_id, unnest(m) m from folded)
    select dataset_id, m.no proposal_no, cats[m.cat] category, printf('evidence_v2_%03d', row_number() over (partition by dataset_id order by m.alias, m.page, m.y, m.x, cats[m.cat], m.score desc)) sample_id
    from (select *, ['printed_candidate','student_candidate','teacher_mark_risk_candidate','mixed_uncertain_candidate','blank_answer_candidate'] cats from picked)""")
def _(fx):
    selected = P.with_sample_ids(P.select_expansion(expansion_pool(fx), QUOTAS))
    return selected.select("dataset_id", "proposal_no", "category", "sample_id")


@query("e21_quota_gate", """
    with q as (select unnest(['a','f','x']) category, unnest([400,0,3]) quota), d as (select distinct l_linenumber dataset_id from lineitem),
    s as (select l_linenumber dataset_id, case when l_returnflag='A' then 'a' when l_returnflag='N' then 'n' else 'r' end category, count(*) n from lineitem group by all),
    e as (select dataset_id, category, quota from d, q)
    select coalesce(e.dataset_id,s.dataset_id) dataset_id, coalesce(e.category,s.category) category, cast(coalesce(quota,0) as bigint) quota, coalesce(n,0) selected from e full outer join s on e.dataset_id=s.dataset_id and e.category=s.category
    where coalesce(quota,0)<>coalesce(n,0)""")
def _(fx):
    s = fx.table("lineitem").select(
        F.col("l_linenumber").alias("dataset_id"), F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "N", "n").otherwise("r").alias("category")
    )
    return P.quota_violations(s, {"a": 400, "f": 0, "x": 3})


# Evaluation ---------------------------------------------------------------------------------------


def ocr_inputs(fx):
    """Every text line as a sample, its damaged copy as the result; some results are failures."""
    pairs = fx.pairs()
    sample_id = F.concat_ws("_", "doc_id", "line_number").alias("sample_id")
    ok = (F.col("doc_id") + F.col("line_number")) % 19 != 0
    samples = pairs.select(
        sample_id, "doc_id", "line_number", "lang", F.col("ref_text").alias("ground_truth_text"), F.col("pred_text").alias("prediction_text"), ok.alias("ok"),
        F.when(F.trim("ref_text") == "", "verified_empty").otherwise("verified").alias("ground_truth_status"),
    )
    return samples.select(
        "*", F.when(F.col("ok"), "success").otherwise("failure").alias("status"), F.when(F.col("ok"), F.col("prediction_text")).alias("prediction"),
        (F.col("line_number") * 1.5).alias("duration_ms"), F.lit(None).cast("double").alias("preprocessing_ms"),
    )


def scored_lines(fx):
    """Samples and results already share their rows here, so no join is needed before scoring."""
    rows = ocr_inputs(fx)
    ok = F.col("status") == "success"
    from scriptorium.functions import text as T

    normal = rows.withColumn("_r", F.when(ok, T.normalize_metric(F.col("ground_truth_text")))).withColumn("_p", F.when(ok, T.normalize_metric(F.col("prediction"))))
    return normal.withColumn("cer", F.when(ok, T.cer(F.col("_r"), F.col("_p")))).withColumn("wer", F.when(ok, T.wer(F.col("_r"), F.col("_p"))))


_SCORED = FQ._WORD_SQL.rstrip() + """,
    sc as (select c.doc_id, c.line_number, c.lang, (c.doc_id+c.line_number)%19<>0 ok, c.errors ce, length(r) cu, w.errors we, len(list_filter(string_split(r,' '), lambda q: q<>'')) wu, p
      from c join word_errors w using (doc_id, line_number)),
    rt as (select *, case when not ok then null when cu>0 then ce/cast(cu as double) when ce=0 then 0e0 end cer, case when not ok then null when wu>0 then we/cast(wu as double) when we=0 then 0e0 end wer from sc)
"""


@query("e11_score_ocr", _SCORED + "select doc_id, line_number, case when ok then 'success' else 'failure' end status, case when ok then cast(ce as int) end char_errors, round(cer,9) cer, case when ok then cast(we as int) end word_errors, round(wer,9) wer from rt")
def _(fx):
    inputs = ocr_inputs(fx)
    samples = inputs.select("sample_id", "doc_id", "line_number", "ground_truth_text", "ground_truth_status")
    results = inputs.select("sample_id", "status", "prediction")
    return V.score_ocr(samples, results).select(
        "doc_id", "line_number", "status", F.col("cer.errors").alias("char_errors"), F.round("cer.rate", 9).alias("cer"),
        F.col("wer.errors").alias("word_errors"), F.round("wer.rate", 9).alias("wer"),
    )


@query("e12_summarize_ocr", _SCORED + """select lang, count(*) total_samples, count(*) filter (where ok) successful_samples, count(*) filter (where not ok) failed_samples, round(avg(cer),9) mean_cer, round(avg(wer),9) mean_wer,
      round(median(cer),9) median_cer, round(median(wer),9) median_wer, round(median(line_number*1.5e0) filter (where ok),6) median_duration from rt group by lang""")
def _(fx):
    s = V.summarize_ocr(scored_lines(fx), ["lang"])
    return s.select(
        "lang", "total_samples", "successful_samples", "failed_samples", *[F.round(c, 9).alias(c) for c in ("mean_cer", "mean_wer", "median_cer", "median_wer")],
        F.round("median_duration", 6).alias("median_duration"),
    )


@query("e12_compare_runs", """
    with r as (select *, l_partkey%13<>0 ok from lineitem), b as (select l_returnflag f, avg(l_discount) filter (where ok) mc, median(l_discount) filter (where ok) dc, avg(l_tax) filter (where ok and l_quantity>8) mw, median(l_tax) filter (where ok and l_quantity>8) dw from r group by 1),
    v as (select l_returnflag f, avg(l_tax) filter (where ok) mc, median(l_tax) filter (where ok) dc, avg(l_discount) filter (where ok and l_returnflag<>'A') mw, median(l_discount) filter (where ok and l_returnflag<>'A') dw from r group by 1)
    select b.f l_returnflag, round(v.mc-b.mc,9) delta_mean_cer, round(v.dc-b.dc,9) delta_median_cer, round(v.mw-b.mw,9) delta_mean_wer, round(v.dw-b.dw,9) delta_median_wer from b join v using (f)""")
def _(fx):
    def run(cer, wer):
        rows = fx.table("lineitem").select(
            "l_returnflag", F.when(F.col("l_partkey") % 13 != 0, "success").otherwise("failure").alias("status"), F.lit("x").alias("prediction"),
            F.struct(cer.alias("rate")).alias("cer"), F.struct(wer.alias("rate")).alias("wer"), F.lit(1.0).alias("duration_ms"), F.lit(1.0).alias("preprocessing_ms"),
        )
        return V.summarize_ocr(rows, ["l_returnflag"], store=False)

    base = run(F.col("l_discount"), F.when(F.col("l_quantity") > 8, F.col("l_tax")))
    variant = run(F.col("l_tax"), F.when(F.col("l_returnflag") != "A", F.col("l_discount")))
    d = V.compare_runs(base, variant, ["l_returnflag"])
    return d.select("l_returnflag", *[F.round(c, 9).alias(c) for c in d.columns if c != "l_returnflag"])


@query("e13_evaluate_evidence", f"""with {_ROWS},
    s as (select count(*) sample_count, round(count(*) filter (where class_correct)/cast(count(*) as double),9) overall_accuracy from rows_),
    t as (select (select count(*) from fx_numbered_boxes) h, (select count(*) from fx_predictions) p, (select count(*) from matches where threshold=0.5e0) m50, (select count(*) from matches where threshold=0.25e0) m25)
    select sample_count, overall_accuracy, h human_box_count, p predicted_box_count, m50 matched_at_50, round(2*m50/cast(p+h as double),9) f1_at_50, m25 matched_at_25, round(2*m25/cast(p+h as double),9) f1_at_25 from s, t""")
def _(fx):
    samples = fx.human_boxes().select("sample_id").distinct().select(
        "sample_id", B.box(F.lit(100), F.lit(50), F.lit(2000), F.lit(2000)).alias("region"), F.array(F.lit("all")).alias("categories")
    )
    kinds = F.array(*[F.lit(k) for k in ("printed", "student_candidate", "teacher_candidate", "unknown")])
    annotations = samples.select("sample_id", F.element_at(kinds, (F.col("sample_id") * 3 % 4 + 1).cast("int")).alias("evidence_type"), F.lit("annotated").alias("answer_status"))
    answers = fx.moved_predictions().select(
        "sample_id", F.col("predicted_idx").alias("answer_no"),
        B.box(F.col("predicted_box.x") + 100, F.col("predicted_box.y") + 50, F.col("predicted_box.width"), F.col("predicted_box.height")).alias("box"),
    )
    r = V.evaluate_evidence(samples, annotations, fx.human_boxes(), typed_boxes(fx), answers)
    from scriptorium.operators.summaries import join_summaries

    both = join_summaries(r["classification"], r["localization"], [])
    return both.select(
        "sample_count", F.round("overall_accuracy", 9).alias("overall_accuracy"), "human_box_count", "predicted_box_count",
        "matched_at_50", F.round("f1_at_50", 9).alias("f1_at_50"), "matched_at_25", F.round("f1_at_25", 9).alias("f1_at_25"),
    )


@query("e14_structure_summary", A19_SQL)
def _(fx):
    s = V.structure_summary(structure_rows(fx))
    return s.select(
        "paper_count", "expected_markers", "detected_markers", "true_positives", "duplicate_markers",
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "mean_test_number_accuracy")],
    )
