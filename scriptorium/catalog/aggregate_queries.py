"""Aggregations A1-A30 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog.function_queries import CLASS_SQL
from scriptorium.catalog.join_queries import PAGE, half_page_regions, valid_saves
from scriptorium.catalog.ordered_queries import MATCH_SQL, TRUTH_SQL, structure_found, structure_truth
from scriptorium.catalog.registry import query
from scriptorium.operators import fingerprints as P
from scriptorium.operators.matching import match_boxes
from scriptorium.operators.summaries import exact_medians
from scriptorium.plans import evaluation as V
from scriptorium.plans import evidence as E
from scriptorium.plans import labels as L
from scriptorium.plans import overviews as O
from scriptorium.plans import structure as R
from scriptorium.session import cut_lineage

_KEYED = """
    k as (select *, coalesce(block_number,y+1) kb, coalesce(paragraph_number,1) kp, coalesce(line_number,y+1) kl from fx_words)"""


@query("a1_dataset_summary", """
    with f as (select paper_id, count(*) pages from fx_pages group by 1)
    select f.pages page_count, count(*) papers, (select count(*) from fx_pages) total_pages, (select cast(sum(n_chars) as bigint) from documents) total_bytes,
      (select count(*) from documents where length(trim(text))=0) textless, (select min(length(html)) from pages)::int min_width, (select median(length(html)) from pages) median_width,
      (select max(length(html)) from pages)::int max_width from f group by f.pages""")
def _(fx):
    from scriptorium.operators.summaries import join_summaries

    per_paper = fx.pages().groupBy("paper_id").agg(F.count(F.lit(1)).alias("page_count"))
    distribution = per_paper.groupBy("page_count").agg(F.count(F.lit(1)).alias("papers"))
    docs = fx.table("documents").agg(
        F.count(F.lit(1)).alias("total_pages"), F.sum("n_chars").alias("total_bytes"), F.count_if(F.length(F.trim("text")) == 0).alias("textless")
    )
    width = F.length("html")
    sizes = fx.table("pages").agg(F.min(width).alias("min_width"), F.max(width).alias("max_width"))
    middle = exact_medians(fx.table("pages"), [], {"median_width": width})
    return join_summaries(distribution, join_summaries(join_summaries(docs, sizes, []), middle, []), [])


# Files: documents with pages from their length; images: one per page record.
_FILES_SQL = "f as (select 1+cast(floor(n_chars/400) as int) pages, n_chars size_bytes, doc_id%17=0 encrypted, text from documents), i as (select length(html) width, length(url)+page_id%97 height from pages)"


def dataset_files(fx):
    files = fx.table("documents").select((1 + F.floor(F.col("n_chars") / 400)).cast("int").alias("pages"), F.col("n_chars").alias("size_bytes"), (F.col("doc_id") % 17 == 0).alias("encrypted"), "text")
    images = fx.table("pages").select(
        F.length("html").alias("width"), (F.length("url") + F.col("page_id") % 97).alias("height"), F.when(F.col("page_id") % 3 == 0, "jpeg").otherwise("ccitt").alias("encoding")
    )
    return files, images


@query("a1_dataset_measures", f"""
    with {_FILES_SQL}
    select count(*) files, cast(sum(pages) as bigint) total_pages, cast(sum(size_bytes) as bigint) total_bytes, min(pages) min_pages, median(pages) median_pages, max(pages) max_pages,
      count(*) filter (where trim(text, ' \t\n\r')='') textless, count(*) filter (where encrypted) encrypted,
      (select count(*) from i) images, (select count(*) from pages where page_id%3=0) jpeg_images,
      (select cast(min(width) as int) from i) min_width, (select median(width) from i) median_width, (select cast(max(width) as int) from i) max_width,
      (select min(height) from i) min_height, (select median(height) from i) median_height, (select max(height) from i) max_height from f""")
def _(fx):
    return O.dataset_summary(*dataset_files(fx))


@query("a1_page_count_distribution", f"with {_FILES_SQL} select pages page_count, count(*) files from f group by 1")
def _(fx):
    return O.page_count_distribution(dataset_files(fx)[0])


@query("a2_layout_text", f"""
    with {_KEYED},
    l as (select paper_id, page_number, kb, kp, kl, string_agg(text,' ' order by coalesce(word_number,2147483647), x, y, text) line from k group by all),
    p as (select paper_id, page_number, kb, kp, string_agg(line, chr(10) order by kl) par from l group by all)
    select paper_id, page_number, md5(string_agg(par, chr(10)||chr(10) order by kb, kp)) digest from p group by all""")
def _(fx):
    return R.layout_text(fx.words()).select(*PAGE, F.md5(F.col("layout_text").cast("binary")).alias("digest"))


@query("a3_marker_lines", f"""
    with {_KEYED},
    o as (select *, row_number() over (partition by paper_id, page_number, kb, kp, kl order by word_number nulls last, x, word_index) pos from k),
    s as (select paper_id, page_number, kb, kp, kl, count(*) line_length, string_agg(text,' ' order by pos) filter (where pos<=5) head,
        bool_or(case when length(v)>0 then 1-cast(levenshtein(regexp_replace(v,'[^a-z]','#','g'),'test') as double)/greatest(length(v),4)>=0.75e0 else false end) promising
      from (select *, case when regexp_extract(c,'^(\\p{{L}}+)([^\\p{{L}}].*)$',1)<>'' then lower(regexp_extract(c,'^(\\p{{L}}+)([^\\p{{L}}].*)$',1)) else regexp_replace(lower(text),'[^\\p{{L}}]','','g') end v
        from (select *, regexp_replace(text,'[^\\p{{L}}\\p{{N}}]','','g') c from o)) group by all)
    select paper_id, page_number, kb key_block, kp key_paragraph, kl key_line, line_length, head from s where promising""")
def _(fx):
    return R.heading_lines(fx.words()).select(
        *PAGE, "key_block", "key_paragraph", "key_line", "line_length", F.array_join(F.transform("head", lambda w: w["text"]), " ").alias("head")
    )


@query("a4_line_boxes", f"""
    with {_KEYED} select paper_id, page_number, kb key_block, kp key_paragraph, kl key_line, min(x) x, min(y) y, max(x+width)-min(x) width, max(y+height)-min(y) height from k group by all""")
def _(fx):
    k = R.with_line_keys(fx.words())
    return k.groupBy(*PAGE, *R.LINE).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"),
    )


@query("a5_page_confidence", "select paper_id, page_number, round(avg(confidence),9) confidence from fx_words group by all")
def _(fx):
    from scriptorium.sources.words import page_confidence

    return page_confidence(fx.words(), PAGE).withColumn("confidence", F.round("confidence", 9))


# Line statistics: members of each line, per-line facts, deviations.
LINE_SQL = """
    m as (select paper_id, page_number, 'n:'||block_number||':'||paragraph_number||':'||line_number line_id, word_index, x, y, width, height from fx_words
        where block_number is not null and paragraph_number is not null and line_number is not null
      union all select t.paper_id, t.page_number, t.line_id, w.word_index, w.x, w.y, w.width, w.height
        from (select distinct paper_id, page_number, 'c:'||(y*2+height)||':'||height line_id, y+height/2e0 cy, height h from fx_words where block_number is null) t
        join fx_words w on t.paper_id=w.paper_id and t.page_number=w.page_number and abs(w.y+w.height/2e0-cy)<=greatest(h,w.height)*0.6e0),
    f as (select paper_id, page_number, line_id, median(height) mh, median(y+height) mb, count(*) n, min(x) x0, min(y) y0, max(x+width) x1, max(y+height) y1, sum(cast(width as bigint)*height) wa from m group by all),
    g as (select *, greatest(0, x-lag(x+width) over (partition by paper_id, page_number, line_id order by x, y, word_index)) raw_gap,
        lag(x) over (partition by paper_id, page_number, line_id order by x, y, word_index) px from m),
    s as (select paper_id, page_number, line_id, avg(abs(height-mh)) hd, avg(abs(y+height-mb)) bd, count(px) gaps, avg(case when px is not null then raw_gap end) mg, stddev_pop(case when px is not null then raw_gap end) sg
      from g join f using (paper_id, page_number, line_id) group by all),
    v as (select f.*, case when n>=2 then least(1e0,hd/greatest(1e0,mh)*2) else 0e0 end hi, case when n>=2 then least(1e0,bd/greatest(1e0,mh)*2) else 0e0 end bi,
        case when gaps<2 or mg=0 then 0e0 else least(1e0,sg/mg) end si from f join s using (paper_id, page_number, line_id))"""


@query("a6_line_features", f"""with {LINE_SQL}
    select paper_id, page_number, line_id, round(hi,9) height_irregularity, round(bi,9) baseline_irregularity, round(si,9) spacing_irregularity,
      round(greatest(0e0,least(1e0,1-(hi+bi+si)/3e0)),9) regularity, round(least(1e0,wa/cast(greatest(1,cast(x1-x0 as bigint)*(y1-y0)) as double)),9) line_density,
      case when n=1 then 1e0 else greatest(0e0,round(1-(n-1)/5e0,9)) end isolation, cast(n as int) word_count_in_line from v""")
def _(fx):
    _, s = E.line_facts(fx.words())
    rounded = ["height_irregularity", "baseline_irregularity", "spacing_irregularity", "regularity", "line_density", "isolation"]
    return s.select(*PAGE, "line_id", *[F.round(c, 9).alias(c) for c in rounded], "word_count_in_line")


@query("a7_duplicate_candidates", "select paper_id, test_number, copies from (select paper_id, cast(conf%16+1 as int) test_number, count(*) copies from fx_headings group by all) where copies>1")
def _(fx):
    return R.duplicate_numbers(fx.headings().select("paper_id", (F.col("conf") % 16 + 1).alias("test_number")))


@query("a8_page_rollup", """
    with h as (select paper_id, page_number, count(*) n, string_agg(cast(true_number as varchar), ',' order by true_number) numbers from fx_headings group by all)
    select g.paper_id, g.page_number, cast(coalesce(n,0) as int) candidates, coalesce(numbers,'') numbers,
      case when g.page_number=2 then '' else concat(2*g.page_number-1,'@0,',2*g.page_number,'@700') end regions from fx_pages g left join h using (paper_id, page_number)""")
def _(fx):
    h = fx.headings().select(*PAGE, F.col("true_number").alias("candidate_no"), F.col("true_number").alias("test_number"), F.struct("x", "y").alias("box"), "conf")
    h = h.withColumnRenamed("conf", "confidence")
    # Regions on all pages but the second of a paper, so that pages without any keep an empty array.
    regions = half_page_regions(fx).where("page_number <> 2")
    return R.page_rollup(fx.pages(), h, h, regions).select(
        *PAGE, F.size("candidates").alias("candidates"),
        F.array_join(F.transform("markers", lambda m: m["test_number"].cast("string")), ",").alias("numbers"),
        F.array_join(F.transform("regions", lambda r: F.concat_ws("@", r["test_number"], r["region"]["y"])), ",").alias("regions"),
    )


@query("a9_dominant_class", """
    with a as (select sample_id, case (box_idx*7+hx)%4 when 0 then 'printed' when 1 then 'student_candidate' when 2 then 'teacher_candidate' else 'unknown' end t, sum(cast(hw*hh as bigint)) area from fx_numbered_boxes group by all),
    m as (select sample_id, max(area) area from a group by 1), w as (select a.sample_id, count(*) n, min(t) t from a join m on a.sample_id=m.sample_id and a.area=m.area group by 1)
    select o.o_orderkey sample_id, case when n=1 then t else 'unknown' end predicted_class from orders o left join w on o.o_orderkey=w.sample_id""")
def _(fx):
    return V.dominant_class(fx.table("orders").select(F.col("o_orderkey").alias("sample_id")), typed_boxes(fx))


def typed_boxes(fx):
    kinds = F.array(*[F.lit(k) for k in ("printed", "student_candidate", "teacher_candidate", "unknown")])
    return fx.boxes().select(
        "sample_id", F.element_at(kinds, ((F.col("box_idx") * 7 + F.col("human_box.x")) % 4 + 1).cast("int")).alias("evidence_type"), F.col("human_box").alias("box")
    )


# OCR summaries: one scored row per line item; rates are cheap so that the summary is measured.
_RUNS = """
    r as (select *, l_partkey%13<>0 ok, case when l_quantity>10 then l_discount/l_quantity when l_quantity>5 then 0e0 end cer, case when l_quantity>8 then l_tax end wer,
        cast(l_extendedprice as double) duration, case when l_linenumber%2=0 then cast(l_suppkey as double) end prep from lineitem)"""


def ocr_runs(fx):
    ok = F.col("l_partkey") % 13 != 0
    return fx.table("lineitem").select(
        "l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus",
        F.when(ok, "success").otherwise("failure").alias("status"),
        F.when(F.col("l_partkey") % 7 == 0, "").otherwise("text").alias("prediction"),
        F.struct(F.when(F.col("l_quantity") > 10, F.col("l_discount") / F.col("l_quantity")).when(F.col("l_quantity") > 5, 0.0).alias("rate")).alias("cer"),
        F.struct(F.when(F.col("l_quantity") > 8, F.col("l_tax")).alias("rate")).alias("wer"),
        F.col("l_extendedprice").alias("duration_ms"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("double")).alias("preprocessing_ms"),
        F.when(F.col("l_quantity") % 3 == 0, "verified_empty").otherwise("verified").alias("ground_truth_status"),
        F.lower("l_returnflag").alias("difficulty"),
        F.array(F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")), F.concat(F.lit("q"), (F.col("l_linenumber") % 3).cast("string"))).alias("categories"),
        (F.col("l_tax") > 0.05).alias("teacher_annotations_present"),
    )


_SUMMARY = """count(*) total_samples, count(*) filter (where ok) successful_samples, count(*) filter (where not ok) failed_samples,
      round(avg(cer) filter (where ok),6) mean_cer, round(avg(wer) filter (where ok),6) mean_wer, round(avg(duration) filter (where ok),4) mean_duration, round(avg(prep) filter (where ok),4) mean_preprocessing,
      count(*) filter (where ok and l_partkey%7=0) empty_successful_predictions, round(median(cer) filter (where ok),9) median_cer, round(median(wer) filter (where ok),9) median_wer,
      round(median(duration) filter (where ok),4) median_duration, round(median(prep) filter (where ok),4) median_preprocessing"""


def _rounded_summary(df):
    for c, d in {"mean_cer": 6, "mean_wer": 6, "mean_duration": 4, "mean_preprocessing": 4, "median_cer": 9, "median_wer": 9, "median_duration": 4, "median_preprocessing": 4}.items():
        df = df.withColumn(c, F.round(c, d))
    return df


@query("a10_ocr_summary", f"with {_RUNS} select l_returnflag, {_SUMMARY} from r group by l_returnflag")
def _(fx):
    return _rounded_summary(V.summarize_ocr(ocr_runs(fx), ["l_returnflag"], store=False))


@query("a11_label_summary", f"""with {_RUNS},
    e as (select *, unnest(list_filter(['difficulty:'||lower(l_returnflag),'category:s'||(l_suppkey%5),'category:q'||(l_linenumber%3),case when l_tax>0.05e0 then 'teacher-annotation-risk' end], lambda q: q is not null)) label from r)
    select label, {_SUMMARY} from e group by label""")
def _(fx):
    return _rounded_summary(V.summarize_ocr(V.with_report_labels(ocr_runs(fx)), ["label"], store=False))


@query("a12_verified_empty", f"""with {_RUNS} select l_linestatus, count(*) sample_count, count(*) filter (where ok and l_partkey%7=0) empty_predictions,
      count(*) filter (where ok and l_partkey%7<>0) nonempty_predictions, count(*) filter (where not ok) failed from r where l_quantity%3=0 group by 1""")
def _(fx):
    return V.verified_empty_behaviour(ocr_runs(fx), ["l_linestatus"])


_CELLS = """
    classes as (select unnest(['printed','student_candidate','teacher_candidate','unknown']) c),
    cells as (select a.c human, b.c predicted, (select count(*) from fx_labels l where l.human=a.c and l.predicted=b.c) n from classes a, classes b),
    pc as (select c evidence_type, cast((select sum(n) from cells where human=c) as bigint) support, cast((select sum(n) from cells where predicted=c) as bigint) predicted,
        cast((select sum(n) from cells where human=c and predicted=c) as bigint) tp from classes),
    metrics as (select evidence_type, support, predicted, tp true_positives, predicted-tp false_positives, support-tp false_negatives, tp/cast(nullif(predicted,0) as double) "precision",
        tp/cast(nullif(support,0) as double) recall, 2*tp/cast(nullif(predicted+support,0) as double) f1 from pc)"""


def label_cells(fx):
    return V.confusion_cells(fx.labels().select("human", "predicted"))


@query("a13_confusion_matrix", f"""with {_CELLS} select human, cast(sum(n) filter (where predicted='printed') as bigint) printed, cast(sum(n) filter (where predicted='student_candidate') as bigint) student_candidate,
      cast(sum(n) filter (where predicted='teacher_candidate') as bigint) teacher_candidate, cast(sum(n) filter (where predicted='unknown') as bigint) unknown from cells group by human""")
def _(fx):
    return V.confusion_matrix(label_cells(fx))


@query("a14_class_metrics", f"""with {_CELLS} select * replace (round("precision",9) as "precision", round(recall,9) as recall, round(f1,9) as f1) from metrics""")
def _(fx):
    m = V.class_metrics(label_cells(fx))
    for c in ("precision", "recall", "f1"):
        m = m.withColumn(c, F.round(c, 9))
    return m


@query("a15_classification_summary", f"""with {_CELLS} select cast(sum(n) as bigint) sample_count, round(sum(n) filter (where human=predicted)/cast(sum(n) as double),9) overall_accuracy,
      round(sum(n) filter (where predicted='unknown')/cast(sum(n) as double),9) unknown_prediction_rate, round(sum(n) filter (where human='unknown')/cast(sum(n) as double),9) human_unknown_rate,
      (select round(avg(f1),9) from metrics) macro_f1, (select round(sum(f1*support)/sum(support),9) from metrics where support>0 and f1 is not null) weighted_f1 from cells""")
def _(fx):
    s = V.classification_summary(label_cells(fx))
    return s.select("sample_count", *[F.round(c, 9).alias(c) for c in s.columns if c != "sample_count"])


# Localisation against predictions some of which were moved.
_LOCAL = MATCH_SQL.replace("fx_numbered_boxes p on", "fx_predictions p on")


def localization(fx):
    human, predicted = fx.human_boxes(), fx.moved_predictions()
    matches = match_boxes(human, predicted, ["sample_id"], [0.0, 0.25, 0.5])
    return human, predicted, matches


@query("a16_localization_summary", f"""with {_LOCAL},
    m as (select count(*) filter (where threshold=0) pos, round(avg(m.s) filter (where threshold=0),6) mean_iou, round(median(m.s) filter (where threshold=0),6) median_iou,
      count(*) filter (where threshold=0.5e0) m50, count(*) filter (where threshold=0.25e0) m25 from matches),
    t as (select (select count(*) from fx_numbered_boxes) h, (select count(*) from fx_predictions) p)
    select h human_box_count, p predicted_box_count, pos positive_overlap_match_count, mean_iou mean_matched_iou, median_iou median_matched_iou, m50 matched_at_50, m25 matched_at_25,
      round(m50/cast(p as double),9) precision_at_50, round(m50/cast(h as double),9) recall_at_50, round(2*m50/cast(p+h as double),9) f1_at_50, h-m50 missed_at_50, p-m50 extra_at_50,
      round(m25/cast(p as double),9) precision_at_25, round(m25/cast(h as double),9) recall_at_25, round(2*m25/cast(p+h as double),9) f1_at_25, h-m25 missed_at_25, p-m25 extra_at_25 from m, t""")
def _(fx):
    human, predicted, matches = localization(fx)
    matches = cut_lineage(matches.select("threshold", "iou"))  # read three times, matched once
    labels = human.select("sample_id").distinct().withColumn("answer_status", F.lit("annotated"))
    s = V.localization_summary(human, predicted, matches, labels)
    for c in ("mean_matched_iou", "median_matched_iou"):
        s = s.withColumn(c, F.round(c, 6))
    for at in ("50", "25"):
        for c in ("precision", "recall", "f1"):
            s = s.withColumn(f"{c}_at_{at}", F.round(f"{c}_at_{at}", 9))
    return s.drop("verified_empty_samples", "predicted_empty_samples", "correctly_predicted_empty", "false_positive_empty_samples", "empty_prediction_precision", "empty_recall")


@query("a17_empty_samples", """
    with s as (select o_orderkey sample_id, o_orderkey%3=0 is_empty from orders), b as (select distinct sample_id from fx_predictions where px<1000),
    f as (select is_empty, b.sample_id is not null has from s left join b using (sample_id)),
    c as (select count(*) filter (where is_empty) e, count(*) filter (where not has) p, count(*) filter (where is_empty and not has) k, count(*) filter (where is_empty and has) x from f)
    select e verified_empty_samples, p predicted_empty_samples, k correctly_predicted_empty, x false_positive_empty_samples, round(k/cast(nullif(p,0) as double),9) empty_prediction_precision,
      round(k/cast(nullif(e,0) as double),9) empty_recall from c""")
def _(fx):
    labels = fx.table("orders").select(
        F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 3 == 0, "verified_empty").otherwise("annotated").alias("answer_status")
    )
    # A box moved off its page (1,000 px wide) predicts no answer.
    s = V.empty_sample_summary(labels, fx.moved_predictions().where("predicted_box.x < 1000"))
    return s.withColumn("empty_prediction_precision", F.round("empty_prediction_precision", 9)).withColumn("empty_recall", F.round("empty_recall", 9))


_ROWS = f"""{_LOCAL},
    per as (select sample_id, count(*) filter (where threshold=0.5e0) m50, avg(m.s) filter (where threshold=0) mean_iou from matches group by 1),
    hb as (select sample_id, count(*) n, case (sample_id*3)%4 when 0 then 'printed' when 1 then 'student_candidate' when 2 then 'teacher_candidate' else 'unknown' end human from fx_numbered_boxes group by all),
    pb as (select sample_id, count(*) n from fx_predictions group by 1),
    ar as (select sample_id, case (box_idx*7+hx)%4 when 0 then 'printed' when 1 then 'student_candidate' when 2 then 'teacher_candidate' else 'unknown' end t, sum(cast(hw*hh as bigint)) area from fx_numbered_boxes group by all),
    mx as (select sample_id, max(area) area from ar group by 1),
    dc as (select ar.sample_id, case when count(*)=1 then min(t) else 'unknown' end predicted from ar join mx on ar.sample_id=mx.sample_id and ar.area=mx.area group by 1),
    rows_ as (select hb.sample_id, human evidence_type, predicted predicted_class, human=predicted class_correct, hb.n human_answer_boxes, coalesce(pb.n,0) predicted_answer_boxes, coalesce(m50,0) matched_answer_boxes_at_50, mean_iou mean_positive_iou
      from hb join dc using (sample_id) left join pb using (sample_id) left join per using (sample_id))"""


def evaluation_rows(fx):
    human, predicted, matches = localization(fx)
    kinds = F.array(*[F.lit(k) for k in ("printed", "student_candidate", "teacher_candidate", "unknown")])
    samples = human.select("sample_id").distinct()
    labels = V.sample_categories(
        samples.select(
            "sample_id",
            F.element_at(kinds, (F.col("sample_id") * 3 % 4 + 1).cast("int")).alias("evidence_type"),
            F.when(F.col("sample_id") % 3 != 0, F.col("sample_id") % 16).alias("test_number"),
            F.concat(F.lit("candidate_"), (F.col("sample_id") % 5).cast("string")).alias("discovery_category"),
            F.array(F.concat(F.lit("tag_"), (F.col("sample_id") % 2).cast("string"))).alias("context_tags"),
        )
    )
    return V.sample_rows(labels, V.dominant_class(samples, typed_boxes(fx)), human, predicted, matches)


@query("a18_stratified_errors", f"""with {_ROWS},
    c as (select *, unnest(['candidate_'||(sample_id%5), case when sample_id%3<>0 then 'detected_test' else 'no_detected_test' end, 'tag_'||(sample_id%2)]) category from rows_)
    select category, count(*) sample_count, count(*) filter (where not class_correct) classification_errors, count(*) filter (where matched_answer_boxes_at_50<human_answer_boxes) answer_miss_samples,
      count(*) filter (where matched_answer_boxes_at_50<predicted_answer_boxes) answer_extra_samples from c group by 1""")
def _(fx):
    return V.stratified(evaluation_rows(fx))


STRUCTURE_SQL = TRUTH_SQL.format(name="spatial", cond="true") + "," + TRUTH_SQL.format(name="exact", cond="tn=dn").split("edges as", 1)[1].split("),\n", 1)[1].strip() + """,
    tc as (select paper_id, count(*) expected from t group by 1), dcount as (select paper_id, count(*) detected from d group by 1),
    ec as (select paper_id, count(*) tp from exact group by 1), sc as (select paper_id, count(*) located, count(*) filter (where m.tn=m.dn) ok from spatial group by 1),
    du as (select paper_id, sum(n-1) extra from (select paper_id, dn, count(*) n from d group by all) group by 1),
    res as (select paper_id, expected expected_markers, detected detected_markers, coalesce(tp,0) true_positives, cast(coalesce(extra,0) as bigint) duplicate_markers, coalesce(located,0) located, coalesce(ok,0) ok
      from tc join dcount using (paper_id) left join ec using (paper_id) left join sc using (paper_id) left join du using (paper_id))"""


def structure_rows(fx):
    truth, found = structure_truth(fx), structure_found(fx)
    papers = fx.pages().groupBy("paper_id").agg(F.count(F.lit(1)).alias("page_count"))
    candidates = found.select("paper_id", F.col("detected_number").alias("test_number"))
    return V.structure_results(truth, found, candidates, papers)


@query("a28_structure_rows", "with " + STRUCTURE_SQL + """
    select paper_id, expected_markers, detected_markers, true_positives, detected_markers-true_positives false_positives, expected_markers-true_positives false_negatives, duplicate_markers,
      round(true_positives/cast(detected_markers as double),9) "precision", round(true_positives/cast(expected_markers as double),9) recall,
      round(case when located=0 then 0e0 else ok/cast(located as double) end,9) test_number_accuracy from res""")
def _(fx):
    r = structure_rows(fx)
    return r.select(
        "paper_id", "expected_markers", "detected_markers", "true_positives", "false_positives", "false_negatives", "duplicate_markers",
        F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("test_number_accuracy", 9).alias("test_number_accuracy"),
    )


A19_SQL = "with " + STRUCTURE_SQL + """
    select count(*) paper_count, cast(sum(expected_markers) as bigint) expected_markers, cast(sum(detected_markers) as bigint) detected_markers, cast(sum(true_positives) as bigint) true_positives,
      cast(sum(duplicate_markers) as bigint) duplicate_markers, round(sum(true_positives)/cast(sum(detected_markers) as double),9) "precision", round(sum(true_positives)/cast(sum(expected_markers) as double),9) recall,
      round(2*sum(true_positives)/cast(sum(detected_markers)+sum(expected_markers) as double),9) f1, round(avg(case when located=0 then 0e0 else ok/cast(located as double) end),9) mean_test_number_accuracy from res"""


@query("a19_structure_summary", A19_SQL)
def _(fx):
    s = V.structure_summary(structure_rows(fx))
    return s.select(
        "paper_count", "expected_markers", "detected_markers", "true_positives", "duplicate_markers",
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "mean_test_number_accuracy")],
    )


# Labels ---------------------------------------------------------------------------------------


@query("a20_record_fingerprints", "select event_id, sha256(record) fingerprint from fx_records")
def _(fx):
    return L.with_record(valid_saves(fx)).select("event_id", "fingerprint")


@query("a20_store_fingerprint", """
    with d as (select 'ds'||(cast(substr(sample_id,8) as int)%10) dataset_id, r.* from fx_records r where event_id in (select event_id from fx_current))
    select dataset_id, sha256('{"annotations":['||string_agg(record,',' order by sample_id)||'],"schema_version":"1.0"}') fingerprint, count(*) record_count from d group by 1""")
def _(fx):
    return P.canonical_fingerprint(labelled_records(fx), ["dataset_id"], "sample_id", "record")


def labelled_records(fx):
    current = L.with_record(L.current_labels(valid_saves(fx), ["ts", "event_id"]))
    return current.withColumn("dataset_id", F.concat(F.lit("ds"), (F.substring("sample_id", 8, 6).cast("int") % 10).cast("string")))


@query("a20_tree_fingerprint", """
    with h as (select source, substr(sha256(cast(doc_id as varchar)),1,10) a, doc_id, sha256(text) h from documents),
    t10 as (select source, a, sha256(string_agg(h,'' order by doc_id)) h from h group by 1, 2), t7 as (select source, substr(a,1,7) b, sha256(string_agg(h,'' order by a)) h from t10 group by 1, 2),
    t4 as (select source, substr(b,1,4) c, sha256(string_agg(h,'' order by b)) h from t7 group by 1, 2), t2 as (select source, substr(c,1,2) d, sha256(string_agg(h,'' order by c)) h from t4 group by 1, 2)
    select source, sha256(string_agg(h,'' order by d)) fingerprint from t2 group by 1""")
def _(fx):
    return P.tree_fingerprint(fx.table("documents").select("source", "doc_id", "text"), ["source"], "doc_id", "text")


@query("a21_label_provenance", """
    select 'ds'||(cast(substr(sample_id,8) as int)%10) dataset_id, count(*) annotation_count, count(*) filter (where evidence_type='printed') n_printed, count(*) filter (where evidence_type='student_candidate') n_student_candidate,
      count(*) filter (where evidence_type='teacher_candidate') n_teacher_candidate, count(*) filter (where evidence_type='unknown') n_unknown, count(*) filter (where not is_empty) samples_with_answer_regions,
      count(*) filter (where is_empty) verified_empty_count, count(*) filter (where not is_empty) human_answer_box_count from fx_current group by 1""")
def _(fx):
    return L.provenance(labelled_records(fx), ["dataset_id"])


@query("a22_corpus_fingerprint", """
    with h as (select substr(sha256(url),1,10) a, url, sha256(html) h from pages), t10 as (select a, sha256(string_agg(h,'' order by url)) h from h group by 1),
    t7 as (select substr(a,1,7) b, sha256(string_agg(h,'' order by a)) h from t10 group by 1), t4 as (select substr(b,1,4) c, sha256(string_agg(h,'' order by b)) h from t7 group by 1),
    t2 as (select substr(c,1,2) d, sha256(string_agg(h,'' order by c)) h from t4 group by 1)
    select 'corpus' corpus, sha256(string_agg(h,'' order by d)) fingerprint from t2""")
def _(fx):
    return P.tree_fingerprint(fx.table("pages").withColumn("corpus", F.lit("corpus")), ["corpus"], "url", "html", tie="page_id")


@query("a23_exact_duplicates", "select sha256(text) content_sha256, count(*) copies from documents group by 1 having count(*)>1")
def _(fx):
    return P.duplicate_content(fx.table("documents"), "text")


@query("a24_manifest_summary", """
    select o_orderstatus category, count(*) samples, count(distinct o_custkey) papers, count(distinct (o_custkey, o_orderdate)) pages, count(*) filter (where o_totalprice>100000) numbered, bool_and(o_totalprice>0) ready from orders group by 1""")
def _(fx):
    return fx.table("orders").groupBy(F.col("o_orderstatus").alias("category")).agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("o_custkey").alias("papers"), F.countDistinct("o_custkey", "o_orderdate").alias("pages"),
        F.count_if(F.col("o_totalprice") > 100000).alias("numbered"), F.bool_and(F.col("o_totalprice") > 0).alias("ready"),
    )


@query("a24_manifest_counts", """
    with s as (select l_linestatus dataset_id, concat('paper-',l_suppkey) paper_alias, l_linenumber page_number, case when l_quantity>10 then l_linenumber end test_number, lower(l_returnflag) category,
      case when l_tax>0 then list_value(concat('line-',l_linenumber), 'taxed') else list_value(concat('line-',l_linenumber)) end signals from lineitem)
    select dataset_id, 'samples' metric, '' "value", count(*) n from s group by 1 union all select dataset_id, 'numbered', '', count(*) from s where test_number is not null group by 1
    union all select dataset_id, 'distinct_papers', '', count(distinct paper_alias) from s group by 1 union all select dataset_id, 'distinct_pages', '', count(distinct (paper_alias, page_number)) from s group by 1
    union all select dataset_id, 'paper', paper_alias, count(*) from s group by 1,3 union all select dataset_id, 'category', category, count(*) from s group by 1,3
    union all select dataset_id, 'signal', g, count(*) from (select dataset_id, unnest(signals) g from s) group by 1,3""")
def _(fx):
    line = F.concat(F.lit("line-"), "l_linenumber")
    return O.manifest_counts(fx.table("lineitem").select(
        F.col("l_linestatus").alias("dataset_id"), F.concat(F.lit("paper-"), "l_suppkey").alias("paper_alias"), F.col("l_linenumber").alias("page_number"),
        F.when(F.col("l_quantity") > 10, F.col("l_linenumber")).alias("test_number"), F.array(F.lower("l_returnflag")).alias("categories"),
        F.when(F.col("l_tax") > 0, F.array(line, F.lit("taxed"))).otherwise(F.array(line)).alias("signals"),
    ))


@query("a25_sample_rows", f"with {_ROWS} select * replace (round(mean_positive_iou,9) as mean_positive_iou) from rows_")
def _(fx):
    return evaluation_rows(fx).select(
        "sample_id", "evidence_type", "predicted_class", "class_correct", "human_answer_boxes", "predicted_answer_boxes", "matched_answer_boxes_at_50",
        F.round("mean_positive_iou", 9).alias("mean_positive_iou"),
    )


@query("a26_sample_categories", "select l_orderkey, l_linenumber, l_suppkey, concat_ws(',', lower(l_returnflag), case when l_linenumber%3<>0 then 'detected_test' else 'no_detected_test' end, lower(l_linestatus)) categories from lineitem")
def _(fx):
    s = fx.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("test_number"),
        F.lower("l_returnflag").alias("discovery_category"), F.array(F.lower("l_linestatus")).alias("context_tags"),
    )
    return V.sample_categories(s).select("l_orderkey", "l_linenumber", "l_suppkey", F.array_join("categories", ",").alias("categories"))


@query("a27_progress", """
    with s as (select distinct concat('sample_', lpad(cast(user_id as varchar),6,'0')) sample_id from events)
    select count(c.evidence_type) completed, count(*) total, count(*) filter (where evidence_type='printed') n_printed, count(*) filter (where evidence_type='student_candidate') n_student_candidate,
      count(*) filter (where evidence_type='teacher_candidate') n_teacher_candidate, count(*) filter (where evidence_type='unknown') n_unknown, count(c.evidence_type)=count(*) ready
    from s left join fx_current c using (sample_id)""")
def _(fx):
    return L.progress(fx.label_samples(), L.current_labels(valid_saves(fx), ["ts", "event_id"]))


@query("a29_cross_class_errors", f"""with {_CELLS} select (select false_positives from metrics where evidence_type='student_candidate') student_false_positives, (select false_negatives from metrics where evidence_type='student_candidate') student_false_negatives,
      (select f1 is not null from metrics where evidence_type='teacher_candidate') teacher_metrics_defined, (select n from cells where human='teacher_candidate' and predicted='student_candidate') teacher_to_student_errors,
      (select n from cells where human='student_candidate' and predicted='teacher_candidate') student_to_teacher_errors""")
def _(fx):
    return V.cross_class_errors(label_cells(fx))


@query("a30_class_counts", f"with {CLASS_SQL} select page_id sample_id, evidence_type, count(*) n from classified group by all")
def _(fx):
    return E.classified(fx.feature_rows()).groupBy(F.col("page_id").alias("sample_id"), "evidence_type").agg(F.count(F.lit(1)).alias("n"))
