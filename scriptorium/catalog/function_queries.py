"""Scalar functions F1-F51 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog.registry import query
from scriptorium.catalog.sqltext import crop, inter, iou, smaller, unit
from scriptorium.functions import boxes as B
from scriptorium.functions import ids
from scriptorium.functions import scoring as S
from scriptorium.functions import text as T
from scriptorium.plans.overviews import page_picks

# Distinct characters of a pair are renamed to single bytes, because DuckDB's levenshtein
# compares bytes; whitespace is normalised as in the engine.
_NORMAL = """
    with n as (select doc_id, line_number, lang, source,
        trim(regexp_replace(nfc_normalize(ref_text),'[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+',' ','g')) r,
        trim(regexp_replace(nfc_normalize(pred_text),'[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+',' ','g')) p
      from fx_pairs),
    alphabet as (select string_agg(chr(cast(i as int)),'' order by i) letters from range(1,127) t(i)),
    v as (select n.*, letters, array_to_string(list_distinct(string_split(r||p,'')),'') vocabulary from n, alphabet),
    c as (select doc_id, line_number, lang, source, r, p,
        levenshtein(translate(r,vocabulary,substr(letters,1,length(vocabulary))),
                    translate(p,vocabulary,substr(letters,1,length(vocabulary)))) errors
      from v)
"""


def _normal_pairs(fx):
    return fx.pairs().select(
        "doc_id", "line_number", "lang", "source",
        T.normalize_metric(F.col("ref_text")).alias("r"), T.normalize_metric(F.col("pred_text")).alias("p"),
    )


@query("f1_ocr_normalisation", """
    with t as (select doc_id, concat(text, case doc_id%3 when 0 then '  ' || chr(13) || chr(10) when 1 then chr(9) || chr(13) || 'end ' else chr(10) || chr(10) end) t from documents)
    select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(t),'\\r\\n?',chr(10),'g'),'[ \\t]+(\\n|$)','\\1','g'),'^\\n+|\\n+$','','g')) digest
    from t""")
def _(fx):
    tail = (
        F.when(F.col("doc_id") % 3 == 0, "  \r\n").when(F.col("doc_id") % 3 == 1, "\t\rend ").otherwise("\n\n")
    )
    return fx.table("documents").select(
        "doc_id", F.md5(T.normalize_ocr(F.concat("text", tail)).cast("binary")).alias("digest")
    )


@query("f2_metric_normalisation", _NORMAL + "select doc_id, line_number, md5(r) digest, cast(length(r) as int) units from n")
def _(fx):
    return _normal_pairs(fx).select("doc_id", "line_number", F.md5(F.col("r").cast("binary")).alias("digest"), F.length("r").alias("units"))


@query("f3_char_edit_distance", _NORMAL + "select doc_id, line_number, cast(errors as int) errors from c")
def _(fx):
    return _normal_pairs(fx).select("doc_id", "line_number", T.char_distance(F.col("r"), F.col("p")).alias("errors"))


# Word distance: pairs with few shared words use single-byte codes, the rest a dynamic programme.
_WORD_SQL = _NORMAL + """,
    -- Words that both sides share get a number, all others can never match (0 / -1).
    w as (select doc_id, line_number, list_filter(string_split(r,' '), lambda q: q<>'') a, list_filter(string_split(p,' '), lambda q: q<>'') b from n),
    s as (select *, list_intersect(a,b) shared from w),
    z as (select doc_id, line_number, len(shared) k,
        list_transform(a, lambda q: cast(coalesce(list_position(shared,q),0) as int)) a,
        list_transform(b, lambda q: cast(case when list_position(shared,q)>0 then list_position(shared,q) else -1 end as int)) b from s),
    short as (select doc_id, line_number, levenshtein(
        array_to_string(list_transform(a, lambda q: chr(q+1)),''), array_to_string(list_transform(b, lambda q: chr(case when q<0 then 127 else q+1 end)),'')) errors
      from z where k<=120),
    -- Row-by-row dynamic programme; the left-to-right dependency is resolved by doubling.
    long as (select doc_id, line_number, list_reduce(list_prepend(range(0,len(b)+1)::int[], list_transform(a, lambda q: [q])),
        lambda prev, q, i: list_transform([list_transform(range(1,len(prev)+1), lambda j:
             case when j=1 then prev[1]+1 else least(prev[j]+1, prev[j-1]+(case when b[j-1]=q[1] then 0 else 1 end)) end)], lambda t0:
          list_transform([list_transform(range(1,len(t0)+1), lambda j: least(t0[j], case when j>1 then t0[j-1]+1 else t0[j] end))], lambda t1:
          list_transform([list_transform(range(1,len(t1)+1), lambda j: least(t1[j], case when j>2 then t1[j-2]+2 else t1[j] end))], lambda t2:
          list_transform([list_transform(range(1,len(t2)+1), lambda j: least(t2[j], case when j>4 then t2[j-4]+4 else t2[j] end))], lambda t3:
          list_transform([list_transform(range(1,len(t3)+1), lambda j: least(t3[j], case when j>8 then t3[j-8]+8 else t3[j] end))], lambda t4:
          list_transform([list_transform(range(1,len(t4)+1), lambda j: least(t4[j], case when j>16 then t4[j-16]+16 else t4[j] end))], lambda t5: t5)[1])[1])[1])[1])[1])[1]) d, len(b) m
      from z where k>120),
    word_errors as (select doc_id, line_number, cast(errors as int) errors from short
      union all select doc_id, line_number, cast(d[m+1] as int) from long)
"""


@query("f4_word_edit_distance", _WORD_SQL + "select doc_id, line_number, errors from word_errors")
def _(fx):
    left, right = T.words_of(F.col("r")), T.words_of(F.col("p"))
    return _normal_pairs(fx).select("doc_id", "line_number", T.word_distance(left, right).alias("errors"))


@query("f5_error_rate", _NORMAL + """
    select doc_id, line_number, cast(errors as int) errors, cast(length(r) as int) units,
      round(case when length(r)>0 then cast(errors as double)/length(r) when errors=0 then 0e0 end, 6) rate from c""")
def _(fx):
    e = T.error_struct(T.char_distance(F.col("r"), F.col("p")), F.length("r"))
    return _normal_pairs(fx).select("doc_id", "line_number", e.alias("e")).select(
        "doc_id", "line_number", F.col("e.errors").alias("errors"), F.col("e.reference_units").alias("units"),
        F.round("e.rate", 6).alias("rate"),
    )


@query("f6_cer", _NORMAL + """
    select lang, count(*) pairs, cast(sum(errors) as bigint) errors, cast(sum(length(r)) as bigint) units,
      round(avg(case when length(r)>0 then cast(errors as double)/length(r) when errors=0 then 0e0 end), 6) mean_cer from c group by lang""")
def _(fx):
    c = T.cer(F.col("r"), F.col("p"))
    return (
        _normal_pairs(fx).select("lang", c.alias("c")).groupBy("lang").agg(
            F.count(F.lit(1)).alias("pairs"), F.sum("c.errors").alias("errors"), F.sum("c.reference_units").alias("units"),
            F.round(F.avg("c.rate"), 6).alias("mean_cer"),
        )
    )


@query("f7_wer_units", _NORMAL + """
    select lang, cast(sum(len(list_filter(string_split(r,' '), lambda q: q<>''))) as bigint) units,
      count(*) filter (where len(list_filter(string_split(r,' '), lambda q: q<>''))=0) empty_references from n group by lang""")
def _(fx):
    w = T.wer(F.col("r"), F.col("p"))
    return _normal_pairs(fx).select("lang", w.alias("w")).groupBy("lang").agg(
        F.sum("w.reference_units").alias("units"), F.count_if(F.col("w.reference_units") == 0).alias("empty_references")
    )


# Marker tokens ------------------------------------------------------------------------------

_TOKENS = """
    with t as (select doc_id, k, kw, num, case when doc_id%4=0 then kw||num else kw end token from fx_headings),
    q as (select *, regexp_replace(token,'[^\\p{L}\\p{N}]','','g') clean from t),
    u as (select *, lower(regexp_extract(clean,'^(\\p{L}+)([^\\p{L}].*)$',1)) ckey, regexp_extract(clean,'^(\\p{L}+)([^\\p{L}].*)$',2) cnum from q)
"""


def _tokens(fx):
    return fx.headings().withColumn("token", F.when(F.col("doc_id") % 4 == 0, F.concat("kw", "num")).otherwise(F.col("kw")))


@query("f8_keyword_similarity", """
    with w as (select distinct regexp_replace(lower(text),'[^\\p{L}]','','g') v from fx_words)
    select v, round(case when length(v)=0 then 0e0 else greatest(0e0,1-cast(levenshtein(regexp_replace(v,'[^a-z]','#','g'),'test') as double)/greatest(length(v),4)) end, 9) similarity from w""")
def _(fx):
    v = fx.words().select(T.letters(F.col("text")).alias("v")).distinct()
    return v.select("v", F.round(T.keyword_similarity(F.col("v")), 9).alias("similarity"))


@query("f9_letters_token", """
    select paper_id, count(*) words, count(distinct regexp_replace(lower(text),'[^\\p{L}]','','g')) tokens,
      cast(sum(length(regexp_replace(lower(text),'[^\\p{L}]','','g'))) as bigint) letters from fx_words group by paper_id""")
def _(fx):
    v = T.letters(F.col("text"))
    return fx.words().groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("words"), F.countDistinct(v).alias("tokens"), F.sum(F.length(v)).alias("letters")
    )


@query("f10_number_token", """
    select v, count(*) n from (select regexp_replace(text,'[^\\p{L}\\p{N}]','','g') v from fx_words) where length(v) between 1 and 2 group by v""")
def _(fx):
    return fx.words().select(T.number_token(F.col("text")).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("f11_compact_split", _TOKENS + "select doc_id, k, nullif(ckey,'') keyword, nullif(cnum,'') number from u")
def _(fx):
    c = T.compact_split(F.col("token"))
    return _tokens(fx).select("doc_id", "k", c["keyword"].alias("keyword"), c["number"].alias("number"))


@query("f12_parse_number", """
    with t as (select doc_id, k, num, translate(num,'oOlI','0011') d from fx_headings),
    v as (select *, case when regexp_full_match(d,'[0-9]{1,2}') then cast(d as int) end n from t)
    select doc_id, k, case when n between 1 and 99 then n end test_number, case when regexp_full_match(num,'[0-9]+') then 1e0 else 0.8e0 end numeric_confidence from v""")
def _(fx):
    return fx.headings().select(
        "doc_id", "k", T.parse_number(F.col("num")).alias("test_number"), T.number_confidence(F.col("num")).alias("numeric_confidence")
    )


@query("f13_detection_strategy", _TOKENS + """
    select doc_id, k, case when key in ('lest','tesl','tost') then 'ocr_confusion' when key<>'test' then 'fuzzy_keyword'
      when not regexp_full_match(n,'[0-9]+') then 'ocr_confusion' when ckey<>'' then 'compact_token' else 'exact_tokens' end strategy
    from (select *, case when ckey<>'' then ckey else regexp_replace(lower(token),'[^\\p{L}]','','g') end key, case when ckey<>'' then cnum else num end n from u)""")
def _(fx):
    c = T.compact_split(F.col("token"))
    number = F.when(c.isNotNull(), c["number"]).otherwise(F.col("num"))
    keyword = F.coalesce(c["keyword"], T.letters(F.col("token")))
    return _tokens(fx).select(
        "doc_id", "k", T.detection_strategy(keyword, T.number_confidence(number), c.isNotNull()).alias("strategy")
    )


@query("f14_labels_and_file_names", """
    select doc_id, k, printf('Test %02d', true_number) label, printf('page_%04d.png', page_number) page_file,
      printf('sample_%03d.png', doc_id) sample_file, printf('evidence_v2_%03d', doc_id) sample_id from fx_headings""")
def _(fx):
    return fx.headings().select(
        "doc_id", "k", ids.test_label(F.col("true_number")).alias("label"), ids.page_file(F.col("page_number")).alias("page_file"),
        ids.sample_file(F.col("doc_id")).alias("sample_file"), ids.numbered("evidence_v2", F.col("doc_id")).alias("sample_id"),
    )


@query("f15_slug", """
    select page_id, nullif(lower(regexp_replace(regexp_replace(url,'[^a-zA-Z0-9._-]+','-','g'),'^[-.]+|[-.]+$','','g')),'') slug from pages""")
def _(fx):
    return fx.table("pages").select("page_id", ids.slug(F.col("url")).alias("slug"))


@query("f16_append_note", """
    with t as (select conv_id, turn, text, case when turn%2=0 then string_split(text,chr(10))[1] else role end note from conversations)
    select conv_id, turn, md5(case when list_contains(string_split(text,chr(10)),note) then text when length(text)=0 then note else text||chr(10)||note end) digest from t""")
def _(fx):
    note = F.when(F.col("turn") % 2 == 0, F.split("text", "\n")[0]).otherwise(F.col("role"))
    return fx.table("conversations").select("conv_id", "turn", F.md5(T.append_note(F.col("text"), note).cast("binary")).alias("digest"))


# Boxes --------------------------------------------------------------------------------------


def _box_query(name: str, sql_value: str, column, alias: str):
    @query(name, f"select sample_id, box_idx, {sql_value} {alias} from fx_numbered_boxes")
    def _(fx):
        return fx.boxes().select("sample_id", "box_idx", column().alias(alias))


H, P = "human_box", "predicted_box"
_box_query("f20_intersection_area", inter("h", "p"), lambda: B.intersection_area(H, P), "area")
_box_query("f21_iou", f"round({iou('h', 'p')},9)", lambda: F.round(B.iou(H, P), 9), "iou")
_box_query("f22_overlap_of_smaller", f"round({smaller('h', 'p')},9)", lambda: F.round(B.overlap_of_smaller(H, P), 9), "overlap")
_box_query("f23_contains", "px>=hx and py>=hy and px+pw<=hx+hw and py+ph<=hy+hh", lambda: B.contains(H, P), "inside")
_box_query(
    "f26_centre_distances",
    "round(sqrt(pow((hx+hw/2e0)-(px+pw/2e0),2)+pow((hy+hh/2e0)-(py+ph/2e0),2)),6)",
    lambda: F.round(B.centre_distance(H, P), 6), "distance",
)


@query("f20_intersection_box", """
    select sample_id, box_idx, greatest(hx,px) x, greatest(hy,py) y, least(hx+hw,px+pw)-greatest(hx,px) width, least(hy+hh,py+ph)-greatest(hy,py) height
    from fx_numbered_boxes where least(hx+hw,px+pw)>greatest(hx,px) and least(hy+hh,py+ph)>greatest(hy,py)""")
def _(fx):
    return fx.boxes().select("sample_id", "box_idx", B.intersection_box(H, P).alias("b")).where("b is not null").select("sample_id", "box_idx", "b.*")


@query("f24_expand_clipped", """
    select sample_id, box_idx, greatest(hx,px-18) x, greatest(hy,py-18) y, least(hx+hw,px+pw+18)-greatest(hx,px-18) width,
      least(hy+hh,py+ph+18)-greatest(hy,py-18) height from fx_numbered_boxes""")
def _(fx):
    return fx.boxes().select("sample_id", "box_idx", B.expand(P, H, 18).alias("b")).select("sample_id", "box_idx", "b.*")


for _name, _bounded, _fn in (("f25_context_crop", False, B.context_crop), ("f25_bounded_crop", True, B.bounded_crop)):
    _c = crop("hx*3", "hy", "hw*4", "hh*9", _bounded)

    def _crop_query(name, c, fn):
        @query(name, f"select sample_id, box_idx, {c['x']} x, {c['y']} y, {c['w']} width, {c['h']} height from fx_numbered_boxes")
        def _(fx):
            wide = B.box(F.col("human_box.x") * 3, F.col("human_box.y"), F.col("human_box.width") * 4, F.col("human_box.height") * 9)
            return fx.boxes().withColumn("wide", wide).select(
                "sample_id", "box_idx", fn("wide", F.lit(1000), F.lit(1400)).alias("b")
            ).select("sample_id", "box_idx", "b.*")

    _crop_query(_name, _c, _fn)


@query("f27_margins", f"""
    select sample_id, box_idx, case when hx<=1000*0.08e0 or hx+hw>=1000*0.92e0 then 1e0 else 0e0 end flag,
      round({unit("(1-least(hx+hw/2e0,1000-(hx+hw/2e0))/(1000*0.5e0))")},9) proximity from fx_numbered_boxes""")
def _(fx):
    page = F.lit(1000)
    return fx.boxes().select(
        "sample_id", "box_idx", B.touches_margin(H, page).alias("flag"), F.round(B.margin_proximity(H, page), 9).alias("proximity")
    )


@query("f28_clamp", f"select l_orderkey, l_linenumber, round(l_extendedprice,2) price, round({unit('(l_extendedprice/50000-0.5e0)')},9) clamped from lineitem")
def _(fx):
    return fx.table("lineitem").select(
        "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), F.round(B.unit(F.col("l_extendedprice") / 50000 - 0.5), 9).alias("clamped")
    )


@query("f29_crop_relative", """
    select sample_id, box_idx, px-hx x, py-hy y, px-hx>=0 and py-hy>=0 and px-hx+pw<=hw and py-hy+ph<=hh inside from fx_numbered_boxes""")
def _(fx):
    r = B.crop_relative(P, H)
    return fx.boxes().select(
        "sample_id", "box_idx", r["x"].alias("x"), r["y"].alias("y"), B.contains(H, P).alias("inside")
    )


@query("f30_page_picks", """
    with n as (select l_orderkey, count(*) pages from lineitem group by 1),
    f as (select l_orderkey, pages, unnest([0.15e0,0.40e0,0.65e0,0.88e0]) f from n)
    select distinct l_orderkey, cast(greatest(0,least(pages-1,round_even((pages-1)*f,0)))+1 as int) page_number from f""")
def _(fx):
    n = fx.table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pages"))
    return n.select("l_orderkey", F.explode(page_picks(F.col("pages"))).alias("p")).select("l_orderkey", (F.col("p") + 1).cast("int").alias("page_number"))


@query("f31_metric_delta", """
    select l_orderkey, l_linenumber, l_suppkey, case when l_tax=0 then null else l_discount end - case when l_quantity>45 then null else l_tax end delta
    from lineitem""")
def _(fx):
    variant = F.when(F.col("l_tax") != 0, F.col("l_discount"))
    baseline = F.when(F.col("l_quantity") <= 45, F.col("l_tax"))
    return fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (variant - baseline).alias("delta"))


# Rule scores --------------------------------------------------------------------------------

_GEO = "((case when k+1<=3 then 1e0 else 0.45e0 end)+(case when x<=1000*0.7e0 then 1e0 else 0.5e0 end)+(case when y>=760*0.92e0 then 0.1e0 else 1e0 end))/3e0"


@query("f40_marker_geometry", f"select doc_id, k, round({_GEO},9) geometry from fx_headings")
def _(fx):
    g = S.marker_geometry(F.col("k") + 1, F.col("x"), F.col("y"), F.lit(1000), F.lit(760))
    return fx.headings().select("doc_id", "k", F.round(g, 9).alias("geometry"))


@query("f41_marker_confidence", f"""
    select doc_id, k, round(least(1e0,(0.35e0*(1-conf/400e0)+0.2e0*(case when doc_id%5=0 then 0.8e0 else 1e0 end)+0.2e0*coalesce(case when conf%7=0 then null else conf/100e0 end,0.5e0)+0.25e0*({_GEO}))
      *(case when doc_id%3=0 then 0.65e0 else 1e0 end)*(case when y>=760*0.92e0 then 0.55e0 else 1e0 end)),9) confidence from fx_headings""")
def _(fx):
    ocr = F.when(F.col("conf") % 7 != 0, F.col("conf") / 100.0)
    c = S.marker_confidence(
        1 - F.col("conf") / 400.0, F.when(F.col("doc_id") % 5 == 0, 0.8).otherwise(1.0), ocr,
        S.marker_geometry(F.col("k") + 1, F.col("x"), F.col("y"), F.lit(1000), F.lit(760)),
        F.col("doc_id") % 3 == 0, F.col("y"), F.lit(760),
    )
    return fx.headings().select("doc_id", "k", F.round(c, 9).alias("confidence"))


def class_sql(source: str, irregular: str) -> str:
    """CTEs scored, supported and classified over ``source``."""
    ts = unit("(0.50e0*red+0.20e0*sat+0.20e0*isolation+0.10e0*margin)")
    ps = unit("(0.35e0*coalesce(ocr_conf,0e0)+0.30e0*regularity+0.20e0*density+0.15e0*(1-sat))")
    ss = unit(f"(0.40e0*{irregular}+0.20e0*fragmentation+0.20e0*blue+0.10e0*edge+0.10e0*dark)")
    return f"""
    scored as (select *, {irregular} irr, {ts} ts, {ps} ps, {ss} ss from {source}),
    supported as (select *,
        red>=0.30e0 and sat>=0.25e0 and (isolation>=0.65e0 or margin>=1e0) and ts>=0.58e0 t,
        coalesce(ocr_conf>=0.72e0 and regularity>=0.68e0 and density>=0.10e0 and red<0.18e0 and blue<0.18e0 and ps>=0.62e0, false) p,
        irr>=0.52e0 and (blue>=0.12e0 or fragmentation>=0.55e0 or (dark>=0.08e0 and components>=4)) and red<0.30e0 and ss>=0.42e0 s
      from scored),
    classified as (select *, case when t::int+p::int+s::int<>1 then 'unknown' when t then 'teacher_candidate' when p then 'printed' else 'student_candidate' end evidence_type,
        case when t::int+p::int+s::int<>1 then {unit("(1-greatest(ts,ps,ss))")} when t then ts when p then ps else ss end confidence from supported)
"""


CLASS_SQL = class_sql("fx_evidence", "((irregularity+irregularity+fragmentation)/3e0)")


@query("f42_evidence_scores", f"with {CLASS_SQL} select l_orderkey, l_linenumber, round(ts,9) teacher, round(ps,9) printed, round(ss,9) student from scored")
def _(fx):
    return fx.feature_rows().select(
        "l_orderkey", "l_linenumber",
        F.round(S.teacher_score("ink", "geometry"), 9).alias("teacher"),
        F.round(S.printed_score("ink", "geometry", F.col("ocr_confidence")), 9).alias("printed"),
        F.round(S.student_score("ink", "geometry"), 9).alias("student"),
    )


@query("f43_evidence_class", f"with {CLASS_SQL} select l_orderkey, l_linenumber, evidence_type, round(confidence,9) confidence from classified")
def _(fx):
    c = S.classify("ink", "geometry", F.col("ocr_confidence"))
    return fx.feature_rows().select("l_orderkey", "l_linenumber", c.alias("c")).select(
        "l_orderkey", "l_linenumber", F.col("c.evidence_type").alias("evidence_type"), F.round("c.confidence", 9).alias("confidence")
    )


@query("f44_evidence_signals", """
    select l_orderkey, l_linenumber, concat_ws(',', case when ocr_conf>=0.72e0 then 'high_ocr_confidence' when ocr_conf<=0.45e0 then 'low_ocr_confidence' end,
      case when regularity>=0.68e0 then 'regular_geometry' end, case when irregularity>=0.52e0 then 'irregular_baseline' end,
      case when irregularity>=0.52e0 then 'irregular_height' end, case when fragmentation>=0.52e0 then 'irregular_spacing' end,
      case when density>=0.20e0 then 'dense_text' end, case when fragmentation>=0.55e0 then 'fragmented_strokes' end,
      case when sat>=0.25e0 then 'chromatic_ink' end, case when red>=0.30e0 then 'red_ink_dominant' end,
      case when blue>=0.12e0 then 'blue_ink_dominant' end, case when isolation>=0.65e0 then 'isolated_mark' end,
      case when margin>=1e0 then 'margin_position' end, case when edge>=0.30e0 then 'high_local_contrast' end) signals from fx_evidence""")
def _(fx):
    return fx.feature_rows().select(
        "l_orderkey", "l_linenumber", F.array_join(S.evidence_signals("ink", "geometry", F.col("ocr_confidence")), ",").alias("signals")
    )


# Mark risk: features straight from the component columns, word context from l_* arithmetic.
_PROX = unit("(1-least(x+width/2e0,1000-(x+width/2e0))/(1000*0.5e0))")
def mark_sql(source: str) -> str:
    """CTEs m, f, g: signals and category; ``source`` adds nearby, ocr_prox and conf_near."""
    return f"""
    m as (select *, least(1e0,greatest(1e0,contour_area)/(1000e0*1400)) area_ratio, {_PROX} margin_prox, width/cast(height as double) aspect,
        chroma>=0.08e0 or saturation>=0.10e0 is_chroma from {source}),
    f as (select *, list_distinct_ordered from (select *, list_filter([
        case when is_chroma then 'chromatic_ink' end,
        case when area_ratio<=0.0015e0 and whitespace>=0.45e0 then 'small_isolated_component' end,
        case when margin_prox>=0.58e0 or y<=1400*0.12e0 or y+height>=1400*0.88e0 then 'margin_activity' end,
        case when area_ratio<=0.001e0 and aspect between 0.25e0 and 4e0 and (margin_prox>=0.35e0 or ocr_prox>=0.45e0) then 'score_like_geometry' end,
        case when angled>=2 and edge>=0.04e0 then 'tick_cross_geometry' end,
        case when aspect>=3.5e0 or angled>=3 then 'correction_stroke_risk' end,
        case when nearby>0 then 'ocr_context_nearby' end,
        case when conf_near then 'high_confidence_print_nearby' end,
        case when is_chroma and nearby>0 then 'student_teacher_mixed_risk' end,
        case when is_chroma and conf_near then 'print_teacher_mixed_risk' end,
        case when nearby>=8 then 'paragraph_teacher_risk' end,
        case when nearby between 1 and 4 then 'short_answer_teacher_risk' end], lambda v: v is not null) list_distinct_ordered from m)),
    g as (select *, list_sort(list_distinct_ordered) sorted_signals, len(list_distinct_ordered) n_signals,
        case when list_has_any(list_distinct_ordered,['student_teacher_mixed_risk','print_teacher_mixed_risk']) then 'mixed_teacher_context_risk'
          when list_has_any(list_distinct_ordered,['tick_cross_geometry','correction_stroke_risk']) then 'tick_cross_correction_risk'
          when list_has_any(list_distinct_ordered,['margin_activity','score_like_geometry']) then 'margin_score_risk'
          when list_has_any(list_distinct_ordered,['chromatic_ink']) then 'chromatic_ink_risk' else 'ambiguous_mark_risk' end category from f)
"""


MARK_SQL = """
    q as (select *, cast(component_no%11 as int) nearby, (component_no%11)/20e0 ocr_prox, component_no%11>=6 conf_near from fx_components),""" + mark_sql("q")


def mark_rows(fx):
    near = (F.col("component_no") % 11).cast("int")
    features = F.struct(
        F.least(F.lit(1.0), F.greatest(F.lit(1.0), F.col("contour_area")) / (F.lit(1000.0) * 1400)).alias("component_area_ratio"),
        "chromatic_foreground_ratio", "mean_saturation", "edge_density", "local_whitespace_ratio", "angled_line_count",
        B.margin_proximity("component", F.lit(1000)).alias("margin_proximity"),
        (near / 20.0).alias("ocr_proximity"),
    )
    return (
        fx.components().withColumn("features", features)
        .withColumn("signals", S.mark_risk_signals("component", "features", near, near >= 6, F.lit(1400)))
        .withColumn("category", S.mark_risk_category(F.col("signals")))
        .withColumn("risk", S.mark_risk_score(F.col("category"), F.col("signals"), "features"))
    )


@query("f45_mark_risk_signals", f"with {MARK_SQL} select paper_id, page_number, component_no, array_to_string(sorted_signals,',') signals from g")
def _(fx):
    return mark_rows(fx).select("paper_id", "page_number", "component_no", F.array_join(F.array_sort("signals"), ",").alias("signals"))


@query("f46_mark_risk_category", f"with {MARK_SQL} select paper_id, page_number, component_no, category from g")
def _(fx):
    return mark_rows(fx).select("paper_id", "page_number", "component_no", "category")


@query("f47_mark_risk_score", f"""with {MARK_SQL} select paper_id, page_number, component_no, round(least(1e0,
      case category when 'mixed_teacher_context_risk' then 0.22e0 when 'tick_cross_correction_risk' then 0.18e0 when 'margin_score_risk' then 0.16e0
        when 'chromatic_ink_risk' then 0.14e0 else 0.08e0 end + least(0.35e0,n_signals*0.055e0) + 0.12e0*chroma + 0.10e0*margin_prox + 0.08e0*least(1e0,angled/4e0)),9) score from g""")
def _(fx):
    return mark_rows(fx).select("paper_id", "page_number", "component_no", F.round("risk", 9).alias("score"))


@query("f48_line_scores", """
    with l as (select paper_id, page_number, coalesce(nullif(block_number,0),y+1) b, coalesce(nullif(paragraph_number,0),1) p, coalesce(nullif(line_number,0),y+1) l,
        count(*) n, avg(confidence) c, stddev_pop(height) s from fx_words group by all)
    select paper_id, page_number, b key_block, p key_paragraph, l key_line, round(coalesce(c,0e0)*least(1e0,n/6e0),9) printed_score,
      round(0.65e0*(1-coalesce(c,0.5e0))+0.35e0*(case when n<2 then 0e0 else least(1e0,s/20e0) end),9) irregular_score from l""")
def _(fx):
    from scriptorium.plans.sampling import scored_lines

    return scored_lines(fx.words()).select(
        "paper_id", "page_number", "key_block", "key_paragraph", "key_line",
        F.round("printed_score", 9).alias("printed_score"), F.round("irregular_score", 9).alias("irregular_score"),
    )


@query("f49_component_geometry", """
    select paper_id, page_number, component_no, 0e0 regularity, 0.5e0 baseline_irregularity, whitespace line_density, least(1e0,angled/6e0) fragmentation, 1e0 isolation,
      case when x<=1000*0.08e0 or x+width>=1000*0.92e0 then 1e0 else 0e0 end margin_position, cast(0 as int) word_count_in_line from fx_components""")
def _(fx):
    ink = F.struct(F.col("local_whitespace_ratio").alias("foreground_ratio"), F.col("angled_line_count").alias("connected_component_count"))
    g = fx.components().withColumn("ink", ink).withColumn("g", S.component_geometry("component", F.lit(1000), "ink"))
    return g.select(
        "paper_id", "page_number", "component_no", "g.regularity", "g.baseline_irregularity", "g.line_density", "g.fragmentation",
        "g.isolation", "g.margin_position", "g.word_count_in_line",
    )


@query("f50_context_tags", """
    select l_orderkey, l_linenumber, l_suppkey, concat_ws(',', case when l_quantity>=8 then 'paragraph' else 'short_answer' end,
      case when l_partkey%1000<1000*0.12e0 then 'margin_region' end) tags from lineitem""")
def _(fx):
    tags = S.context_tags(S.line_tag(F.col("l_quantity")), F.col("l_partkey") % 1000, F.lit(1000))
    return fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.array_join(tags, ",").alias("tags"))


@query("f51_sequence_support", "select doc_id, k, case true_number-k when 1 then 1e0 when 2 then 0.7e0 else 0.4e0 end support from fx_headings")
def _(fx):
    return fx.headings().select("doc_id", "k", S.sequence_support(F.col("true_number") - F.col("k")).alias("support"))


