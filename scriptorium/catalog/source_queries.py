"""Scans, sources and sinks S1-S21 over the given tables and files derived from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.catalog.registry import query
from scriptorium.functions import ids
from scriptorium.functions import boxes as B
from scriptorium.operators import entities as EN
from scriptorium.operators import rules as RU
from scriptorium.operators.joins import status_compare
from scriptorium.session import checkpoint_dir
from scriptorium.sources import inventory as I
from scriptorium.sources import manifests as M
from scriptorium.sources import sinks as K
from scriptorium.sources import words as W


def scratch(fx) -> str:
    return f"{checkpoint_dir(fx.spark)}/scratch-{uuid.uuid4().hex}"


@query("s1_file_inventory")
def _(fx):
    return I.file_inventory(fx.spark, fx.sf_dir, "*.parquet").select("filename", "size_bytes")


def crawled_files(fx):
    """Web pages seen as candidate files, with parser facts from column arithmetic."""
    p = F.col("page_id")
    return fx.table("pages").select(
        "page_id", "url",
        F.concat(F.lit("file_"), p.cast("string"), F.when(p % 11 == 0, ".txt").when(p % 2 == 0, ".PDF").otherwise(".pdf")).alias("filename"),
        (p % 13 != 0).alias("is_regular_file"), F.when(p % 17 == 0, 0).otherwise(F.length("html")).cast("long").alias("size_bytes"),
        (p % 19 != 0).alias("is_pdf"), (p % 23 == 0).alias("encrypted"), (p % 130).cast("int").alias("page_count"),
    )


@query("s2_admission", """
    with f as (select page_id, page_id%11<>0 ext, page_id%13<>0 reg, case when page_id%17=0 then 0 else length(html) end size, page_id%19<>0 and page_id%23<>0 readable, page_id%130 pages from pages)
    select page_id, case when not ext then 'extension' when not reg then 'exists' when size=0 then 'not_empty' when size>2000 then 'size_limit' when not readable then 'readable'
      when pages<1 then 'has_pages' when pages>100 then 'page_limit' end reject_reason from f""")
def _(fx):
    accepted, rejected = I.admit(crawled_files(fx), max_bytes=2000)
    return accepted.select("page_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(rejected.select("page_id", "reject_reason"))


@query("s3_content_fingerprint", "select doc_id, sha256(text) sha256 from documents")
def _(fx):
    return fx.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("s4_document_records", """
    with u as (select page_id, sha256(html) sha, length(html) size, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')||encode('corpus/'||sha256(html))) d from pages)
    select page_id, substr(d,1,8)||'-'||substr(d,9,4)||'-5'||substr(d,14,3)||'-'||substr('89ab',1+(strpos('0123456789abcdef',substr(d,17,1))-1)%4,1)||substr(d,18,3)||'-'||substr(d,21,12) paper_id, sha sha256, cast(size as bigint) size_bytes from u""")
def _(fx):
    files = fx.table("pages").select(F.col("url").alias("path"), F.col("page_id").cast("string").alias("filename"), F.lit(1).alias("page_count"), F.length("html").cast("long").alias("size_bytes"), "page_id")
    hashes = fx.table("pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"), F.col("page_id").alias("pid"))
    records = I.document_records(files.withColumn("path", F.col("page_id").cast("string")), hashes.withColumn("path", F.col("pid").cast("string")), "corpus/")
    return records.select(F.col("filename").cast("long").alias("page_id"), "paper_id", "sha256", "size_bytes")


@query("s5_uuid5", """
    with u as (select c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')||encode(c_name)) d from customer)
    select c_custkey, substr(d,1,8)||'-'||substr(d,9,4)||'-5'||substr(d,14,3)||'-'||substr('89ab',1+(strpos('0123456789abcdef',substr(d,17,1))-1)%4,1)||substr(d,18,3)||'-'||substr(d,21,12) id from u""")
def _(fx):
    return fx.table("customer").select("c_custkey", ids.uuid5(F.col("c_name")).alias("id"))


@query("s6_page_expansion", """
    with o as (select l_orderkey paper_id, count(*) pages from lineitem group by 1), e as (select paper_id, unnest(range(1,pages+1)) n from o)
    select paper_id, cast(n as int) page_number, 'run/'||paper_id||'/pages/'||printf('page_%04d.png', n) image_path from e""")
def _(fx):
    papers = fx.table("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("paper_id")).agg(F.count(F.lit(1)).alias("page_count"))
    return I.expand_pages(papers, "run/").select(F.col("paper_id").cast("long").alias("paper_id"), "page_number", "image_path")


@query("s7_tool_reports", """
    select l_orderkey, l_linenumber, l_suppkey, l_linenumber page, cast(l_partkey%3000 as int) width, cast(l_suppkey*9 as int) height, case when l_returnflag='A' then 'jpeg' else 'ccitt' end encoding, cast(300 as int) x_ppi, cast(l_quantity as int) y_ppi from lineitem""")
def _(fx):
    line = F.format_string(
        "  %d  0 image %d %d gray 1 8 %s no 7 0 %d %d  12K 5%%", F.col("l_linenumber"), F.col("l_partkey") % 3000, F.col("l_suppkey") * 9,
        F.when(F.col("l_returnflag") == "A", "jpeg").otherwise("ccitt"), F.lit(300), F.col("l_quantity").cast("int"),
    )
    reports = fx.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.explode(F.array(F.lit("page   num  type   width height color comp bpc  enc interp  object ID x-ppi y-ppi size ratio"), F.lit("-----"), line)).alias("line"),
    )
    return I.parse_image_table(reports)


# A report of four lines per document: values with further colons, blanks, and a line without a colon.
@query("s7_key_values", """
    with r as (select doc_id, unnest([concat('Title:          ',source,': ',lang), concat('Pages:  ',n_chars), concat(' Encrypted :yes (print:no) ',text), 'no report', concat('Tagged:')]) line from documents)
    select doc_id, trim(line[:strpos(line,':')-1], ' ') "key", md5(trim(line[strpos(line,':')+1:], ' ')) digest from r where strpos(line,':')>0""")
def _(fx):
    report = F.array(
        F.concat(F.lit("Title:          "), F.coalesce("source", F.lit("")), F.lit(": "), F.coalesce("lang", F.lit(""))), F.concat(F.lit("Pages:  "), F.coalesce(F.col("n_chars").cast("string"), F.lit(""))),
        F.concat(F.lit(" Encrypted :yes (print:no) "), F.coalesce("text", F.lit(""))), F.lit("no report"), F.lit("Tagged:"),
    )
    kv = I.parse_key_values(fx.table("documents").select("doc_id", F.explode(report).alias("line")))
    return kv.select("doc_id", "key", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("s8_manifest_scan", """
    select o_orderkey, l_linenumber page_number, 'sample_'||l_suppkey sample_id, cast(l_partkey as int) region_x from orders join lineitem on o_orderkey=l_orderkey where o_orderkey%29<>0""")
def _(fx):
    samples = fx.table("lineitem").groupBy("l_orderkey").agg(
        F.collect_list(
            F.struct(
                F.concat(F.lit("sample_"), F.col("l_suppkey").cast("string")).alias("sample_id"), F.lit("paper-a").alias("paper_alias"), F.col("l_linenumber").alias("page_number"),
                F.struct(F.col("l_partkey").cast("int").alias("x"), F.lit(1).alias("y"), F.lit(5).alias("width"), F.lit(5).alias("height")).alias("region"),
            )
        ).alias("samples")
    )
    text = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "samples"))
    broken = F.when(F.col("l_orderkey") % 29 == 0, F.concat(F.lit("{"), text)).otherwise(text)
    documents = fx.table("orders").select(F.col("o_orderkey").alias("l_orderkey")).join(samples, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), broken.alias("text"))
    rows, _corrupt = M.parse_manifest(documents, "text", "ocr")
    return rows.select("o_orderkey", "page_number", "sample_id", F.col("region.x").alias("region_x"))


@query("s9_rule_violations", """
    select l_orderkey, l_linenumber, l_suppkey, unnest(list_filter([case when not (l_quantity>5) then 'quantity' end, case when not (l_discount<=0.08e0) then 'discount' end,
      case when not (l_tax>0 or l_returnflag<>'A') then 'state' end, case when not regexp_full_match(l_linestatus,'[FX]') then 'status_pattern' end], lambda v: v is not null)) "rule" from lineitem""")
def _(fx):
    return RU.check_rules(
        fx.table("lineitem"), ["l_orderkey", "l_linenumber", "l_suppkey"],
        {"quantity": F.col("l_quantity") > 5, "discount": F.col("l_discount") <= 0.08, "state": (F.col("l_tax") > 0) | (F.col("l_returnflag") != "A"), "status_pattern": F.col("l_linestatus").rlike("^[FX]$")},
    )


@query("s9_entity_rules", """
    with c as (select 'c'||conv_id||'_'||turn sample_id, turn, role, conv_id%3 st, case when conv_id%3=0 and turn%2=1 then null when conv_id%3=2 and turn%2=0 then '' else text end body from conversations),
    l as (select l_orderkey||'-'||l_linenumber sample_id, l_linenumber%2=0 ok, case when l_quantity%7<>0 then 'x' end prediction, case when l_partkey%11=0 then 'e' end error from lineitem)
    select 'ocr_sample' entity, sample_id, unnest(list_filter([case when turn<=0 then 'positive_page' end, case when turn*10+50>100 then 'region_inside_page' end, case when not regexp_matches(role, '^[a-z0-9][a-z0-9_-]{2,63}$') then 'safe_categories' end,
      case when st=0 and body is not null then 'pending_state' end, case when st=1 and (body is null or regexp_matches(body,'^\\s*$')) then 'verified_state' end, case when st=2 and body<>'' then 'verified_empty_state' end], lambda v: v is not null)) "rule" from c
    union all select 'ocr_sample', sample_id, 'unique_id' from c group by sample_id having count(*)>1
    union all select 'ocr_result', sample_id, case when ok then 'success_state' else 'failure_state' end from l where case when ok then prediction is null or error is not null else error is null or prediction is not null end
    union all select 'ocr_result', sample_id, 'unique_id' from l group by sample_id having count(*)>1""")
def _(fx):
    c, state, odd = fx.table("conversations"), F.col("conv_id") % 3, F.col("turn") % 2
    number = lambda v: F.lit(v)
    samples = c.select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("sample_id"), F.lit("paper-a").alias("paper_alias"), F.col("turn").alias("page_number"), number(100).alias("page_width"), number(200).alias("page_height"),
        F.array("role").alias("categories"), B.box(F.col("turn") * 10, number(0), number(50), number(50)).alias("region"),
        F.when(state == 0, "pending").when(state == 1, "verified").otherwise("verified_empty").alias("ground_truth_status"),
        F.when((state == 0) & (odd == 1), None).when((state == 2) & (odd == 0), "").otherwise(F.col("text")).alias("ground_truth_text"),
    )
    ok, said = F.col("l_linenumber") % 2 == 0, F.col("l_quantity") % 7 != 0
    results = fx.table("lineitem").select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("sample_id"), F.when(ok, "success").otherwise("failure").alias("status"), F.when(said, "x").alias("prediction"), F.when(ok, 0.5).alias("cer"), F.when(ok, 0.5).alias("wer"),
        F.when(ok, F.col("l_extendedprice")).alias("duration_ms"), F.when(F.col("l_partkey") % 11 == 0, "e").alias("error"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("preprocessing"),
    )
    out = [EN.violations(df, entity).select(F.lit(entity.name).alias("entity"), "sample_id", "rule") for df, entity in ((samples, EN.ocr_sample()), (results, EN.ocr_result()))]
    return out[0].unionByName(out[1])


@query("s9_unique_and_sorted_ids", """
    with u as (select l_orderkey, l_linenumber from lineitem group by all having count(*)>1),
    o as (select o_custkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) p from orders)
    select 'unique_id' "rule", count(*) violations from u union all select 'sorted_ids', count(*) from o where o_totalprice<p""")
def _(fx):
    unique = RU.unique_violations(fx.table("lineitem"), ["l_orderkey", "l_linenumber"]).select("rule")
    order = RU.order_violations(fx.table("orders"), ["o_custkey"], "o_orderkey", "o_totalprice").select("rule")
    return unique.union(order).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def packed_words(fx):
    """Words re-packed into ten parallel string arrays per line, as a recogniser delivers them."""
    n = F.col("doc_id") + F.col("line_number")
    tokens = F.split("line", " ")

    def per_word(expression):
        return F.transform(tokens, lambda w, i: expression(w, i).cast("string"))

    lefts = per_word(lambda w, i: 40 + (i * 70) % 900)
    lefts = F.when(n % 31 == 0, F.slice(lefts, 2, 100000)).otherwise(lefts)
    tops = per_word(lambda w, i: F.when(n % 37 == 0, F.lit("10.5")).otherwise((F.col("line_number") * 45).cast("string")))
    return fx.lines().select(
        "doc_id", F.col("line_number").alias("line_key"), tokens.alias("text"),
        per_word(lambda w, i: (n + i) % 104 - 2).alias("conf"), lefts.alias("left"), tops.alias("top"),
        per_word(lambda w, i: F.length(w) * 10 + 1).alias("width"), per_word(lambda w, i: F.lit(30)).alias("height"),
        per_word(lambda w, i: n % 3).alias("block_num"), per_word(lambda w, i: F.lit(1)).alias("par_num"),
        per_word(lambda w, i: F.col("line_number")).alias("line_num"), per_word(lambda w, i: i + 1).alias("word_num"),
    )


@query("s10_word_ingest", """
    with t as (select doc_id, line_number, generate_subscripts(w,1) p, unnest(w) word from (select doc_id, line_number, string_split(line,' ') w from fx_lines)),
    k as (select *, doc_id+line_number n from t where trim(word)<>'')
    select doc_id, line_number, cast(row_number() over (partition by doc_id, line_number order by p)-1 as int) word_index, md5(word) digest,
      case when (n+p-1)%104-2 between 0 and 100 then ((n+p-1)%104-2)/100e0 end confidence, cast(40+((p-1)*70)%900 as int) x, cast(line_number*45 as int) y, cast(length(word)*10+1 as int) width,
      cast(nullif(n%3,0) as int) block_number, cast(p as int) word_number from k where n%31<>0 and n%37<>0""")
def _(fx):
    words, _rejected = W.ingest_word_arrays(packed_words(fx), ["doc_id", "line_key"])
    return words.select(
        "doc_id", F.col("line_key").alias("line_number"), "word_index", F.md5(F.col("text").cast("binary")).alias("digest"), "confidence", "x", "y", "width", "block_number", "word_number"
    )


@query("s10_rejected_pages", """
    with t as (select doc_id, line_number, len(list_filter(string_split(line,' '), lambda w: trim(w)<>'')) n from fx_lines)
    select doc_id, line_number, case when (doc_id+line_number)%31=0 then 'misaligned_arrays' else 'non_integral_number' end reject_reason from t
    where (doc_id+line_number)%31=0 or ((doc_id+line_number)%37=0 and n>0)""")
def _(fx):
    return W.ingest_word_arrays(packed_words(fx), ["doc_id", "line_key"])[1].withColumnRenamed("line_key", "line_number")


@query("s11_page_extractor", """
    select doc_id, case when n_chars%13=0 then 'failure' else 'success' end status, case when n_chars%13<>0 then md5(upper(lang)||':'||n_chars) end digest, case when n_chars%13=0 then 'unreadable page '||doc_id end error from documents""")
def _(fx):
    def prepare(row):
        return {**row, "lang": row["lang"].upper()}

    def read(row):
        if row["n_chars"] % 13 == 0:
            raise ValueError(f"unreadable page {row['doc_id']}")
        return {"raw_text": f"{row['lang']}:{row['n_chars']}", "confidence": 0.5}

    pages = fx.table("documents").select("doc_id", "lang", "n_chars")
    out = W.extract_pages(pages, read, keys=["doc_id"], provider="counter", model_version="1", steps=[prepare])
    return out.select("doc_id", "status", F.md5(F.col("raw_text").cast("binary")).alias("digest"), "error")


def worksheet_samples(fx):
    p = F.col("turn") + 1
    return fx.table("conversations").select(
        "conv_id", p.cast("int").alias("position"), F.concat(F.lit("sample_"), F.col("turn").cast("string")).alias("sample_id"), F.lit("paper-a").alias("paper_alias"),
        F.col("turn").alias("page_number"), F.col("role").alias("difficulty"), F.array(F.lit("x"), F.col("role")).alias("categories"), (F.col("turn") % 2 == 0).alias("teacher_annotations_present"),
        F.when(F.col("turn") % 3 != 0, F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.col("turn").cast("int").alias("width"), F.lit(4).alias("height"))).alias("region"),
        F.lit(7).alias("test_number"), "text",
    )


@query("s12_worksheet_parse", """
    select conv_id, turn, 'sample_'||turn sample_id, md5(regexp_replace(text,'\\n+$','')) digest from conversations""")
def _(fx):
    s = worksheet_samples(fx)
    section = F.concat(M.transcription_section(), F.col("text"), F.lit("\n\n"))
    sheets = s.groupBy("conv_id").agg(
        F.concat(F.lit("# Title\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", section.alias("s")))), lambda v: F.replace(v["s"], F.lit("student text:\n\n"), F.lit("student text:\n"))), "")).alias("sheet")
    )
    rows, _bad = M.parse_worksheet(sheets, "sheet", ["conv_id"])
    return rows.select("conv_id", F.substring("sample_id", 8, 9).cast("long").alias("turn"), "sample_id", F.md5(F.col("entered_text").cast("binary")).alias("digest"))


@query("s13_worksheet_render", """
    with s as (select conv_id, turn, concat_ws(chr(10), printf('## Sample %03d', turn+1), '', 'Sample ID: sample_'||turn, 'Paper alias: paper-a', 'Page: '||turn, 'Difficulty: '||role, 'Category: x, '||role,
      'Teacher annotations present/expected: '||(case when turn%2=0 then 'Yes' else 'No' end), 'Region: '||(case when turn%3<>0 then 'x=1, y=2, width='||turn||', height=4' else 'Full page' end), 'Ground truth student text:', '', '') sec from conversations)
    select conv_id, md5('# Sheet'||chr(10)||chr(10)||string_agg(sec, chr(10) order by turn)) digest from s group by 1""")
def _(fx):
    sheets = M.render_worksheet(worksheet_samples(fx), ["conv_id"], M.transcription_section(), ["# Sheet"])
    return sheets.select("conv_id", F.md5(F.col("worksheet").cast("binary")).alias("digest"))


@query("s13_labelling_worksheet", """
    with s as (select conv_id, turn, concat_ws(chr(10), '## sample_'||turn, '', 'Paper alias: paper-a', 'Page: '||turn, 'Test: 07', 'Selection categories: x, '||role, 'Page region: '||(case when turn%3<>0 then '1,2,'||turn||',4' else '0,0,1000,1400' end), 'Ground-truth evidence class:',
      'Answer regions (crop-relative x,y,width,height; use [] if none):', 'Human verification state: pending', 'Notes:', '') sec from conversations)
    select conv_id, md5(string_agg(sec, chr(10) order by turn)) digest from s group by 1""")
def _(fx):
    whole = F.struct(*[F.lit(v).alias(n) for n, v in zip(("x", "y", "width", "height"), (0, 0, 1000, 1400), strict=True)])
    sheets = M.render_worksheet(worksheet_samples(fx).withColumn("region", F.coalesce("region", whole)), ["conv_id"], M.labelling_section())
    return sheets.select("conv_id", F.md5(F.col("worksheet").cast("binary")).alias("digest"))


@query("s14_write_once", "select doc_id, quality, toxic from labels")
def _(fx):
    target = K.write_once(fx.table("labels"), scratch(fx), "0" * 64)
    return fx.spark.read.parquet(target)


@query("s15_replace_latest", "select l_orderkey, l_linenumber, l_suppkey, l_quantity, l_returnflag from lineitem where l_returnflag<>'A' union all select l_orderkey, l_linenumber, l_suppkey, l_quantity+1, l_returnflag from lineitem where l_returnflag='A'")
def _(fx):
    path = scratch(fx)
    rows = fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")
    K.replace(rows, path, ["l_returnflag"])
    K.replace(rows.where("l_returnflag = 'A'").withColumn("l_quantity", F.col("l_quantity") + 1), path, ["l_returnflag"])
    return fx.spark.read.parquet(path)


@query("s16_unique_predictions", """
    select l_orderkey, l_linenumber, l_suppkey from lineitem where (l_orderkey, l_linenumber) in (select (l_orderkey, l_linenumber) from (select l_orderkey, l_linenumber from lineitem group by all having count(*)=1))""")
def _(fx):
    kept, _dup = M.reject_duplicates(fx.table("lineitem"), ["l_orderkey", "l_linenumber"])
    return kept.select("l_orderkey", "l_linenumber", "l_suppkey")


@query("s17_safe_report", "select lang, count(*) samples, cast(sum(n_chars) as bigint) units from documents group by lang")
def _(fx):
    full = fx.table("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("samples"), F.sum("n_chars").alias("units"), F.first("text").alias("text"))
    return K.safe_report(full, ["lang", "samples", "units"], ["text", "doc_id"])


@query("s18_alias_resolution", """
    select l_orderkey, l_linenumber, l_suppkey, 'src/'||p_brand source_path from lineitem join part on l_partkey=p_partkey where p_size>10""")
def _(fx):
    sources = fx.table("part").where("p_size > 10").select(F.col("p_partkey").alias("paper_alias"), F.concat(F.lit("src/"), F.col("p_brand")).alias("source_path"))
    samples = fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("paper_alias"))
    return M.resolve_aliases(samples, sources)[0].drop("paper_alias")


@query("s18_missing_aliases", "select distinct l_partkey paper_alias from lineitem where l_partkey not in (select p_partkey from part where p_size>10)")
def _(fx):
    sources = fx.table("part").where("p_size > 10").select(F.col("p_partkey").alias("paper_alias"))
    return M.resolve_aliases(fx.table("lineitem").select(F.col("l_partkey").alias("paper_alias")), sources)[1]


@query("s19_metadata_refresh", """
    select l_orderkey, l_linenumber, l_suppkey, 'pages/'||o_custkey image_path, cast(o_custkey%4000 as int) image_width, cast(l_orderkey%6000 as int) image_height from lineitem join orders on l_orderkey=o_orderkey where o_orderstatus<>'P'""")
def _(fx):
    samples = fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_orderkey").alias("paper_alias"), F.lit(1).alias("page_number"), F.lit("old").alias("image_path"), F.lit(0).alias("image_width"), F.lit(0).alias("image_height"))
    pages = fx.table("orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("paper_alias"), F.lit(1).alias("page_number"), F.concat(F.lit("pages/"), F.col("o_custkey").cast("string")).alias("image_path"),
        (F.col("o_custkey") % 4000).cast("int").alias("width"), (F.col("o_orderkey") % 6000).cast("int").alias("height"),
    )
    return M.refresh_page_metadata(samples, pages)[0].drop("paper_alias", "page_number")


@query("s20_incremental_reuse", """
    with n as (select l_orderkey, count(*) pages from lineitem group by 1)
    select o_orderkey paper_id, case when o_orderkey%5=0 then 'new' when o_orderkey%7=0 then 'stale' when o_orderkey%3=0 and pages>0 or pages is null then 'incomplete' else 'reusable' end reuse_status
    from orders left join n on o_orderkey=l_orderkey""")
def _(fx):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    pages = fx.table("lineitem").select(F.col("l_orderkey").alias("paper_id"), F.row_number().over(order).alias("page_number"))
    counted = pages.groupBy("paper_id").agg(F.count(F.lit(1)).alias("page_count"))
    papers = fx.table("orders").select(F.col("o_orderkey").alias("paper_id"), F.sha2(F.col("o_totalprice").cast("string"), 256).alias("sha256")).join(counted, "paper_id", "left")
    stored = papers.where("paper_id % 5 <> 0").select("paper_id", F.when(F.col("paper_id") % 7 == 0, "other").otherwise(F.col("sha256")).alias("sha256"))
    kept = pages.where("not (paper_id % 3 = 0 and page_number = 1)")
    return M.pending_papers(papers, stored, kept).select("paper_id", "reuse_status")


@query("s20_source_changes", """
    select o_orderkey, case when o_orderkey%6=0 then 'changed' else 'same' end status from orders""")
def _(fx):
    before = fx.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("h"))
    after = fx.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, "edited").otherwise(F.col("o_orderpriority")).alias("h"))
    return status_compare(before, after, ["o_orderkey"], "h").select("o_orderkey", "status")


@query("s21_legacy_rename", "select l_orderkey, l_linenumber, l_suppkey, coalesce(case when l_linenumber%2=0 then l_quantity end, l_tax) unselected_after_balancing from lineitem")
def _(fx):
    rows = fx.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("unselected_after_balancing"),
        F.col("l_tax").alias("duplicate_or_overlap_candidates_rejected"),
    )
    return M.rename_legacy(rows, {"duplicate_or_overlap_candidates_rejected": "unselected_after_balancing"})
