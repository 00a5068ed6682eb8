"""Line dedup by winnowing over line hashes, in DataFrame functions only.

Lines are split at line feeds and compared without outer white space; blank lines keep their
place in the text but do not count. Among every ``run`` consecutive lines the smallest line
hash (the rightmost among equals) is the window's fingerprint, so any two equal runs of that
many lines select the same one: no repeat is missed. Only the selected lines are stored and
counted; those whose fingerprint occurs once end there. The places of the others are extended
both ways to the windows that selected them, and these are matched by the digest of the whole
run. Every run but the first in (doc_id, line) order is deleted; overlapping runs unite to
longer ones. Repeats are judged on the input, so the order of deletion does not matter.

A line is a whole paragraph, so long passages may have fewer than ``run`` lines. With ``words``,
windows of fewer lines count too when they hold more words than that, as in ``op7`` and the
pipeline.

No pair of occurrences is formed: groups keep their smallest place with partial aggregation,
so a passage in a third of all rows costs one row per task.

Null texts stay null, empty ones empty. doc_id is a key: windows that repeat at one place of one
doc_id are one, so repeated rows are cut alike. A row without doc_id is left whole. Other
columns pass through; ones named n_lines or n_removed_lines are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import bind, stored

RUN = 3
#: White space that does not count at the ends of a line.
OUTER = " \t\r\f\x0b"
#: A passage: a run of fewer lines counts as a repeat when it holds more words than this.
PASSAGE_WORDS = 50


def fingerprints(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc_id, n, fingerprint, windows): the lines that windows of ``n`` = ``run`` non-blank lines select.

    A row is a line whose hash is the smallest (the rightmost among equals) of one or more windows;
    ``windows`` tells where these begin, counting non-blank lines from 0, and the digest of each.
    With ``words`` also of windows of fewer lines that hold more words than that.
    """
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(OUTER)))
    lines = docs.select("doc_id", F.filter(trimmed, lambda x: x != "").alias("lines")).filter(F.size("lines") >= (run if words is None else 1))
    hashed = lines.select("doc_id", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("hs"), F.transform("lines", lambda x: F.size(F.split(x, r"[ \t\r\f\x0B]+"))).alias("sizes"))

    def selected(n):
        """For each window of ``n`` lines the place of its fingerprint, NULL for windows that do not count."""
        def place(i):
            part = F.reverse(F.slice("hs", i, n))
            return i + n - F.array_position(part, F.array_min(part)).cast("int")

        at = F.sequence(F.lit(1), F.size("hs") - n + 1)
        if n == run:
            found = F.transform(at, place)
        else:
            found = F.transform(at, lambda i: F.when(F.aggregate(F.slice("sizes", i, n), F.lit(0), lambda x, y: x + y) > words, place(i)))
        return F.when(F.size("hs") >= n, found).otherwise(F.array().cast("array<int>"))

    def rows(n):
        def chosen(places):
            def row(m):
                at = F.filter(F.sequence(F.greatest(m - n + 1, F.lit(1)), F.least(m, F.size(places))), lambda i: places[i - 1] == m)
                whole = F.transform(at, lambda i: F.struct((i - 1).alias("at"), F.unhex(F.md5(F.concat_ws("\n", F.slice("lines", i, n)))).alias("whole")))
                return F.struct(F.lit(n).alias("n"), F.get("hs", m - 1).alias("fingerprint"), whole.alias("windows"))

            return F.transform(F.array_compact(F.array_distinct(places)), row)

        return bind(selected(n), chosen)

    every = F.concat(*[rows(n) for n in range(run if words is None else 1, run + 1)])
    return hashed.select("doc_id", F.inline(every))


def repeated_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc_id, starts): windows (at, n) that also occur at an earlier place."""
    chosen = stored(fingerprints(docs, run, words))
    shared = chosen.groupBy("n", "fingerprint").agg(F.count("*").alias("c")).filter("c > 1").select("n", "fingerprint")
    matches = chosen.join(shared, ["n", "fingerprint"], "left_semi").select("doc_id", "n", F.inline("windows"))
    first = matches.groupBy("whole").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("c")).filter("c > 1").select("whole", "first")
    later = matches.join(first, "whole").filter(F.struct("doc_id", "at") > F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("at", "n")).alias("starts"))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """``docs`` with ``text`` without later repeats, and n_lines, n_removed_lines.

    A repeat is a run of ``run`` lines or, with ``words``, one of fewer lines and more words than that.
    """
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    held = docs.select("doc_id", "text", F.struct(*others).alias("_row"))
    held = held.join(repeated_lines(docs, run, words).withColumnRenamed("starts", "_starts"), "doc_id", "left")
    parts = F.split("text", "\n")
    held = held.withColumn("_parts", parts)
    numbered = bind(
        F.transform("_parts", lambda x: F.when(F.btrim(x, F.lit(OUTER)) == "", 0).otherwise(1)),
        lambda flags: F.filter(F.transform(F.sequence(F.lit(0), F.size(flags) - 1), lambda i: F.when(flags[i] == 1, i)), lambda i: i.isNotNull()),
    )
    held = held.withColumn("_real", F.when(F.col("text").isNotNull(), numbered))
    gone = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.slice("_real", s["at"] + 1, s["n"]))))
    held = held.withColumn("_gone", F.coalesce(gone, F.array().cast("array<int>")))
    marks = bind(F.map_from_arrays("_gone", "_gone"), lambda m: F.filter("_parts", lambda x, i: F.element_at(m, i).isNull()))
    out = held.withColumn("text", F.when(F.size("_gone") == 0, F.col("text")).otherwise(F.concat_ws("\n", marks)))
    out = out.withColumn("n_lines", F.coalesce(F.size("_real"), F.lit(0)).cast("long")).withColumn("n_removed_lines", F.size("_gone").cast("long"))
    return out.select(*["text" if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in others], "n_lines", "n_removed_lines")


ORACLE = """
with l as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ln
  from documents where text is not null
), t as (select doc_id, ln, line, regexp_replace(line, '^[ \\t\\r\\f\\x0B]+|[ \\t\\r\\f\\x0B]+$', '', 'g') as k from l
), r as (select doc_id, ln, line, k, row_number() over (partition by doc_id order by ln) - 1 as pos from t where k <> ''
), c as (
  select doc_id, pos, k, len(string_split_regex(k, '[ \\t\\r\\f\\x0B]+')) as words from r
), w as (
  select doc_id, pos, 3 as n, k || chr(10) || lead(k, 1) over p || chr(10) || lead(k, 2) over p as whole from c window p as (partition by doc_id order by pos)
  union all select doc_id, pos, 1, k from c where words > 50
  union all select * from (select doc_id, pos, 2, case when words + lead(words, 1) over p > 50 then k || chr(10) || lead(k, 1) over p end as whole from c window p as (partition by doc_id order by pos))
), f as (
  select doc_id, pos, n, row_number() over (partition by whole order by doc_id, pos) as rn from w where whole is not null
), g as (
  select distinct r.doc_id, r.ln from r join f on r.doc_id = f.doc_id and r.pos between f.pos and f.pos + f.n - 1 where f.rn > 1
), kept as (
  select t.doc_id, string_agg(t.line, chr(10) order by t.ln) as text from t anti join g on t.doc_id = g.doc_id and t.ln = g.ln group by t.doc_id
)"""
