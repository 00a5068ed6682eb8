"""Document fingerprints by order MinHash, in DataFrame functions only.

K-mers of code points are numbered by occurrence, so repeats count. Each (k-mer, occurrence)
has one hash; its top bits deal it to one of ``BINS`` bins, which stand for independent hash
functions. Every bin selects its ``TUPLE`` smallest hashes, puts them back in text
order and hashes that tuple: texts with equal k-mer sets but other order differ, which
follows edit distance closer than plain MinHash.

Everything is array work inside a row: no k-mer is shuffled. A text shorter than ``K`` is one
k-mer; null is empty, and an empty text has empty bins only. Likeness is the share of equal
bins among those filled in either fingerprint; 1 if none is. doc_id orders the documents;
rows with equal doc_id are ordered by text. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import bind

K = 6
BINS = 64
TUPLE = 2
#: Packed longs: 36 bits of hash and 27 of position; a longer text wraps its positions.
PLACE_BITS = 27
PLACE = 1 << PLACE_BITS
#: Hashes of a bin that are sorted on average, of which its smallest are taken.
SORTED = 24


def starts_of(keys: Column, unit: int) -> Column:
    """Indices at which a run of equal values of ``keys / unit``, a power of two, starts in a sorted array."""
    every = F.slice(F.sequence(F.lit(0), F.size(keys)), F.lit(1), F.size(keys))
    return F.filter(every, lambda i: (i == 0) | (F.get(keys, i).bitwiseXOR(F.get(keys, i - 1)) >= unit))


def packed(hashed: Column, place: Column) -> Column:
    return F.shiftrightunsigned(hashed, PLACE_BITS + 1) * PLACE + place


def signature(text: Column, k: int = K, bins: int = BINS, size: int = TUPLE) -> Column:
    """Array of ``bins`` hex strings, empty where a bin has no k-mer.

    The sort of a text's k-mers stands outside of every lambda, so it runs on primitive longs.
    """
    whole = F.coalesce(text, F.lit(""))
    unit = 1 << (63 - (bins - 1).bit_length())  # the top bits name the bin

    # each match consumes one code point and captures k
    found = F.transform(F.regexp_extract_all(whole, F.lit(f"(?s)(?=(.{{{k}}}))."), 1), lambda x, i: packed(F.xxhash64(x), i.bitwiseAND(PLACE - 1).cast("long")))
    kmers = F.when(F.char_length(whole) < k, F.array(packed(F.xxhash64(whole), F.lit(0).cast("long")))).otherwise(found)

    def firsts(s):
        return F.filter(s, lambda x, i: (i == 0) | (x.bitwiseXOR(F.get(s, i - 1)) >= PLACE))

    def repeats(s):
        return F.filter(s, lambda x, i: x.bitwiseXOR(F.get(s, i - 1)) < PLACE)

    def keyed(again, starts):
        """Hashes of repeats: a k-mer's first place keeps its own, each later one has another by its number."""
        def run(start, j):
            end = F.coalesce(F.get(starts, j + 1), F.size(again))
            return F.transform(F.slice(again, start + 1, end - start), lambda x, o: packed(F.xxhash64(F.shiftright(x, PLACE_BITS), o + 1), x.bitwiseAND(PLACE - 1)))

        return F.flatten(F.transform(starts, run))

    def selected(s):
        def of(limit, few, later):
            mixed = F.sort_array(F.concat(firsts(few), F.filter(later, lambda x: x.bitwiseAND(unit - 1) < limit)))
            every = bind(F.sort_array(F.concat(firsts(s), later)), lambda t: bind(starts_of(t, unit), lambda b: tuples(t, b)))
            return bind(mixed, lambda t: bind(starts_of(t, unit), lambda b: F.when((limit == unit) | full(t, b), tuples(t, b)).otherwise(every)))

        # a bin's smallest are looked for among few; should one lack them, among all
        bound = (F.least(F.lit(1.0), F.lit(float(bins * SORTED)) / F.size(s)) * unit).cast("long")
        return bind(bound, lambda limit: bind(F.filter(s, lambda x: x.bitwiseAND(unit - 1) < limit), lambda few: bind(
            repeats(s), lambda again: bind(starts_of(again, PLACE), lambda b: bind(keyed(again, b), lambda later: of(limit, few, later))),
        )))

    def full(t, b):
        """Whether each bin has as many hashes as it selects, so that none of those left out can be smaller."""
        return (F.size(b) == bins) & F.forall(b, lambda start: F.coalesce(F.get(t, start + size - 1).bitwiseXOR(F.get(t, start)) < unit, F.lit(False)))

    def tuples(t, b):
        pair = lambda start, j: one_tuple(F.slice(t, start + 1, F.least(F.lit(size), F.coalesce(F.get(b, j + 1), F.size(t)) - start)))
        every = F.transform(b, pair)
        by_bin = F.map_from_entries(F.transform(b, lambda start, j: F.struct(F.shiftright(F.get(t, start), (unit - 1).bit_length()), pair(start, j))))
        sparse = bind(by_bin, lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at(m, i.cast("long")), F.lit(""))))
        return F.when(F.size(b) == bins, every).otherwise(sparse)

    def one_tuple(part):
        by_place = F.transform(part, lambda x: F.shiftleft(x.bitwiseAND(PLACE - 1), 63 - PLACE_BITS).bitwiseOR(F.shiftright(x, PLACE_BITS)))
        return F.lpad(F.hex(F.xxhash64(F.transform(F.sort_array(by_place), lambda x: x.bitwiseAND((1 << (63 - PLACE_BITS)) - 1)))), 16, "0")

    empty = F.array_repeat(F.lit(""), bins)
    return F.when(F.length(whole) == 0, empty).otherwise(bind(F.sort_array(kmers), selected))


def likeness(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != "")), lambda v: v)).cast("double")
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != "") | (y != "")), lambda v: v))
    return F.when(either == 0, 1.0).otherwise(same / either)


def text_of(signature: Column) -> Column:
    return F.concat_ws("-", signature)


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column]) -> DataFrame:
    """Each row with ``next_<column>`` of the next row in descending doc_id; the last takes the first.

    ``derived`` columns are computed once per row, before rows are dealt out.

    Rows are dealt to quantile ranges of doc_id, so no window holds the table; the largest row
    of the nearest range below is added to each range. Ranges follow spark.sql.shuffle.partitions.
    """
    docs = docs.select("doc_id", *columns)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8) * 4
    ends = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10000)).first()[0] or []
    ends = sorted(set(ends))
    rank = F.lit(0)
    if ends:
        rank = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.coalesce("doc_id", F.lit(ends[0]))))
    dealt = docs.withColumn("_range", rank)
    tops = dealt.groupBy("_range").agg(F.max("doc_id").alias("top")).filter("top is not null").orderBy("_range").collect()  # one row per range
    target = [(tops[i]["top"], tops[(i + 1) % len(tops)]["_range"], i + 1 == len(tops)) for i in range(len(tops))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    halo = docs.sparkSession.createDataFrame(target, f"doc_id {kind}, _range int, _wrap boolean")
    first = Window.partitionBy("doc_id").orderBy(*[F.desc_nulls_last(c) for c in columns])
    halo = docs.join(F.broadcast(halo), "doc_id").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    every = dealt.withColumn("_halo", F.lit(0)).unionByName(halo.drop("_n", "_wrap").withColumn("_halo", F.lit(1)))
    every = every.withColumns(derived)
    order = Window.partitionBy("_range").orderBy("_halo", F.desc_nulls_last("doc_id"), *[F.desc_nulls_last(c) for c in columns])
    return every.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in [*columns, *derived]]).filter("_halo = 0").drop("_halo", "_range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, and signatures of the text, the edited text and the next text."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(base, ["text"], {"signature": signature(F.col("text"))})
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "signature", "next_signature", edited.alias("edited"))
    return rows.withColumn("edited_signature", signature(F.col("edited")))
