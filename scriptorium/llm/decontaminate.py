"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's windows (``size`` consecutive words, or the whole item when it is shorter) must be
contained whole in a document, so one shingle of each window is a sufficient prefix. Shingles
are ordered by rarity, counted over all documents, and each window joins on its rarest one.
Its offset in the window bounds the place of the match (positional bound), and the document
must have room for the window there (length bound). What passes is verified word by word.

Null and empty texts have no words: they are neither hit nor do they hit. Equal items share
their windows. Repeated rows each give their row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import small, stored, words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 13
SHINGLE = 4


def shingle_hashes(w: Column, k) -> Column:
    """Hash of every ``k`` consecutive words, in text order."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k), k))).otherwise(F.array().cast("array<bigint>"))


def windows(items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """(window, len, k, shingles): each distinct window once."""
    w = items.select(words(F.col("text"), WORD).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.lit(size), F.size("w"))
    one = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("window")).distinct()
    one = one.select("window", F.size("window").alias("len"), F.least(F.lit(shingle), F.size("window")).alias("k"))
    return one.select("*", F.posexplode(shingle_hashes(F.col("window"), F.col("k"))).alias("offset", "h"))


def owners(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(window, items): the items that hold a window."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text"), WORD).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.lit(size), F.size("w"))
    one = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("window"))
    return one.groupBy("window").agg(F.collect_set("item").alias("items"))


def positions(docs: DataFrame, ks: list[int]) -> DataFrame:
    """(doc_id, n_words, at, h) of every shingle of the lengths in use."""
    hashes = F.flatten(F.array(*[F.transform(shingle_hashes(F.col("w"), k), lambda h, i: F.struct(h.alias("h"), i.alias("at"))) for k in ks]))
    one = docs.select("doc_id", F.size("w").alias("n_words"), F.explode(hashes).alias("s"))
    return one.select("doc_id", "n_words", "s.at", "s.h")


def matches(docs: DataFrame, items: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Candidate places (doc_id, hits) from prefix shingles, before verification."""
    shingles = stored(windows(items, size, shingle))
    ks = [r["k"] for r in shingles.select("k").distinct().orderBy("k").collect()]  # at most `shingle` values
    if not ks:
        return docs.select("doc_id").limit(0).select("doc_id", F.array(F.struct(F.lit(0).alias("start"), F.array(F.lit("")).alias("window"), F.array(F.lit("")).alias("items"))).alias("hits"))
    w = docs.select("doc_id", words(F.col("text"), WORD).alias("w"))
    known = small(shingles.select("h").distinct())
    places = stored(positions(w, ks).join(known, "h", "left_semi"))  # read by the count and by the join
    rarity = places.groupBy("h").agg(F.count("*").alias("seen"))
    ranked = shingles.join(rarity, "h", "left").select("*", F.coalesce("seen", F.lit(0)).alias("rare"))
    prefix = ranked.groupBy("window", "len").agg(F.min(F.struct("rare", "h", "offset")).alias("p"))
    prefix = prefix.filter("p.rare > 0").join(owners(items, size), "window").select("window", "len", "items", "p.h", "p.offset")
    prefix = small(stored(prefix))
    found = places.join(prefix, "h").filter((F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("len") <= F.col("n_words")))
    return found.groupBy("doc_id").agg(F.collect_set(F.struct((F.col("at") - F.col("offset")).alias("start"), "window", "items")).alias("hits"))


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    # stored, so that the planner knows its size and moves texts only where it must
    joined = docs.join(stored(matches(docs, items, size)), "doc_id", "left").withColumn("w", words(F.col("text"), WORD)).select("doc_id", "w", "hits")
    exact = F.filter(F.coalesce("hits", F.array().cast(joined.schema["hits"].dataType)), lambda h: F.slice(F.col("w"), h["start"] + 1, F.size(h["window"])) == h["window"])
    out = joined.select("doc_id", F.size("w").cast("long").alias("n_words"), exact.alias("exact"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("exact", lambda h: F.sequence(h["start"], h["start"] + F.size(h["window"]) - 1))))).cast("long")
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("exact", lambda h: h["items"]))))
    out = out.select("doc_id", "n_words", covered.alias("n_hit"), ids.alias("item_ids"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
