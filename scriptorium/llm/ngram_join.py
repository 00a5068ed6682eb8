"""N-gram Jaccard join by partition of the token universe (pigeonhole), verified exactly.

Documents are sets of word shingles; equal sets collapse to their smallest doc_id first. Sets
fall in bands by size. Hashing deals the tokens of a band of sets up to ``hi`` to
``hi / 4 + 1`` segments: two sets of similarity 0.8 differ in at most a quarter of the smaller
one, so some segment must be equal. Of each indexed set all segments are stored, and for every
eighth segment also its one-deletion neighbourhood. A probing set allocates to each segment 0
(skip), 1 (equal) or, where neighbourhoods exist, 2 (differ in at most one token), so that the
sum exceeds the number of tokens by which it may differ. The cheapest allocation by the
frequency of the keys is taken, so frequent segments are skipped; nothing is lost, because
segments at distance of at least their allocation would add up to more than is allowed.

Keys leave a task once, and only keys that several sets hold are stored. Candidates whose
counts of tokens by low bits cannot overlap enough are dropped; the others are verified on whole
sets, which are made from the texts again and dealt to blocks of pairs, once to each block. Near
copies in large groups share most of their keys; to form no pair twice over, members of a key
are first compared with its smallest set, and pairs are made afterwards only across components
that this leaves apart.

Empty and null texts have the empty set and are linked with nothing. doc_id is a number;
repeated rows collapse like copies and each give their row. Rows of one doc_id with different
texts belong to one component. Rows without doc_id have no component, unless their text is that
of a document with one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import free, small, stored, words
from scriptorium.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
#: Slots of the frequency table: what is broadcast never grows beyond them.
SLOTS = 1 << 20
NEIGHBOURHOOD = 8
#: Keys that a task holds before it hands them on.
KEYS_HELD = 100_000
#: Sets on each side of a block of pairs.
BLOCK = 512
#: Tokens of a sketch's counter on average, rows of sketches that may be broadcast.
COUNTED, SKETCHES = 16, 200_000
#: Every such set is counted for the frequency table.
WEIGHED = 8


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n, h1, h2, tokens: the sorted set of shingle hashes of each row; two hashes name it.

    Rows are chosen before, by their texts: a filter on the sets would make them once more.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(words(F.col("text"), WORD), lambda w: F.xxhash64(w)).alias("_w"))
    count = F.size("_w")
    every = F.transform(F.sequence(F.lit(0), count - size), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(size)]))
    made = F.when(count == 0, F.array().cast("array<bigint>")).when(count < size, F.array(F.xxhash64("_w"))).otherwise(every)
    sets = hashed.select("doc_id", "text_hash", F.sort_array(F.array_distinct(made)).alias("tokens"))
    return sets.select("doc_id", "text_hash", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(1), "tokens").alias("h2"), "tokens")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(largest: int) -> np.ndarray:
    """Upper ends of the size bands: each is a quarter wider than its lower end."""
    ends, low = [], 1
    while low <= largest:
        ends.append(low + low // 4)
        low = ends[-1] + 1
    return np.array(ends or [1])


class Segments:
    """Segments of one set in one band."""

    def __init__(self, tokens: np.ndarray, band: int, end: int):
        h = mix(tokens)
        self.count = end // 4 + 1
        self.near = -(-self.count // NEIGHBOURHOOD)
        self.of = ((h >> np.uint64(20)) % np.uint64(self.count)).astype(np.int64)
        self.weight = mix(h + np.uint64(0x9E3779B97F4A7C15))
        self.sums = np.zeros(self.count, np.uint64)
        np.add.at(self.sums, self.of, self.weight)
        self.salt = mix(np.arange(self.count, dtype=np.uint64) * np.uint64(0x100000001B3) + np.uint64(band))
        self.close = np.flatnonzero(self.of < self.near)  # tokens in segments with neighbourhoods

    def whole(self) -> np.ndarray:
        return mix(self.sums + self.salt)

    def shorter(self) -> np.ndarray:
        """Sums of one-deletion neighbours, in the order of ``close``."""
        at = self.of[self.close]
        return self.sums[at] - self.weight[self.close] + self.salt[at]


def index_keys(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    band = int(np.searchsorted(ends, len(tokens)))
    s = Segments(tokens, band, int(ends[band]))
    return np.concatenate([s.whole(), mix(~s.shorter())])


def probe_keys(tokens: np.ndarray, ends: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    n = len(tokens)
    out = []
    for band in range(int(np.searchsorted(ends, -(-4 * n // 5))), int(np.searchsorted(ends, n)) + 1):
        s = Segments(tokens, band, int(ends[band]))
        most = min(n, int(ends[band]))
        needed = min((n + most) // 9, most // 4) + 1
        equal, less, more = s.whole(), mix(s.shorter()), mix(~(s.sums + s.salt))[: s.near]
        slot = np.uint64(SLOTS - 1)
        first = frequency[(equal & slot).astype(np.int64)] + 1
        second = frequency[(more & slot).astype(np.int64)] + 1
        np.add.at(second, s.of[s.close], frequency[(less & slot).astype(np.int64)] + 1)
        second = np.maximum(second, first[: s.near])  # a second unit never comes before the first
        chosen = np.argsort(np.concatenate([first, second]), kind="stable")[:needed]
        allotted = np.zeros(s.count, np.int64)
        np.add.at(allotted, np.where(chosen < s.count, chosen, chosen - s.count), 1)
        out += [equal[allotted > 0], more[allotted[: s.near] == 2], less[allotted[s.of[s.close]] == 2]]
    return np.concatenate(out)


def keys(sets: DataFrame, ends: np.ndarray, frequency: np.ndarray | None = None) -> DataFrame:
    """(key, id, n, probe): index keys and, when a frequency table is given, probe keys."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found, held = [], 0
            for at in range(batch.num_rows):
                tokens = np.asarray(batch.column(2)[at].values).view(np.uint64)
                for k, probe in ((index_keys(tokens, ends), False), (None if frequency is None else probe_keys(tokens, ends, frequency), True)):
                    if k is not None:
                        k = np.unique(k).view(np.int64)
                        found.append((k, batch.column(0)[at].as_py(), len(tokens), probe))
                        held += len(k)
                if found and (held >= KEYS_HELD or at + 1 == batch.num_rows):
                    counts = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([f[0] for f in found])), pa.array(np.repeat(np.array([f[1] for f in found], np.int64), counts)),
                        pa.array(np.repeat(np.array([f[2] for f in found], np.int32), counts)), pa.array(np.repeat(np.array([f[3] for f in found]), counts)),
                    ], names=["key", "id", "n", "probe"])
                    found, held = [], 0

    return sets.select("id", "n", "tokens").mapInArrow(run, "key long, id long, n int, probe boolean")


def blocks(pairs: DataFrame) -> DataFrame:
    """(block, a, b): pairs dealt so that those between the same sets meet, of at most about BLOCK sets a side."""
    found = components(pairs).withColumnRenamed("component", "label")
    sizes = found.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("parts"))
    return pairs.join(found.withColumnRenamed("node", "a"), "a").join(sizes, "label").select(F.xxhash64("label", part("a"), part("b")).alias("block"), "a", "b")


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of the tokens by their low bits; empty, which bounds nothing, if one does not fit a byte."""
    slots = 1 << (len(tokens) // COUNTED).bit_length()
    counts = np.bincount((tokens.view(np.uint64) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(n: int, x: bytes, m: int, y: bytes) -> bool:
    """Whether sets of n and m tokens can share enough by their sketches: never false for a link."""
    if not x or not y:
        return True
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in ((x, y) if len(x) <= len(y) else (y, x)))
    common = int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())
    return 100 * common >= 80 * (n + m - common)


def plausible(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs without those that sketches rule out, which are nearly all that are no links."""
    met = small(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct())

    def sketched(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            tokens = [np.asarray(t.values) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in tokens], pa.int32()), pa.array([sketch(t) for t in tokens], pa.binary())], names=["id", "n", "sketch"])

    of = stored(sets_of(met).select("id", "tokens").mapInArrow(sketched, "id long, n int, sketch binary").distinct())
    left, right = (small(of.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")), SKETCHES) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = [may_link(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) among candidate pairs, by exact overlap; ``sets_of`` makes the sets of some ids.

    A set is dealt once to each block that has a pair of it, not once for each pair.
    """
    every = stored(pairs.distinct())
    some = stored(plausible(every, sets_of))
    dealt = stored(blocks(some))
    free(every, some)
    needed = small(dealt.select("block", F.col("a").alias("id")).unionAll(dealt.select("block", F.col("b").alias("id"))).distinct())
    rows = sets_of(needed.select("id").distinct()).select("id", "tokens").join(needed, "id").select("block", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "tokens")
    rows = rows.unionAll(dealt.select("block", "a", "b", F.lit(None).cast("array<bigint>").alias("tokens")))

    def run(batches: Iterator[pa.RecordBatch]):
        at, held = None, {}
        for batch in batches:
            out = []
            tokens = batch.column(3)
            for i, (block, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if block != at:
                    at, held = block, {}
                if b is None:
                    one, texts = np.asarray(tokens[i].values), held.setdefault(a, [])
                    if not any(np.array_equal(one, t) for t in texts):
                        texts.append(one)
                elif any(alike(x, y) for x in held.get(a, []) for y in held.get(b, [])):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    met = rows.repartition("block").sortWithinPartitions("block", F.col("b").isNotNull())
    links = stored(met.mapInArrow(run, "a long, b long"))
    free(dealt)
    return links


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= 80 * (len(x) + len(y) - common)


def fitting(left: str, right: str) -> Column:
    """Size bound: the right set is at most as large, and large enough."""
    return (F.col(right) <= F.col(left)) & (5 * F.col(right).cast("long") >= 4 * F.col(left).cast("long"))


def links_and_classes(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, members, classes): verified links (a, b) between ids, each row's class, each class's smallest doc_id.

    A doc_id with several texts is one node: it stands in several classes, which it links.
    """
    members = stored(shingle_sets(docs, size).drop("tokens"))
    classes = stored(members.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id")))
    of = members.filter("n > 0").join(classes, ["n", "h1", "h2"]).select("doc_id", "id", "text_hash").distinct()
    several = of.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("doc_id")
    shared = stored(of.join(several, "doc_id").select(F.col("doc_id").cast("long").alias("a"), F.col("id").cast("long").alias("b")).filter("a <> b").distinct())

    # sets are made from the texts again where they are read: stored, they are larger than the texts
    copies = small(of.filter("doc_id <> id").select("doc_id", "text_hash"))
    own = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(WORD)).withColumn("text_hash", F.xxhash64("text")).join(copies, ["doc_id", "text_hash"], "left_anti")

    def named(rows):
        return shingle_sets(rows, size).select(F.col("doc_id").cast("long").alias("id"), "n", "tokens")

    def sets_of(ids):
        return named(own.join(small(ids.select(F.col("id").alias("_id"))), F.col("doc_id").cast("long") == F.col("_id"), "left_semi"))

    ends = bands(members.agg(F.max("n")).first()[0] or 1)
    # frequencies only choose among allocations that all find every link, so those of a part of the sets do
    some = keys(named(own.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(WEIGHED)) == 0)), ends)
    frequency = np.zeros(SLOTS, np.int64)
    folded = some.groupBy((F.col("key").bitwiseAND(SLOTS - 1)).cast("int").alias("slot")).agg(F.count("*").alias("c")).toPandas()
    frequency[folded["slot"].to_numpy(np.int64)] = folded["c"].to_numpy(np.int64)

    # one exchange: keys that only one set holds go no further
    dealt = keys(named(own), ends, frequency).repartition("key")
    indexed = F.when(~F.col("probe"), F.col("n"))
    hubs = dealt.groupBy("key").agg(F.min(indexed).alias("m"), F.min_by("id", indexed).alias("b"), F.count(indexed).alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("probe").alias("probed"))
    hubs = hubs.filter("probed and c > 0 and lo <> hi").select("key", "m", "b", "c").hint("shuffle_hash")
    met = stored(dealt.join(hubs, "key"))
    first = met.filter("probe").select(F.col("id").alias("a"), "n", "b", "m").filter((F.col("a") != F.col("b")) & fitting("n", "m"))
    links = stored(verified(first.select("a", "b"), sets_of).unionAll(shared))
    groups = stored(components(links))

    # keys whose members still lie in different components
    both = met.filter("c > 1").join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "probe", F.coalesce("component", "id").alias("component"))
    both = stored(both)
    free(met, groups, shared)
    apart = both.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    near = stored(both.join(small(apart), "key", "left_semi"))
    left = near.filter("probe").select("key", F.col("id").alias("a"), "n", F.col("component").alias("ca"))
    right = near.filter("not probe").select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("component").alias("cb"))
    rest = left.join(right, (left["key"] == right["key"]) & (F.col("ca") != F.col("cb")) & fitting("n", "m")).select("a", "b")
    more = verified(rest, sets_of)
    free(both, near)
    return links.unionAll(more), members, classes


def similar_groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    links, members, classes = links_and_classes(docs, size)
    groups = components(links)
    found = classes.join(groups.withColumnRenamed("node", "id"), "id", "left").select("n", "h1", "h2", F.coalesce("component", F.col("id")).alias("component"))
    out = members.join(found, ["n", "h1", "h2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
