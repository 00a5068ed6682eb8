"""Token ids in binary files.

A file row is a block of whole documents in ascending order. Ids are replaced by their rank
in corpus frequency, so that common ids take one byte, and stored in byte-aligned variable
length: two bits per id in separate control bytes give its length (1 to 4 bytes), the data
bytes follow apart. A decoder reads control bytes through a table of 256 rows of four lengths
and gathers the data with numpy, without a loop over ids.

Null and empty texts hold the end id alone. Documents with equal doc_id keep one row each, in
order of their text. The rank table has one entry per vocabulary id and never more.

The vocabulary must be one that drops white space before it merges (as a word-end vocabulary
does): no id then spans two words, so a text's ids are those of its words in order, and a
worker asks the library once for each word it has not met. ``spans_words`` refuses others.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.byte_bpe import ship, slices
from scriptorium.llm.common import stored, written

#: Lengths of the four ids that a control byte describes.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.int64)
END = 1
BLOCK_IDS = 1 << 18


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-len(v) % 4 + len(v), np.uint8)
    codes[: len(v)] = n - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    n = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    starts = np.cumsum(n) - n
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = np.zeros(count, np.uint32)
    for byte in range(4):
        out |= np.where(n > byte, raw[starts + byte], 0).astype(np.uint32) << np.uint32(8 * byte)
    return out


#: Words a worker remembers, and the longest it remembers; others are encoded anew.
WORDS_KEPT, LONGEST_KEPT = 500_000, 64


def spans_words(encode) -> bool:
    """Does an id of this vocabulary hold white space, or depend on it?"""
    apart = [i for w in ("one", "Two's", "3;", "\u00e9", "\u65e5\u672c") for i in encode(w)]
    return any(encode(gap.join(("one", "Two's", "3;", "\u00e9", "\u65e5\u672c"))) != apart for gap in (" ", "\n", "\t \r\n"))


@lru_cache(maxsize=2)
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(SparkFiles.get(name))
    if spans_words(lambda text: t.encode(text, add_special_tokens=False).ids):
        raise ValueError(f"{name}: ids of this vocabulary span words")
    return t, {}


def ids_of_words(words: list[str], t, together: int = 200) -> Iterator[bytes]:
    """Ids of each word. Words go to the library many to a line; where an id begins in the line tells its word."""
    groups = [words[at : at + together] for at in range(0, len(words), together)]
    for group, e in zip(groups, t.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, np.int32)
        begins = np.array([o[0] for o in e.offsets], np.int64)
        starts = np.cumsum([0, *[len(w) + 1 for w in group]])
        edges = np.searchsorted(begins, starts).tolist()
        raw = ids.tobytes()
        for i in range(len(group)):
            yield raw[4 * edges[i] : 4 * edges[i + 1]]


def encode(text: str, t, known: dict[str, bytes]) -> np.ndarray:
    """Ids of one whole text and the end id. Only ASCII blanks part words here, so every part is still whole for the library."""
    parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    new = list({w for w in parts if w not in known})
    if len(known) + len(new) > WORDS_KEPT:
        known.clear()
        new = list(set(parts))
    known.update(zip(new, ids_of_words(new, t), strict=True))
    ids = np.frombuffer(b"".join(map(known.__getitem__, parts)), np.int32)
    for w in new:
        if len(w) > LONGEST_KEPT:
            del known[w]
    return np.append(ids, np.int32(END))


def tokenize(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>) with the end id appended."""
    name = ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        t, known = tokenizer(name)
        for batch in batches:
            for part in slices(batch, 50):
                coded = [encode(text, t, known) for text in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, coded)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(coded), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), ids], names=["doc_id", "tie", "ids"])

    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    return source.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, ids array<int>")


def ranking(tokens: DataFrame) -> np.ndarray:
    """Ids by falling frequency over the whole table; at most one entry per vocabulary id."""
    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, n = np.unique(np.asarray(batch.column(0).flatten()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(n, pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toPandas()
    return rows["id"].to_numpy(np.int64)


def write(tokens: DataFrame) -> tuple[str, np.ndarray]:
    """Files of blocks in ascending doc_id order; returns their folder and the ranking."""
    by_rank = ranking(tokens)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.int64)
    rank_of[by_rank] = np.arange(len(by_rank))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        shard, block, docs, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            values = np.concatenate(ids)
            control, data = pack(rank_of[values])
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([docs], pa.list_(doc_type)), pa.array([[len(i) for i in ids]], pa.list_(pa.int64())),
                pa.array([len(values)], pa.int64()), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
            ], names=["shard", "block", "docs", "counts", "n_ids", "control", "data"])

        for batch in batches:
            doc_type = batch.column(0).type
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                ids.append(np.asarray(value.values))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    block, docs, ids, held = block + 1, [], [], 0
        if docs:
            yield flush()

    ordered = tokens.repartitionByRange(tokens.sparkSession.sparkContext.defaultParallelism * 4, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    return written(ordered.mapInArrow(run, f"shard int, block int, docs array<{kind}>, counts array<bigint>, n_ids long, control binary, data binary")), by_rank


def read(spark, path: str, by_rank: np.ndarray, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, ids) from the files: block starts are running sums of shard and block totals."""
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one number per file
    starts, total = [], 0
    for s in shards:
        starts.append((s["shard"], total))
        total += s["n"]
    starts = spark.createDataFrame(starts, "shard int, shard_start long")
    place = blocks.select("shard", "block", "n_ids").withColumn("before", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    place = place.join(F.broadcast(starts), "shard").select("shard", "block", (F.col("shard_start") + F.coalesce("before", F.lit(0))).alias("start"))
    table = by_rank.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                ids = table[unpack(r["control"], r["data"], r["n_ids"])]
                ends = np.cumsum(r["counts"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["docs"], batch.schema.field("docs").type.value_type), pa.array(r["start"] + ends - r["counts"], pa.int64()), pa.array(np.split(ids, ends[:-1]), pa.list_(pa.int32())),
                ], names=["doc_id", "start", "ids"])

    return blocks.join(place, ["shard", "block"]).mapInArrow(run, f"doc_id {kind}, start long, ids array<int>")


def digests(decoded: DataFrame) -> DataFrame:
    kind = decoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = [np.asarray(v.values).astype("<u4") for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
            ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return decoded.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, start, ids) of all documents, read back from the files just written."""
    tokens = stored(tokenize(docs, vocabulary))
    path, by_rank = write(tokens)
    return read(docs.sparkSession, path, by_rank, docs.schema["doc_id"].dataType.simpleString())
