"""Byte-level BPE encoding and decoding.

Two tiers. Whole pre-tokens that are in the vocabulary are resolved together by a minimal
perfect hash (bucketed displacement: one seed per bucket, as many slots as keys); the few
others are merged with a heap of pair ranks over linked bytes. A worker keeps the ids of pre-tokens
it has met, up to ``MEMO`` characters of them, and starts afresh beyond; ids do not depend on it.

Null and empty texts give no ids. Texts are processed whole; a task holds one Arrow batch.
Repeated rows each give their row; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of pre-tokens whose ids a worker keeps.
MEMO = 1 << 22
#: Seeds tried at once for a bucket of the perfect hash.
TRIALS = 64


class PerfectHash:
    """Minimal perfect hash of byte strings: index(keys) gives positions or -1."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.keys = np.empty(n, object)
        self.buckets = max(1, n // 3)
        self.seeds = np.zeros(self.buckets, np.int64)
        self.ids = np.full(n, -1, np.int64)
        h = self.hashes(keys)
        groups = np.split(np.argsort(h % np.uint64(self.buckets), kind="stable"), np.cumsum(np.bincount((h % np.uint64(self.buckets)).astype(np.int64), minlength=self.buckets))[:-1])
        free = np.ones(n, bool)
        trial = np.arange(TRIALS, dtype=np.uint64)
        for b in sorted((g for g in range(self.buckets) if len(groups[g]) > 1), key=lambda g: -len(groups[g])):
            members = groups[b]
            base = np.uint64(0)
            while True:
                slots = self.slots(h[members][:, None], trial + base)
                apart = (np.diff(np.sort(slots, axis=0), axis=0) != 0).all(axis=0)
                fits = np.flatnonzero(free[slots].all(axis=0) & apart)
                if len(fits):
                    break
                base += np.uint64(TRIALS)
            self.seeds[b] = int(base) + int(fits[0])
            self._place(slots[:, fits[0]], members, free, keys)
        # a key alone in its bucket takes any slot that is left: the bucket names it by -1 - slot
        for b, slot in zip([g for g in range(self.buckets) if len(groups[g]) == 1], np.flatnonzero(free).tolist(), strict=True):
            self.seeds[b] = -1 - slot
            self._place(np.array([slot]), groups[b], free, keys)

    def _place(self, slots: np.ndarray, members: np.ndarray, free: np.ndarray, keys: list[bytes]) -> None:
        free[slots] = False
        self.ids[slots] = members
        for s, k in zip(slots, members, strict=True):
            self.keys[s] = keys[k]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))

    def slots(self, h: np.ndarray, seed) -> np.ndarray:
        x = h + np.atleast_1d(seed) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def index(self, keys: list[bytes]) -> np.ndarray:
        if not keys or not self.n:
            return np.full(len(keys), -1, np.int64)
        h = self.hashes(keys)
        seeds = self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(seeds < 0, -1 - seeds, self.slots(h, seeds.astype(np.uint64)))
        same = np.fromiter((k == s for k, s in zip(keys, self.keys[slots], strict=True)), bool, len(keys))
        return np.where(same, self.ids[slots], -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Lowest rank first, leftmost among equals, by a heap over linked byte positions."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


class Codec:
    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.rank_of = list(self.ranks.values())
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.held = 0
        # white space as the Unicode property, whatever else a library counts as such
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))

    @cached_property
    def lookup(self) -> PerfectHash:
        """Built at the first encoding: decoding needs none."""
        return PerfectHash(list(self.ranks))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = [self.pattern.findall(t) for t in texts]
        self._learn(list(set().union(*found).difference(self.memo)))
        out = [np.fromiter(chain.from_iterable(map(self.memo.__getitem__, f)), np.int32) for f in found]
        if self.held > MEMO:
            self.memo.clear()
            self.held = 0
        return out

    def _learn(self, new: list[str]) -> None:
        pieces = [p.encode() for p in new]
        for p, piece, w in zip(new, pieces, self.lookup.index(pieces).tolist(), strict=True):
            self.memo[p] = (self.rank_of[w],) if w >= 0 else tuple(merge(piece, self.ranks))
        self.held += sum(map(len, new))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(name: str, pattern: str) -> Codec:
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(f.read(), pattern)


def ship(spark, path: str) -> str:
    """Send a vocabulary file to every executor; its size does not grow with the data."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    name = ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        c = codec(name, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = c.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary) from (doc_id, ids)."""
    name = ship(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        c = codec(name, pattern)
        for batch in batches:
            out = [c.decode(np.asarray(v.values)) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Token count and digests of ids (little-endian 32 bit) and of the decoded bytes."""
    kind = decoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = [np.asarray(v.values).astype("<u4") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(v.as_py()).hexdigest() for v in batch.column(2)], pa.string()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return decoded.select("doc_id", "ids", "decoded").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def slices(batch: pa.RecordBatch, rows: int = 200):
    """Parts of a batch, so that what one call holds follows a few texts."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
