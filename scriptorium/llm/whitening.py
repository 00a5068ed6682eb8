"""Whitening of embeddings by exact bit-sliced scatter.

Entries become integers, ``floor(scale * c)``. For a block of distinct vectors each dimension is
shifted by its least value in the block and cut into bit planes; each plane is packed across
rows into 64-bit words. The count of rows in which two planes both hold a one is the popcount
of their AND; weighted by the powers of two of both planes these counts add up to the exact
cross-product of two dimensions. Undoing the shift and adding blocks stays in integers, and so
does centring: ``n * sum(x x') - S S'`` is exact whatever the mean, and only this is divided.

Each partition sends one row per pair of dimensions, its integer split into 32-bit limbs that
the JVM sums; the driver gets d * d sums for d dimensions, never vectors.

Rows with a null or empty vector, or with null or non-finite entries, are dropped. So are vectors whose
length is not the most frequent one (ties: the longest), since they have no covariance with the
rest. Entries beyond a long after scaling are held at its ends. A component whose eigenvalue is
not above ``LEAST`` times the largest is left out, so equal vectors, or one alone, give no rows;
an empty table gives none. Repeated rows and null ids give rows as often as they occur but count
once in the fit. A squared deviation beyond a decimal of 38 digits is null. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import stored

SCALE = 256
#: Rows of a block: a multiple of 64, so that planes fill whole words.
BLOCK = 1 << 14
LIMBS = 5
LEAST = 1e-12
TOP = 1 << 63


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x``, the vector as longs; rows that cannot be used are dropped."""
    value = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    used = vectors.filter((F.size("embedding") > 0) & whole)
    held = lambda c: F.when(c >= float(TOP), F.lit(TOP - 1)).when(c <= -float(TOP), F.lit(-TOP)).otherwise(F.floor(c))
    rows = used.select("vec_id", F.transform(value, lambda c: held(c * scale).cast("long")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("x") == (sizes[0]["d"] if sizes else 0))


def planes(y: np.ndarray) -> tuple[np.ndarray, int]:
    """Bit planes of a (rows, d) array of non-negative integers: (d * bits, words) and ``bits``."""
    bits = max(1, int(y.max()).bit_length())
    rows = -len(y) % 64
    flat = np.concatenate([np.packbits((y >> np.uint64(b)).astype(np.uint8) & 1, axis=0).T for b in range(bits)]) if bits else np.zeros((0, 0), np.uint8)
    flat = np.pad(flat, ((0, 0), (0, (len(y) + rows) // 8 - flat.shape[1])))
    return np.ascontiguousarray(flat).view(np.uint64), bits


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums and cross-products of the columns of ``x`` (longs), as Python integers."""
    n, d = x.shape
    low = x.min(axis=0)
    y = x.astype(np.uint64) - low.astype(np.uint64)
    words, bits = planes(y)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64).reshape(bits, d)
    small = 2 * bits + 14 < 62
    weight = np.array([1 << b for b in range(2 * bits)], np.int64 if small else object)
    cross = np.zeros((d, d), np.int64 if small else object)
    for a in range(bits):
        for i in range(d):
            own = words[a * d + i]
            if not own.any():
                continue
            both = np.bitwise_count(words & own).sum(axis=1, dtype=np.int64).reshape(bits, d).astype(weight.dtype)
            cross[i] += (both * weight[a : a + bits, None]).sum(axis=0)
    shift, count = [int(v) for v in low], [sum(int(ones[b, i]) << b for b in range(bits)) for i in range(d)]
    sums = [count[i] + n * shift[i] for i in range(d)]
    full = [[int(cross[i, j]) + shift[i] * count[j] + shift[j] * count[i] + n * shift[i] * shift[j] for j in range(d)] for i in range(d)]
    return sums, full


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scatter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per pair of dimensions (j = -1: the sum) with the number of rows and the limbs of the value."""
    n, sums, full = 0, None, None
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            x = matrix(batch.column("x").slice(at, BLOCK))
            s, c = scatter(x)
            n += len(x)
            sums = s if sums is None else [a + b for a, b in zip(sums, s, strict=True)]
            full = c if full is None else [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(full, c, strict=True)]
    if n:
        rows = [(i, j, v) for i, row in enumerate(full) for j, v in [(-1, sums[i]), *enumerate(row)]]
        limbs = [[v >> 32 * k & 0xFFFFFFFF if k < LIMBS - 1 else v >> 32 * k for _, _, v in rows] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1)] + [pa.array([n] * len(rows), pa.int64())] + [pa.array(v, pa.int64()) for v in limbs], ["i", "j", "n", *(f"l{k}" for k in range(LIMBS))])


@dataclass(frozen=True)
class Whitener:
    """``n`` vectors with the exact sums ``sums``; unit components in rows, their eigenvalues and shares of the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of the rows of ``x``, one column per component."""
        whole, part = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        off = (x.astype(np.longdouble) - np.array(whole, np.int64)) - np.array([p / self.n for p in part])
        return off.astype(float) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) squared, exact."""
        largest = max(int(np.abs(x.astype(float)).max(initial=0)) * self.n * 2, *(abs(s) for s in self.sums), 1)
        kind = np.int64 if 4 * largest**2 * max(1, x.shape[1]) < TOP else object
        off = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(v) for v in (off * off).sum(axis=1)]


def fit(distinct: DataFrame, top: int | None = None) -> Whitener | None:
    """The whitener of the rows of ``distinct`` (column ``x``), of its ``top`` first components; none without a component."""
    parts = distinct.select("x").mapInArrow(scatter_batches, "i int, j int, n bigint, " + ", ".join(f"l{k} bigint" for k in range(LIMBS)))
    rows = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), *(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect()
    if not rows:
        return None
    value = {(r["i"], r["j"]): sum(r[f"l{k}"] << 32 * k for k in range(LIMBS)) for r in rows}
    d, n = 1 + max(i for i, _ in value), rows[0]["n"]
    sums = [value[i, -1] for i in range(d)]
    centred = [[n * value[i, j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    if not (trace := sum(centred[i][i] for i in range(d))):
        return None
    values, vectors = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in centred]))
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > LEAST * values.max()][:top]
    return Whitener(n, tuple(sums), vectors[:, order].T.copy(), values[order], values[order] * (n * n) / trace)


def whitened(rows: DataFrame, model: Whitener) -> DataFrame:
    """Adds ``deviation`` (decimal) and ``z`` (array of doubles, one per component) to ``rows`` with ``x``."""
    names = rows.columns

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = matrix(batch.column("x")) if len(batch) else np.zeros((0, len(model.sums)), np.int64)
            z = model.apply(x)
            far = [v if v < 10**38 else None for v in model.deviations(x)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([str(v) if v is not None else None for v in far], pa.string()), lists], [*names, "deviation", "z"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(batches, f"{kinds}, deviation string, z array<double>").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(fitted: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.eigenvalues)
    z = whitened(fitted.select("x"), model).select(*(F.col("z")[i].alias(f"z{i}") for i in range(k)))
    row = z.agg(*(F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1))).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))


def whiten(vectors: DataFrame, top: int | None = None, scale: int = SCALE) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = quantised(vectors, scale)
    fitted = stored(rows.select("x").distinct())
    model = fit(fitted, top)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    share = F.array(*(F.lit(float(v)) for v in model.explained))
    return whitened(rows, model).select("vec_id", F.posexplode("z").alias("_at", "whitened"), "deviation").select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_at")).alias("explained"), F.lit(identity_error(fitted, model)).alias("identity_error"),
    )
