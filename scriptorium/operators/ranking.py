"""Numbering and top-n without sorting a hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; the rank filter is applied before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def number_by_row(
    df: DataFrame,
    keys: Sequence[str],
    y: str,
    order: Sequence[Column],
    output: str,
    start: int = 0,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Consecutive numbers per group in (y, order) order.

    The ranking window is partitioned by group *and* pixel row; offsets come from a running
    count over pixel rows, of which a page has only as many as it is high. A page holding a
    large share of all rows is therefore still numbered by many tasks.

    ``counted`` has ``keys`` and ``y`` of the same rows from a cheaper plan, so that ``df`` is
    computed once.
    """
    per_row = (df if counted is None else counted).groupBy(*keys, y).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*keys).orderBy(y).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_row.withColumn("_offset", F.coalesce(F.sum("_n").over(running), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, y).orderBy(*order)
    return (
        df.join(offsets, [*keys, y])
        .withColumn(output, (F.row_number().over(inside) + F.col("_offset") + (start - 1)).cast("int"))
        .drop("_offset")
    )
