"""Exact medians and multi-label summaries that stay distributed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut_lineage


#: Buckets of the first count are a 256th of a value wide; below 1e-300 and above 1e300 nothing overflows.
_BUCKETS, _OFFSET = 256, 1 << 20
#: At most this many buckets that hold a middle are sent to every task; more are joined by shuffle.
_SENT = 100_000


def value_bucket(value: Column) -> Column:
    """Number of the range a double falls into; grows with the value (NaN last)."""
    size = F.least(F.log(F.abs(value)), F.lit(1000.0))
    number = F.floor(size * _BUCKETS).cast("int") + _OFFSET
    return F.when(value == 0, 0).when(value < 0, -number).otherwise(number)


def exact_medians(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Exact median per key and value column, one row per key.

    ``median`` keeps every distinct value of a group in one buffer. Here rows are first counted
    by narrow ranges of values, which leaves each task a few hundred counts. They show in which
    ranges the middle ranks lie and how many values come before. Just the values of these
    ranges are ranked exactly: they are dealt over tasks in order, each part is counted, and the
    counts of the parts before it are where its ranks begin. Rows are neither shuffled nor sorted.
    """
    keys, names = list(keys), list(values)
    rows = (
        df.select(*keys, F.posexplode(F.array(*[values[n].cast("double") for n in names])).alias("metric", "value"))
        .where(F.col("value").isNotNull())
        .withColumn("_bucket", value_bucket(F.col("value")))
    )
    group = [*keys, "metric"]
    counts = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*group)
    upto = F.sum("_c").over(whole.orderBy("_bucket"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    middle = cut_lineage(
        counts.withColumn("n", F.sum("_c").over(whole)).withColumn("below", upto - F.col("_c"))
        .where((F.col("below") < high) & (F.col("below") + F.col("_c") >= low))
        .select(*[F.col(c).alias(f"_at_{c}") for c in [*group, "_bucket"]], "n", "below")
    )
    few = middle.count() <= _SENT
    bucket = [*group, "_bucket"]
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in bucket])
    inside = (
        rows.join(F.broadcast(middle) if few else middle, same)
        .groupBy(*bucket, "value")
        .agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("below").alias("below"))
    )
    ranges = cut_lineage(inside.repartitionByRange(*bucket, "value").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*bucket).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy(*bucket, "_range").agg(F.sum("c").alias("_in"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    starts = starts.select(*[F.col(c).alias(f"_at_{c}") for c in [*bucket, "_range"]], "_start")
    placed_ranges = ranges.join(starts, same & (F.col("_range") == F.col("_at__range")))
    running = F.col("_start") + F.sum("c").over(Window.partitionBy(*bucket, "_range").orderBy("value"))
    ranked = placed_ranges.withColumn("last", F.col("below") + running).withColumn("first", F.col("last") - F.col("c") + 1)
    medians = ranked.groupBy(*group).agg(
        (
            (
                F.max(F.when(low.between(F.col("first"), F.col("last")), F.col("value")))
                + F.max(F.when(high.between(F.col("first"), F.col("last")), F.col("value")))
            )
            / 2.0
        ).alias("median")
    )
    wide = [F.max(F.when(F.col("metric") == i, F.col("median"))).alias(n) for i, n in enumerate(names)]
    return medians.groupBy(*keys).agg(*wide)


def join_summaries(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two per-key summaries; without keys both sides are single rows."""
    if keys:
        return left.join(right, list(keys), "left")
    marked = left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", "left")
    return marked.drop("_one")


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL when the denominator is 0: undefined is not zero."""
    return F.when(denominator > 0, numerator.cast("double") / denominator)


def ratio_or(numerator: Column, denominator: Column, empty: Column | float) -> Column:
    empty = F.lit(empty) if isinstance(empty, float) else empty
    return F.when(denominator == 0, empty).otherwise(numerator.cast("double") / denominator)
