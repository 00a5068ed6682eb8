"""Exact medians against the standard library, with ties, nulls, null keys and values dealt over many ranges."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import summaries
from scriptorium.operators.summaries import exact_medians


def expected(rows, column):
    by = {}
    for r in rows:
        if r[column] is not None:
            by.setdefault(r[0], []).append(r[column])
    return {k: statistics.median(v) for k, v in by.items()}


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_exact_medians(spark, partitions):
    rng = random.Random(1)
    rows = [(k, float(rng.randrange(n)) if rng.random() < 0.9 else None, rng.gauss(0, 1)) for k, n in (("a", 5), ("b", 100000), ("c", 3)) for _ in range(401 if k != "c" else 2)]
    rows += [("d", None, 1.5), ("e", 7.0, -2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.k: (r.mx, r.my) for r in exact_medians(df, ["k"], {"mx": F.col("x"), "my": F.col("y")}).collect()}
        whole = exact_medians(df, [], {"mx": F.col("x"), "my": F.col("y")}).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    x, y = expected(rows, 1), expected(rows, 2)
    assert got == {k: (x.get(k), y[k]) for k in y}
    assert (whole.mx, whole.my) == (statistics.median(r[1] for r in rows if r[1] is not None), statistics.median(r[2] for r in rows))


def test_every_range_starts_where_the_one_before_ends(spark):
    # A bracket wide enough to span many ranges: all values are the same up to the last digits.
    df = spark.range(20001).select((F.lit(1.0) + F.col("id") / 1e9).alias("x"))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert exact_medians(df, [], {"m": F.col("x")}).first().m == 1.0 + 10000 / 1e9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_values_of_every_size_and_null_keys(spark):
    rng = random.Random(2)
    sizes = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf")]
    rows = [(k, rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300)) for k in ("a", None) for _ in range(301)]
    rows += [("a", v) for v in sizes] + [("b", -3.0), ("b", 5.0), ("c", float("inf"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    got = {r.k: r.m for r in exact_medians(df, ["k"], {"m": F.col("x")}).collect()}
    assert got == {k: statistics.median([v for a, v in rows if a == k]) for k in ("a", None, "b", "c")}


def test_rows_are_neither_shuffled_nor_sorted(spark, monkeypatch):
    # A size check that never broadcasts: rows of one large key must not meet in one sorted task.
    plans = []
    cut = summaries.cut_lineage
    monkeypatch.setattr(summaries, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    df = spark.range(20_000, numPartitions=4).select(F.lit("k").alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exact_medians(df, ["k"], {"m": F.col("x")}).first().m == 3.0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and not any("SortMergeJoin" in p for p in plans)
