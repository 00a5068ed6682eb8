"""Generic rule validation producing a long table of violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_rules(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) for every rule that does not hold; an undecidable rule counts as broken."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    )
    return df.select(*key, F.explode(broken).alias("rule"))


def unique_violations(df: DataFrame, key: Sequence[str], rule: str = "unique_id") -> DataFrame:
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .select(*key, F.lit(rule).alias("rule"))
    )


def order_violations(
    df: DataFrame, group: Sequence[str], position: str, key: str, rule: str = "sorted_ids"
) -> DataFrame:
    """Rows whose identifier is smaller than the one before it in stored order."""
    previous = F.lag(key).over(Window.partitionBy(*group).orderBy(position))
    return df.withColumn("_prev", previous).where(F.col(key) < F.col("_prev")).select(
        *group, key, F.lit(rule).alias("rule")
    )


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``reject_reason``: the first broken rule in declared order, NULL when valid."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def page_sequence_ok(pages: DataFrame, key: Sequence[str], number: str) -> DataFrame:
    """Per paper: are its page numbers exactly 1..n?"""
    return pages.groupBy(*key).agg(
        (
            (F.min(number) == 1)
            & (F.max(number) == F.count(F.lit(1)))
            & (F.countDistinct(number) == F.count(F.lit(1)))
        ).alias("pages_ok"),
        F.count(F.lit(1)).alias("page_count"),
    )
