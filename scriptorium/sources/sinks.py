"""Write-once and replace sinks, and allow-listed reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_once(df: DataFrame, root: str, fingerprint: str) -> str:
    """Store a snapshot under its fingerprint; an existing one is an error."""
    target = f"{root}/fingerprint={fingerprint}"
    df.write.mode("errorifexists").parquet(target)
    return target


def replace(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """Keep only the latest result, per partition when partition columns are given."""
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_worksheet(df: DataFrame, path: str, keys: Sequence[str], if_exists: str = "ignore") -> None:
    """One text file per dataset; a worksheet that is already there is kept."""
    df.select(*keys, F.col("worksheet").alias("value")).write.mode(if_exists).partitionBy(*keys).text(path)


def safe_report(df: DataFrame, allowed: Sequence[str], private: Sequence[str]) -> DataFrame:
    """Project to allowed columns only; asking for a private one is a programming error."""
    leaking = sorted(set(allowed) & set(private))
    if leaking:
        raise ValueError(f"private columns requested: {leaking}")
    return df.select(*allowed)
