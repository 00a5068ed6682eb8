"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a table that may be broadcast; larger ones are joined by a shuffle with the same result.
BROADCAST_ROWS = 1_000_000


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(pattern), 0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when a count proves that it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: survives lost executors."""
    path = written(df)
    out = df.sparkSession.read.parquet(path)
    out._stored_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these tables; nothing that is still to run may read them."""
    for table in tables:
        spark, path = table.sparkSession, table._stored_at
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> str:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return path


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)
