"""File inventory, admission, document records and tool reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import ids
from scriptorium.operators.joins import status_compare
from scriptorium.operators.rules import split_valid

MAX_BYTES = 50 * 1024 * 1024
MAX_PAGES = 100


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files directly under a folder. ``content`` is left out, so no bytes are read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "false")
        .load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), "modificationTime")
    )
    if files.isEmpty():
        raise ValueError(f"no {pattern} files under {folder}")
    return files


def content_fingerprints(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.sha2("content", 256).alias("sha256"))
    )


def admission_rules(max_bytes: int = MAX_BYTES, max_pages: int = MAX_PAGES) -> dict[str, Column]:
    """Rules in checking order. Parser facts arrive as columns of a metadata table."""
    return {
        "extension": F.lower("filename").endswith(".pdf"),
        "exists": F.coalesce("is_regular_file", F.lit(False)),
        "not_empty": F.col("size_bytes") > 0,
        "size_limit": F.col("size_bytes") <= max_bytes,
        "readable": F.coalesce("is_pdf", F.lit(False)) & ~F.coalesce("encrypted", F.lit(False)),
        "has_pages": F.col("page_count") >= 1,
        "page_limit": F.col("page_count") <= max_pages,
    }


def admit(files: DataFrame, max_bytes: int = MAX_BYTES, max_pages: int = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with one reject_reason)."""
    checked = split_valid(files, admission_rules(max_bytes, max_pages))
    return (
        checked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.where(F.col("reject_reason").isNotNull()),
    )


def document_records(files: DataFrame, hashes: DataFrame, namespace_text: str) -> DataFrame:
    """Paper rows with a deterministic id derived from the content hash."""
    return files.join(hashes, "path").select(
        ids.uuid5(F.concat(F.lit(namespace_text), F.col("sha256"))).alias("paper_id"),
        F.col("path").alias("source_path"), "filename", "page_count", "size_bytes", "sha256",
    )


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sources whose facts changed while they were being loaded."""
    return status_compare(before, after, ["path"], "sha256").where("status <> 'same'")


def expand_pages(papers: DataFrame, root: str = "") -> DataFrame:
    """One row per page with its identity-safe image path."""
    folder = F.regexp_replace("paper_id", "-", "")
    return papers.withColumn("page_number", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int")))).withColumn(
        "image_path", F.concat(F.lit(root), folder, F.lit("/pages/"), ids.page_file(F.col("page_number")))
    )


def parse_key_values(lines: DataFrame, text: str = "line") -> DataFrame:
    """``key: value`` lines, split at the first colon only."""
    parts = F.split(F.col(text), ":", 2)
    return lines.where(F.col(text).contains(":")).withColumn("key", F.trim(parts[0])).withColumn("value", F.trim(parts[1]))


def parse_image_table(lines: DataFrame, text: str = "line") -> DataFrame:
    """Rows of an image listing: at least 14 columns with a numeric first one."""
    c = F.split(F.trim(F.col(text)), r"\s+")
    rows = lines.where((F.size(c) >= 14) & c[0].rlike("^[0-9]+$"))
    return rows.select(
        *[x for x in lines.columns if x != text],
        c[0].cast("int").alias("page"),
        c[3].cast("int").alias("width"),
        c[4].cast("int").alias("height"),
        c[8].alias("encoding"),
        c[12].cast("int").alias("x_ppi"),
        c[13].cast("int").alias("y_ppi"),
    )
