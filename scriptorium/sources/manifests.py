"""Manifests, predictions, worksheets, and metadata refresh."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,width:int,height:int>"
CORRUPT = "corrupt_record"
# One schema per manifest kind; every sample field is typed, nothing is inferred.
MANIFESTS = {
    "ocr": (
        "schema_version string, samples array<struct<sample_id:string,paper_alias:string,page_number:int,"
        f"image_path:string,image_width:int,image_height:int,region:{BOX},difficulty:string,"
        "categories:array<string>,printed_content_present:boolean,teacher_annotations_present:boolean,"
        "transcription_target:string,ground_truth_status:string,ground_truth_student_text:string,notes:string>>"
    ),
    "structure": (
        "schema_version string, human_verified boolean, papers array<struct<paper_alias:string,source_path:string,"
        f"expected_page_count:int,expected_markers:array<struct<test_number:int,page_number:int,bbox:{BOX}>>>>"
    ),
    "evidence": (
        "schema_version string, samples array<struct<sample_id:string,paper_alias:string,page_number:int,"
        f"test_number:int,source_image_path:string,page_width:int,page_height:int,region:{BOX},"
        "categories:array<string>,human_status:string,ground_truth_evidence_type:string,"
        f"answer_regions_verified:boolean,ground_truth_answer_regions:array<struct<bbox:{BOX}>>>>"
    ),
    "expansion": (
        "schema_version string, benchmark_name string, samples array<struct<sample_id:string,paper_alias:string,"
        "page_number:int,test_number:int,source_image_path:string,source_image_sha256:string,page_width:int,"
        f"page_height:int,region:{BOX},discovery_category:string,context_tags:array<string>,discovery_reason:string>>"
    ),
    "mark_risk": (
        "schema_version string, dataset_id string, candidate_generation_version string, samples array<struct<"
        "sample_id:string,paper_alias:string,page_number:int,test_number:int,source_image_path:string,"
        f"source_image_sha256:string,page_width:int,page_height:int,region:{BOX},candidate_component:{BOX},"
        "discovery_category:string,discovery_signals:array<string>,selection_rank:int,discovery_reason:string>>"
    ),
}


def _children(kind: str) -> str:
    return "papers" if kind == "structure" else "samples"


def read_manifest(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(one row per sample or paper, corrupt documents) of JSON manifests under ``path``."""
    documents = (
        spark.read.schema(f"{MANIFESTS[kind]}, {CORRUPT} string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
        .withColumn("manifest_path", F.input_file_name())
    )
    return explode_manifest(documents, kind)


def parse_manifest(documents: DataFrame, text: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The same for manifest texts held in a column, e.g. one document per row."""
    parsed = F.from_json(
        F.col(text), f"{MANIFESTS[kind]}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    return explode_manifest(documents.withColumn("_m", parsed).select(*[c for c in documents.columns if c != text], "_m.*"), kind)


def explode_manifest(documents: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    child = _children(kind)
    bad = F.col(CORRUPT).isNotNull() | F.col(child).isNull()
    good = documents.where(~bad).drop(CORRUPT)
    rows = good.select(*[c for c in good.columns if c != child], F.posexplode(child).alias("position", "_s"))
    return rows.select(*[c for c in rows.columns if c != "_s"], "_s.*"), documents.where(bad)


def read_predictions(spark: SparkSession, path: str, evidence: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, sample ids that occur more than once)."""
    rows = (
        spark.read.schema(f"samples array<struct<sample_id:string,evidence:{evidence}>>")
        .option("multiLine", True)
        .json(path)
        .select(F.explode("samples").alias("s"))
        .select("s.*")
    )
    return reject_duplicates(rows, ["sample_id"])


def reject_duplicates(rows: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    return rows.join(repeated.select(*key), list(key), "left_anti"), repeated


WORKSHEET_MARKER = "Ground truth student text:\n"


def parse_worksheet(documents: DataFrame, text: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(sample_id, entered_text rows; violations) from Markdown worksheets."""
    keys = list(keys)
    sections = F.regexp_extract_all(
        F.col(text), F.lit(r"(?ms)^## Sample \d{3,}\n(.*?)(?=^## Sample \d{3,}\n|\z)"), F.lit(1)
    )
    listed = documents.select(*keys, sections.alias("_all"))
    bodies = listed.select(*keys, F.posexplode("_all").alias("position", "body"))
    parsed = bodies.select(
        *keys,
        "position",
        F.regexp_extract("body", r"(?m)^Sample ID: ([a-z0-9_-]+)$", 1).alias("sample_id"),
        F.locate(WORKSHEET_MARKER, F.col("body")).alias("_at"),
        "body",
    )
    fine = (F.col("sample_id") != "") & (F.col("_at") > 0)
    rows = parsed.where(fine).select(
        *keys, "position", "sample_id",
        F.regexp_replace(
            F.expr(f"substring(body, _at + {len(WORKSHEET_MARKER)})"), r"\n+\z", ""
        ).alias("entered_text"),
    )
    invalid = parsed.where(~fine).select(*keys, F.lit("invalid_section").alias("rule"))
    empty = listed.where(F.size("_all") == 0).select(*keys, F.lit("no_samples").alias("rule"))
    repeated = rows.groupBy(*keys, "sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        *keys, F.lit("duplicate_sample_id").alias("rule")
    )
    return rows, invalid.unionByName(empty).unionByName(repeated)


def transcription_section() -> Column:
    """Markdown section of one sample; needs ``position`` (1-based) and the sample columns."""
    region = F.when(F.col("region").isNull(), "Full page").otherwise(
        F.format_string(
            "x=%d, y=%d, width=%d, height=%d",
            F.col("region.x"), F.col("region.y"), F.col("region.width"), F.col("region.height"),
        )
    )
    return F.concat_ws(
        "\n",
        F.format_string("## Sample %03d", F.col("position")),
        F.lit(""),
        F.concat(F.lit("Sample ID: "), F.col("sample_id")),
        F.concat(F.lit("Paper alias: "), F.col("paper_alias")),
        F.concat(F.lit("Page: "), F.col("page_number")),
        F.concat(F.lit("Difficulty: "), F.col("difficulty")),
        F.concat(F.lit("Category: "), F.array_join("categories", ", ")),
        F.concat(
            F.lit("Teacher annotations present/expected: "),
            F.when(F.col("teacher_annotations_present"), "Yes").otherwise("No"),
        ),
        F.concat(F.lit("Region: "), region),
        F.lit("Ground truth student text:"),
        F.lit(""),
        F.lit(""),
    )


def labelling_section() -> Column:
    region = F.format_string(
        "Page region: %d,%d,%d,%d",
        F.col("region.x"), F.col("region.y"), F.col("region.width"), F.col("region.height"),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.col("sample_id")),
        F.lit(""),
        F.concat(F.lit("Paper alias: "), F.col("paper_alias")),
        F.concat(F.lit("Page: "), F.col("page_number")),
        F.format_string("Test: %02d", F.col("test_number")),
        F.concat(F.lit("Selection categories: "), F.array_join("categories", ", ")),
        region,
        F.lit("Ground-truth evidence class:"),
        F.lit("Answer regions (crop-relative x,y,width,height; use [] if none):"),
        F.lit("Human verification state: pending"),
        F.lit("Notes:"),
        F.lit(""),
    )


def render_worksheet(samples: DataFrame, keys: Sequence[str], section, header: Sequence[str] = ()) -> DataFrame:
    """One Markdown document per dataset, sections in manifest order.

    A worksheet is filled in by a person, so a dataset's document is one string by nature.
    """
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("position", section.alias("s")))), lambda v: v["s"]), "\n"
    )
    title = "\n".join([*header, ""]) + "\n" if header else ""
    return samples.groupBy(*keys).agg(F.concat(F.lit(title), body).alias("worksheet"))


def resolve_aliases(samples: DataFrame, sources: DataFrame, alias: str = "paper_alias") -> tuple[DataFrame, DataFrame]:
    """(samples with their source, aliases without a source)."""
    missing = samples.select(alias).distinct().join(sources.select(alias), alias, "left_anti")
    return samples.join(sources, alias), missing


def refresh_page_metadata(samples: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace image path and size by those of the canonical page; report missing pages."""
    key = ["paper_alias", "page_number"]
    found = samples.drop("image_path", "image_width", "image_height").join(
        pages.select(
            *key, "image_path", F.col("width").alias("image_width"), F.col("height").alias("image_height")
        ),
        key,
    )
    return found, samples.join(pages.select(*key), key, "left_anti")


def pending_papers(papers: DataFrame, stored: DataFrame, stored_pages: DataFrame) -> DataFrame:
    """Work status per paper: new, stale (other digest), incomplete or reusable."""
    kept = stored.select("paper_id", F.col("sha256").alias("stored_sha256"))
    counted = stored_pages.groupBy("paper_id").agg(
        F.count_if(F.col("page_number") >= 1).alias("stored_pages"), F.max("page_number").alias("last_page")
    )
    return (
        papers.join(kept, "paper_id", "left")
        .join(counted, "paper_id", "left")
        .withColumn(
            "reuse_status",
            F.when(F.col("stored_sha256").isNull(), "new")
            .when(F.col("stored_sha256") != F.col("sha256"), "stale")
            .when(
                ~F.coalesce((F.col("stored_pages") == F.col("page_count")) & (F.col("last_page") == F.col("page_count")), F.lit(False)),
                "incomplete",
            )
            .otherwise("reusable"),
        )
    )


def rename_legacy(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Move a legacy field to its new name unless the new one already has a value."""
    for old, new in renames.items():
        if old not in df.columns:
            continue
        value = F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)
        df = df.withColumn(new, value).drop(old)
    return df
