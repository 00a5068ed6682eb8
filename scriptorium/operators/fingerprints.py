"""Canonical record JSON and dataset fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON with sorted keys; NULL fields are written out."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def annotation_json(boxes: Column) -> Column:
    """Canonical JSON of one label; ``boxes`` is an array of box structs in drawn order."""
    rectangles = F.transform(
        boxes,
        lambda b: F.struct(
            F.struct(
                b["height"].alias("height"), b["width"].alias("width"), b["x"].alias("x"), b["y"].alias("y")
            ).alias("bbox")
        ),
    )
    return canonical_json(
        {
            "sample_id": F.col("sample_id"),
            "evidence_type": F.col("evidence_type"),
            "answer_status": F.col("answer_status"),
            "human_verified": F.col("human_verified"),
            "answer_regions": rectangles,
        }
    )


def record_fingerprint(record: Column) -> Column:
    return F.sha2(record, 256)


ANNOTATION_ENVELOPE = ('{"annotations":[', '],"schema_version":"1.0"}')
GROUND_TRUTH_ENVELOPE = ('{"fingerprint_version":"ocr-ground-truth-v1","samples":[', "]}")


def canonical_fingerprint(
    records: DataFrame, keys: Sequence[str], record_id: str, record: str, envelope: tuple[str, str] = ANNOTATION_ENVELOPE
) -> DataFrame:
    """Hash of one JSON document per dataset, with the number of records.

    The document is a single string by definition of this form, so it suits label sets that
    people enter. For sets of any size call ``tree_fingerprint``; the choice is the caller's.
    """
    document = F.concat(
        F.lit(envelope[0]),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(record_id).alias("_id"), F.col(record).alias("_rec")))), lambda r: r["_rec"]), ","),
        F.lit(envelope[1]),
    )
    return records.groupBy(*keys).agg(F.sha2(document, 256).alias("fingerprint"), F.count(F.lit(1)).alias("record_count"))


#: Hexadecimal digits of the record id's hash that name a node, from the leaves up.
TREE_DIGITS = (10, 7, 4, 2)


def tree_fingerprint(
    records: DataFrame, keys: Sequence[str], record_id: str, record: str, digits: Sequence[int] = TREE_DIGITS, tie: str | None = None
) -> DataFrame:
    """Order-independent hash tree over records; nodes are named by the hash of the record id.

    Records of one id follow each other by ``tie``, else by their own hash.

    A node has at most 16 to the number of digits between two levels of children, and a leaf of
    ten digits holds about one record in 10^12, so no task collects a long list.
    """
    keys = list(keys)
    nodes = records.select(
        *keys, F.sha2(F.col(record_id).cast("string"), 256).alias("_node"), F.struct(
            F.col(record_id).alias("id"), (F.lit(0) if tie is None else F.col(tie)).alias("tie")
        ).alias("_order"),
        F.sha2(F.col(record), 256).alias("_h"),
    )

    def above(rows: DataFrame, *group) -> DataFrame:
        inside = F.array_sort(F.collect_list(F.struct("_order", "_h")))
        return rows.groupBy(*keys, *group).agg(F.sha2(F.array_join(F.transform(inside, lambda r: r["_h"]), ""), 256).alias("_h"))

    for n in digits:
        nodes = above(nodes, F.substring("_node", 1, n).alias("_up"))
        nodes = nodes.select(*keys, F.col("_up").alias("_node"), F.col("_up").alias("_order"), "_h")
    return above(nodes).withColumnRenamed("_h", "fingerprint")


def duplicate_content(df: DataFrame, content: str) -> DataFrame:
    """Content hashes that occur more than once; counts use partial aggregation."""
    return (
        df.groupBy(F.sha2(F.col(content), 256).alias("content_sha256"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )
