"""Label saves as a stream: current labels and live progress.

Each micro-batch appends valid saves to a log table and rejected ones to a quarantine table,
partitioned by batch id and written with overwrite, so replaying a batch changes nothing.
Current labels are the same batch operator over the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.plans.labels import current_labels, progress, strict_boxes, validated_saves

SAVE_SCHEMA = (
    "event_id long, ts timestamp, sample_id string, evidence_type string, answer_status string, "
    "answer_regions string, human_verified boolean"
)


def parse_saves(raw: DataFrame) -> DataFrame:
    return raw.withColumn("boxes", strict_boxes(F.col("answer_regions"))).drop("answer_regions")


def _store(df: DataFrame, root: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def apply_batch(saves: DataFrame, batch_id: int, samples: DataFrame, log: str, quarantine: str) -> None:
    checked = validated_saves(saves, samples).persist()
    try:
        _store(checked.where(F.col("reject_reason").isNull()).drop("reject_reason"), log, batch_id)
        _store(checked.where(F.col("reject_reason").isNotNull()), quarantine, batch_id)
    finally:
        checked.unpersist()


def read_current(spark: SparkSession, log: str) -> DataFrame:
    """Latest valid save per sample; event time decides, then the event id."""
    return current_labels(spark.read.parquet(log).drop("batch_id"), ["ts", "event_id"])


def start_label_stream(
    spark: SparkSession,
    source: str,
    samples: DataFrame,
    *,
    log: str,
    quarantine: str,
    checkpoint: str,
    on_progress: Callable[[DataFrame, int], None] | None = None,
    files_per_batch: int = 100,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the stream over JSON save files; ``on_progress`` receives the progress row."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, samples, log, quarantine)
        if on_progress is not None:
            on_progress(progress(samples, read_current(batch.sparkSession, log)), batch_id)

    raw = spark.readStream.schema(SAVE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source)
    writer = parse_saves(raw).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
