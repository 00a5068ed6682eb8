"""Live labels: incremental state per sample, class totals without reading the log.

A stateful operator keeps for each sample the order and class of its current label, in the state
store of the stream. A micro-batch reads its own saves and the states of the samples in them,
nothing else; it gives a row for each sample whose label changed, with the class it had before.
``changes/batch_id=n`` stores these rows, ``totals/batch_id=n`` the class totals after the batch:
those of the batch before it plus what changed. Both are overwritten on replay, and a replayed
batch finds the state as it was, so repeating one changes nothing. Late saves older than the
current label change nothing either. Use the RocksDB state store for many samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scriptorium.functions.scoring import EVIDENCE_TYPES
from scriptorium.plans.labels import validated_saves
from scriptorium.sources.snapshots import Files
from scriptorium.streaming.labels import SAVE_SCHEMA, parse_saves

STATE = "ts timestamp, event_id long, evidence_type string"
CHANGE = "sample_id string, previous_type string, evidence_type string, ts timestamp, event_id long, answer_status string, human_verified boolean, boxes_json string"
BOXES = "array<struct<x:int,y:int,width:int,height:int>>"
TOTAL = "evidence_type string, samples long"


def newest(key: tuple, saves: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The latest save of a sample if it comes after the one in the state."""
    before = state.get if state.exists else None
    best = None
    for part in saves:
        top = part.sort_values(["ts", "event_id"]).iloc[-1]
        if best is None or (top["ts"], top["event_id"]) > (best["ts"], best["event_id"]):
            best = top
    if best is None or (before is not None and (best["ts"], best["event_id"]) <= (pd.Timestamp(before[0]), before[1])):
        return
    state.update((best["ts"].to_pydatetime(), int(best["event_id"]), best["evidence_type"]))
    yield pd.DataFrame([{
        "sample_id": key[0], "previous_type": before[2] if before is not None else None, "evidence_type": best["evidence_type"], "ts": best["ts"], "event_id": int(best["event_id"]),
        "answer_status": best["answer_status"], "human_verified": bool(best["human_verified"]), "boxes_json": best["boxes_json"],
    }])


def totals_after(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """Samples per class after a batch; no rows before the first."""
    if batch_id < 0:
        return spark.createDataFrame([], TOTAL)
    return spark.read.schema(TOTAL).parquet(f"{root}/totals/batch_id={batch_id}")


def store_changes(changes: DataFrame, batch_id: int, root: str) -> None:
    """Stores what changed, then the totals that follow from it."""
    spark = changes.sparkSession
    kept = f"{root}/changes/batch_id={batch_id}"
    changes.withColumn("boxes", F.from_json("boxes_json", BOXES)).drop("boxes_json").write.mode("overwrite").parquet(kept)
    moved = spark.read.schema("previous_type string, evidence_type string").parquet(kept)
    moves = F.array(F.struct(F.col("evidence_type"), F.lit(1).cast("long").alias("samples")), F.struct(F.col("previous_type").alias("evidence_type"), F.lit(-1).cast("long").alias("samples")))
    delta = moved.select(F.inline(moves)).where(F.col("evidence_type").isNotNull())
    after = totals_after(spark, root, batch_id - 1).unionByName(delta).groupBy("evidence_type").agg(F.sum("samples").alias("samples"))
    after.coalesce(1).write.mode("overwrite").parquet(f"{root}/totals/batch_id={batch_id}")


def last_batch(spark: SparkSession, root: str) -> int:
    """The last batch with totals; -1 before the first."""
    files = Files(spark, root)
    found = [int(name.removeprefix("batch_id=")) for name in files.names("totals") if name.startswith("batch_id=")]
    return next((b for b in sorted(found, reverse=True) if "_SUCCESS" in files.names(f"totals/batch_id={b}")), -1)


def live_progress(spark: SparkSession, root: str, total: int) -> DataFrame:
    """Completed and total samples, readiness and class distribution, from the last totals alone."""
    rows = totals_after(spark, root, last_batch(spark, root))
    counted = lambda c: F.coalesce(F.sum(F.when(F.col("evidence_type") == c, F.col("samples"))), F.lit(0)).cast("long")
    return rows.agg(
        F.coalesce(F.sum("samples"), F.lit(0)).cast("long").alias("completed"), F.lit(total).cast("long").alias("total"), *[counted(c).alias(f"n_{c}") for c in EVIDENCE_TYPES],
    ).withColumn("ready", F.col("completed") == F.col("total"))


def live_labels(spark: SparkSession, root: str) -> DataFrame:
    """Current labels from the stored changes: the last change of each sample."""
    rows = spark.read.parquet(f"{root}/changes").drop("previous_type", "batch_id")
    rest = [c for c in rows.columns if c != "sample_id"]
    return rows.groupBy("sample_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("_s")).select("sample_id", "_s.*")


def start_live_labels(
    spark: SparkSession, source: str, samples: DataFrame, *, root: str, checkpoint: str, on_batch: Callable[[int], None] | None = None, files_per_batch: int = 100, available_now: bool = False,
) -> StreamingQuery:
    """Start the stream over JSON save files; rejected saves do not count here (see ``labels.start_label_stream``)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        store_changes(batch, batch_id, root)
        if on_batch is not None:
            on_batch(batch_id)

    raw = spark.readStream.schema(SAVE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source)
    valid = validated_saves(parse_saves(raw), samples).where(F.col("reject_reason").isNull())
    rows = valid.select("sample_id", "ts", "event_id", "evidence_type", "answer_status", "human_verified", F.to_json("boxes").alias("boxes_json"))
    changes = rows.groupBy("sample_id").applyInPandasWithState(newest, CHANGE, STATE, "update", GroupStateTimeout.NoTimeout)
    writer = changes.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
