"""Sessions in which people approve labels again, kept as an append-only ledger.

A session starts from the fingerprint of the labels as they are; its start is a file that is
created once, so opening a session again resumes it with that first fingerprint. Approvals are
appended in numbered batches; writing a batch again replaces the same folder and changes nothing.
An approval holds while the label's content is the approved one.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import fingerprints as P
from scriptorium.plans import freezing as Z
from scriptorium.plans import labels as L
from scriptorium.sources.snapshots import Files, SnapshotError, SnapshotStore

APPROVAL = "batch long, approved_at timestamp, sample_id string, approved_fingerprint string"


class SessionLedger:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def open(self, labels: DataFrame, session_id: str | None = None, *, form: Z.Form = P.canonical_fingerprint, now: datetime | None = None) -> dict:
        """Starts a session, or resumes the one of that id with the fingerprint it started from."""
        session_id = str(uuid.UUID(session_id)) if session_id else str(uuid.uuid4())
        if found := self.files.read(f"sessions/{session_id}.json"):
            return found
        row = form(L.with_record(labels.drop("record", "fingerprint")), [], "sample_id", "record").first()
        started = {"session_id": session_id, "started_from": row["fingerprint"] if row else None, "started_at_utc": (now or datetime.now(UTC)).astimezone(UTC).isoformat()}
        try:
            self.files.create(f"sessions/{session_id}.json", started)
        except SnapshotError:
            return self.session(session_id)
        return started

    def session(self, session_id: str) -> dict:
        found = self.files.read(f"sessions/{session_id}.json")
        if found is None:
            raise SnapshotError(f"no session {session_id}")
        return found

    def approve(self, session_id: str, batch: int, labels: DataFrame, moment: str = "approved_at") -> None:
        """Records that these labels, as they read now, were approved. ``moment`` is their time column."""
        self.session(session_id)
        rows = L.with_record(labels.drop("record", "fingerprint"))
        rows = rows.select(F.col(moment).alias("approved_at"), "sample_id", F.col("fingerprint").alias("approved_fingerprint"))
        rows.write.mode("overwrite").parquet(f"{self.root}/approvals/session={session_id}/batch={int(batch)}")

    def approvals(self, session_id: str) -> DataFrame:
        """The last approval of each sample; its time decides, then the batch."""
        self.session(session_id)
        if not self.files.names(f"approvals/session={session_id}"):
            return self.spark.createDataFrame([], APPROVAL)
        rows = self.spark.read.schema(APPROVAL).parquet(f"{self.root}/approvals/session={session_id}")
        return L.current_labels(rows, ["approved_at", "batch", "approved_fingerprint"])

    def status(self, session_id: str, samples: DataFrame, labels: DataFrame) -> DataFrame:
        """valid, changed or missing per sample, or unknown_sample."""
        return L.reverification_status(samples, L.with_record(labels.drop("record", "fingerprint")), self.approvals(session_id))

    def freeze(
        self, session_id: str, store: SnapshotStore, samples: DataFrame, labels: DataFrame, keys: Sequence[str], *, images: DataFrame | None = None,
        parents: Mapping[str, str] | None = None, form: Z.Form = P.canonical_fingerprint, now: datetime | None = None,
    ) -> dict:
        """Freezes labels all of which were approved in this session and not changed since."""
        status = self.status(session_id, samples, labels)
        Z.refuse(status.where("status <> 'valid'").withColumnRenamed("status", "problem"))
        facts = {"session_id": session_id, "reverification_count": status.count(), "started_from": self.session(session_id)["started_from"]}
        return Z.freeze_label_set(store, samples, labels, keys, images=images, parents=parents, facts=facts, form=form, now=now)
