"""Freezing of label sets and ground truth into snapshots, their verification, and what gates on them.

A freeze is all or nothing: the whole set is validated first, and one bad sample refuses it. The
rows are staged, fingerprints are taken from what was staged, and the snapshot is committed under
the fingerprint over all its datasets. Verification reloads the snapshot, validates it again
and recomputes every fingerprint and count; the stored record text is never trusted.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import fingerprints as P
from scriptorium.plans import labels as L
from scriptorium.sources.snapshots import SnapshotError, SnapshotStore

Form = Callable[..., DataFrame]


class FreezeRefusedError(RuntimeError):
    """The set is not fit to be frozen; ``problems`` counts what is wrong."""

    def __init__(self, problems: Mapping[str, int]) -> None:
        super().__init__(", ".join(f"{k}: {v}" for k, v in sorted(problems.items())))
        self.problems = dict(problems)


def refuse(problems: DataFrame, name: str = "problem") -> None:
    """Raises when there is any problem; at most one row per kind reaches the driver."""
    found = {r[name]: r["n"] for r in problems.groupBy(name).agg(F.count(F.lit(1)).alias("n")).collect()}
    if found:
        raise FreezeRefusedError(found)


def manifest_fingerprints(samples: DataFrame, keys: Sequence[str], form: Form) -> DataFrame:
    """Keys and ``manifest_fingerprint``: all columns of the samples count."""
    fields = {c: F.col(c) for c in samples.columns if c not in keys}
    rows = samples.withColumn("_record", P.canonical_json(fields))
    return form(rows, keys, "sample_id", "_record").select(*keys, F.col("fingerprint").alias("manifest_fingerprint"))


def set_fingerprint(provenance: DataFrame, keys: Sequence[str]) -> str | None:
    """One fingerprint over the fingerprints of all datasets; none for no dataset."""
    name = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in sorted(keys)]), {"ignoreNullFields": "false"})
    rows = provenance.select(name.alias("_name"), F.concat_ws(":", name, "fingerprint", "manifest_fingerprint").alias("_record"))
    return None if rows.isEmpty() else P.tree_fingerprint(rows, [], "_name", "_record").first()["fingerprint"]


def label_provenance(samples: DataFrame, labels: DataFrame, keys: Sequence[str], form: Form) -> DataFrame:
    _, counted = L.freeze_labels(labels.drop("record", "fingerprint"), keys, form)
    return counted.join(manifest_fingerprints(samples, keys, form), list(keys))


def freeze_label_set(
    store: SnapshotStore, samples: DataFrame, labels: DataFrame, keys: Sequence[str], *, images: DataFrame | None = None, parents: Mapping[str, str] | None = None,
    facts: Mapping[str, str | int] | None = None, form: Form = P.canonical_fingerprint, now: datetime | None = None,
) -> dict:
    """Validates and stores complete labels; returns the record of the snapshot.

    ``samples``: keys, sample_id, crop_width, crop_height. ``labels``: keys and a label per sample.
    """
    refuse(L.validate_labels(samples, labels, images).unionByName(L.label_problems(labels)))
    stage = store.stage()
    try:
        kept_samples = stage.write("samples", samples)
        kept = stage.write("labels", L.with_record(labels.drop("record", "fingerprint")))
        provenance = stage.write("provenance", label_provenance(kept_samples, kept, keys, form))
        fingerprint = set_fingerprint(provenance, keys)
        if fingerprint is None:
            raise FreezeRefusedError({"empty": 0})
    except BaseException:
        store.discard(stage)
        raise
    return store.commit(stage, fingerprint, parents=parents, facts=facts, now=now)


def _differences(recorded: DataFrame, now: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and ``problem`` for datasets whose stored provenance is not the recomputed one."""
    compared = [c for c in recorded.columns if c not in keys]
    a = recorded.select(*keys, F.lit(True).alias("_stored"), F.struct(*compared).alias("_old"))
    b = now.select(*keys, F.lit(True).alias("_found"), F.struct(*compared).alias("_new"))
    joined = a.join(b, list(keys), "full_outer")
    wrong = F.filter(F.array(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(f"{c}_differs")) for c in compared]), lambda p: p.isNotNull())
    whole = F.col("_stored").isNotNull() & F.col("_found").isNotNull()
    named = F.when(F.col("_stored").isNull(), F.array(F.lit("dataset_not_recorded"))).when(F.col("_found").isNull(), F.array(F.lit("dataset_lost"))).otherwise(wrong)
    return joined.where(~whole | (F.size(wrong) > 0)).select(*keys, F.explode(named).alias("problem"))


def verify_label_set(store: SnapshotStore, fingerprint: str, keys: Sequence[str], *, samples: DataFrame | None = None, images: DataFrame | None = None, form: Form = P.canonical_fingerprint) -> DataFrame:
    """Keys (NULL for problems of a sample or of the whole), sample_id, problem; no rows when all is well.

    ``samples`` is the manifest to hold the snapshot against, by default the stored one.
    """
    kept, recorded = store.load(fingerprint, "labels"), store.load(fingerprint, "provenance")
    manifest = store.load(fingerprint, "samples") if samples is None else samples
    nothing = [F.lit(None).cast(recorded.schema[k].dataType).alias(k) for k in keys]
    of_samples = L.validate_labels(manifest, kept, images).unionByName(L.label_problems(kept)).select(*nothing, "sample_id", "problem")
    now = label_provenance(manifest, kept, keys, form).select(*recorded.columns)
    of_sets = _differences(recorded, now, keys).withColumn("sample_id", F.lit(None).cast("string"))
    out = of_sets.select(*keys, "sample_id", "problem").unionByName(of_samples)
    if set_fingerprint(recorded, keys) != fingerprint:
        out = out.unionByName(store.spark.range(1).select(*nothing, F.lit(None).cast("string").alias("sample_id"), F.lit("provenance_changed").alias("problem")))
    return out


def verified(store: SnapshotStore, fingerprint: str, keys: Sequence[str], **given) -> DataFrame:
    """The labels of a snapshot that passes verification."""
    refuse(verify_label_set(store, fingerprint, keys, **given))
    return store.load(fingerprint, "labels")


# Ground truth ---------------------------------------------------------------------------------------


def ground_truth_provenance(rows: DataFrame, keys: Sequence[str], form: Form) -> DataFrame:
    facts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"), F.count_if(F.col("ground_truth_status") == "verified_empty").alias("verified_empty_count"))
    prints = _ground_truth_form(rows, keys, form)
    return facts.join(prints, list(keys)).withColumn("manifest_fingerprint", F.col("fingerprint"))


def _ground_truth_form(rows: DataFrame, keys: Sequence[str], form: Form) -> DataFrame:
    rows = rows.withColumn("record", L.ground_truth_record())
    if form is P.canonical_fingerprint:
        return form(rows, keys, "sample_id", "record", P.GROUND_TRUTH_ENVELOPE).select(*keys, "fingerprint")
    return form(rows, keys, "sample_id", "record").select(*keys, "fingerprint")


def freeze_ground_truth_set(
    store: SnapshotStore, samples: DataFrame, worksheet: DataFrame, verified_empty: DataFrame, notes: DataFrame, keys: Sequence[str], *,
    parents: Mapping[str, str] | None = None, form: Form = P.canonical_fingerprint, now: datetime | None = None,
) -> dict:
    """Stores ground truth entered by people, or refuses all of it. ``samples``: keys, sample_id, notes."""
    frozen, problems = L.freeze_ground_truth(samples, worksheet, verified_empty, notes)
    refuse(problems, "rule")
    stage = store.stage()
    try:
        kept = stage.write("ground_truth", frozen.join(samples.select(*keys, "sample_id"), "sample_id"))
        provenance = stage.write("provenance", ground_truth_provenance(kept, keys, form))
        fingerprint = set_fingerprint(provenance, keys)
        if fingerprint is None:
            raise FreezeRefusedError({"empty": 0})
    except BaseException:
        store.discard(stage)
        raise
    return store.commit(stage, fingerprint, parents=parents, now=now)


def gate_frozen_benchmark(store: SnapshotStore, fingerprint: str, samples: DataFrame, keys: Sequence[str], form: Form = P.canonical_fingerprint) -> DataFrame:
    """Per dataset: why the benchmark must not be scored, NULL when it may (see ``labels.gate_benchmark``)."""
    if not store.exists(fingerprint):
        raise SnapshotError(f"no snapshot {fingerprint}")
    return L.gate_benchmark(samples, store.load(fingerprint, "provenance"), keys, lambda rows, k: _ground_truth_form(rows, k, form))


# Integrity --------------------------------------------------------------------------------------------


def observe(facts: Mapping[str, DataFrame]) -> DataFrame:
    """(name, observed) from one-row, one-column results, evaluated together as one job's union."""
    out = None
    for name, df in facts.items():
        row = df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("string").alias("observed"))
        out = row if out is None else out.unionByName(row)
    return out


def integrity_gate(store: SnapshotStore, fingerprint: str, observed: DataFrame, more: Mapping[str, str] | None = None) -> DataFrame:
    """Facts recorded with a snapshot (and ``more``) that do not hold now: name, observed, expected."""
    expected = {k: str(v) for k, v in store.record(fingerprint)["facts"].items()} | dict(more or {})
    return L.compare_constants(observed, expected)
