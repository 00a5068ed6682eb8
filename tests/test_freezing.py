"""Snapshot store, freezes, gates and sessions: each passing and each failing case."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import fingerprints as P
from scriptorium.plans import freezing as Z
from scriptorium.plans import labels as L
from scriptorium.plans.sessions import SessionLedger
from scriptorium.sources.snapshots import SnapshotError, SnapshotStore

BOX = "struct<x:int,y:int,width:int,height:int>"
KEYS = ["dataset_id"]
NOON = datetime(2024, 1, 1, 12, tzinfo=UTC)


def label_rows(spark, change=None):
    rows = [["a", "s1", "printed", "annotated", [(1, 2, 3, 4)], True], ["a", "s2", "unknown", "verified_empty", [], True], ["b", "s3", "student_candidate", "annotated", [(0, 0, 10, 10)], True]]
    if change:
        change(rows)
    return spark.createDataFrame(rows, f"dataset_id string, sample_id string, evidence_type string, answer_status string, boxes array<{BOX}>, human_verified boolean")


def sample_rows(spark, width=50):
    return spark.createDataFrame([("a", "s1", width, 50), ("a", "s2", width, 50), ("b", "s3", width, 50)], "dataset_id string, sample_id string, crop_width int, crop_height int")


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def test_freeze_and_verify(spark, store):
    record = Z.freeze_label_set(store, sample_rows(spark), label_rows(spark), KEYS, facts={"papers": 2}, now=NOON)
    assert record["created_at_utc"] == "2024-01-01T12:00:00Z" and record["facts"] == {"papers": 2} and store.record(record["fingerprint"]) == record
    assert {r.dataset_id: r.annotation_count for r in store.load(record["fingerprint"], "provenance").collect()} == {"a": 2, "b": 1}
    assert Z.verify_label_set(store, record["fingerprint"], KEYS).count() == 0
    assert Z.verified(store, record["fingerprint"], KEYS).count() == 3


def test_second_freeze_fails_and_leaves_the_first(spark, store):
    first = Z.freeze_label_set(store, sample_rows(spark), label_rows(spark), KEYS)
    with pytest.raises(SnapshotError, match="exists already"):
        Z.freeze_label_set(store, sample_rows(spark), label_rows(spark), KEYS)
    assert store.files.names("data") == [first["data"].split("/")[1]]
    assert Z.verify_label_set(store, first["fingerprint"], KEYS).count() == 0


def test_fingerprint_follows_content_and_manifest(spark, store):
    prints = {Z.freeze_label_set(store, *given, KEYS)["fingerprint"] for given in (
        (sample_rows(spark), label_rows(spark)), (sample_rows(spark, 60), label_rows(spark)), (sample_rows(spark), label_rows(spark, lambda r: r[0][4].append((0, 0, 1, 1))))
    )}
    assert len(prints) == 3 and len(store.history()) == 3


@pytest.mark.parametrize(("table", "column", "value", "problem"), [
    ("labels", "evidence_type", "printed", {"fingerprint_differs", "n_printed_differs", "n_unknown_differs", "n_student_candidate_differs"}),
    ("labels", "human_verified", False, {"not_human_verified", "fingerprint_differs"}),
    ("samples", "crop_height", 49, {"manifest_fingerprint_differs"}),
    ("provenance", "annotation_count", 7, {"annotation_count_differs"}),
    ("provenance", "fingerprint", "0" * 64, {"fingerprint_differs", "provenance_changed"}),
])
def test_tampering_is_found(spark, store, table, column, value, problem):
    record = Z.freeze_label_set(store, sample_rows(spark), label_rows(spark), KEYS)
    rows = store.load(record["fingerprint"], table)
    rows.withColumn(column, F.lit(value).cast(rows.schema[column].dataType)).checkpoint().write.mode("overwrite").parquet(f"{store.root}/{record['data']}/{table}")
    assert {r.problem for r in Z.verify_label_set(store, record["fingerprint"], KEYS).collect()} == problem
    with pytest.raises(Z.FreezeRefusedError):
        Z.verified(store, record["fingerprint"], KEYS)


def test_lost_files_are_found(spark, store):
    record = Z.freeze_label_set(store, sample_rows(spark), label_rows(spark), KEYS)
    rows = store.load(record["fingerprint"], "labels")
    rows.where("dataset_id = 'a'").checkpoint().write.mode("overwrite").parquet(f"{store.root}/{record['data']}/labels")
    assert {(r.dataset_id, r.sample_id, r.problem) for r in Z.verify_label_set(store, record["fingerprint"], KEYS).collect()} == {("b", None, "dataset_lost"), (None, "s3", "missing")}
    store.discard(type("S", (), {"name": record["data"]}))
    with pytest.raises(SnapshotError, match="no readable table"):
        Z.verify_label_set(store, record["fingerprint"], KEYS)
    with pytest.raises(SnapshotError, match="no snapshot"):
        store.record("0" * 64)


def test_half_written_commits(spark, store):
    stage = store.stage()
    stage.write("labels", label_rows(spark))
    assert store.history() == []
    store.files.create("commits/probe.json", {})
    with open(f"{store.root}/commits/{'1' * 64}.json", "w") as f:
        f.write('{"fingerprint": "')
    with pytest.raises(SnapshotError, match="not a complete record"):
        store.record("1" * 64)
    with pytest.raises(ValueError, match="not a fingerprint"):
        store.commit(stage, "abc")


@pytest.mark.parametrize(("change", "problem"), [
    (lambda r: r.pop(), {"missing": 1}),
    (lambda r: r.append(["b", "s9", "printed", "verified_empty", [], True]), {"unexpected": 1}),
    (lambda r: r.append(r[1]), {"duplicate_label": 1}),
    (lambda r: r[0].__setitem__(5, False), {"not_human_verified": 1}),
    (lambda r: r[0].__setitem__(2, "else"), {"unknown_class": 1}),
    (lambda r: r[0].__setitem__(3, "verified_empty"), {"answer_state": 1}),
    (lambda r: r[1].__setitem__(3, "annotated"), {"answer_state": 1}),
    (lambda r: r[0].__setitem__(4, [(49, 0, 2, 2)]), {"box_outside_crop": 1}),
    (lambda r: r[0].__setitem__(4, [(1, 1, 0, 2)]), {"box_not_positive": 1}),
])
def test_unfit_labels_are_refused_whole(spark, store, change, problem):
    with pytest.raises(Z.FreezeRefusedError) as refused:
        Z.freeze_label_set(store, sample_rows(spark), label_rows(spark, change), KEYS)
    assert refused.value.problems == problem
    assert store.files.names("commits") == [] and store.files.names("data") == []


def test_missing_images_and_empty_sets(spark, store):
    with pytest.raises(Z.FreezeRefusedError, match="image_missing: 2"):
        Z.freeze_label_set(store, sample_rows(spark), label_rows(spark), KEYS, images=sample_rows(spark).where("dataset_id = 'b'"))
    with pytest.raises(Z.FreezeRefusedError, match="empty"):
        Z.freeze_label_set(store, sample_rows(spark).limit(0), label_rows(spark).limit(0), KEYS)
    assert store.files.names("data") == []


def test_history_and_lineage(spark, store):
    one = Z.freeze_label_set(store, sample_rows(spark), label_rows(spark), KEYS, now=NOON)["fingerprint"]
    two = Z.freeze_label_set(store, sample_rows(spark, 60), label_rows(spark), KEYS, parents={"previous": one, "other": "f" * 64})["fingerprint"]
    assert [r["fingerprint"] for r in store.history()] == [one, two] and store.lineage(two) == [two, one]


def truth(spark, entered=("text", "None", "more"), empty=("s2",), notes=(("s1", "read twice"),), ids=("s1", "s2", "s3")):
    samples = spark.createDataFrame([("a", "s1", "n"), ("a", "s2", ""), ("b", "s3", None)], "dataset_id string, sample_id string, notes string")
    return samples, spark.createDataFrame(list(zip(ids, entered, strict=True)), "sample_id string, entered_text string"), spark.createDataFrame([(e,) for e in empty], "sample_id string"), spark.createDataFrame(list(notes), "sample_id string, note string")


@pytest.mark.parametrize(("given", "rule"), [
    ({"entered": ("text", "something", "more")}, {"unexpected_text_in_verified_empty"}),
    ({"entered": ("text", "None", " \n")}, {"pending_blank_transcription"}),
    ({"empty": ("s2", "s9")}, {"unknown_verified_empty"}),
    ({"notes": (("s9", "x"),)}, {"unknown_note"}),
    ({"notes": (("s1", " \t"),)}, {"blank_note"}),
    ({"notes": (("s1", "a"), ("s1", "b"))}, {"duplicate_note"}),
    ({"ids": ("s1", "s2", "s2"), "entered": ("text", "None", "none")}, {"duplicate_sample", "missing"}),
])
def test_ground_truth_is_all_or_nothing(spark, store, given, rule):
    frozen, problems = L.freeze_ground_truth(*truth(spark, **given))
    assert frozen.count() == 0 and {r.rule for r in problems.collect()} == rule
    with pytest.raises(Z.FreezeRefusedError):
        Z.freeze_ground_truth_set(store, *truth(spark, **given), KEYS)
    assert store.history() == []


@pytest.mark.parametrize("form", [P.canonical_fingerprint, P.tree_fingerprint])
def test_benchmark_gate(spark, store, form):
    record = Z.freeze_ground_truth_set(store, *truth(spark), KEYS, form=form)
    rows = store.load(record["fingerprint"], "ground_truth")
    assert {(r.sample_id, r.ground_truth_status, r.ground_truth_text, r.notes) for r in rows.collect()} == {("s1", "verified", "text", "n\nread twice"), ("s2", "verified_empty", "", ""), ("s3", "verified", "more", None)}

    def blocked(df):
        return {r.dataset_id: r.blocked_by for r in Z.gate_frozen_benchmark(store, record["fingerprint"], df, KEYS, form).collect()}

    assert blocked(rows) == {"a": None, "b": None}
    assert blocked(rows.withColumn("ground_truth_text", F.upper("ground_truth_text"))) == {"a": "fingerprint_mismatch", "b": "fingerprint_mismatch"}
    assert blocked(rows.withColumn("ground_truth_status", F.when(F.col("sample_id") == "s3", "pending").otherwise(F.col("ground_truth_status")))) == {"a": None, "b": "not_ready"}
    assert blocked(rows.where("sample_id <> 's1'")) == {"a": "not_ready", "b": None}
    assert blocked(rows.where("dataset_id = 'a'").unionByName(rows.where("dataset_id = 'b'").withColumn("dataset_id", F.lit("c")))) == {"a": None, "b": "not_ready", "c": "not_frozen"}
    with pytest.raises(SnapshotError):
        Z.gate_frozen_benchmark(store, "0" * 64, rows, KEYS)


def test_canonical_ground_truth_fingerprint_is_that_of_canonical_json(spark, store):
    import hashlib

    record = Z.freeze_ground_truth_set(store, *truth(spark), KEYS)
    value = {"fingerprint_version": "ocr-ground-truth-v1", "samples": [{"sample_id": "s1", "status": "verified", "student_text": "text"}, {"sample_id": "s2", "status": "verified_empty", "student_text": ""}]}
    expected = hashlib.sha256(json.dumps(value, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    assert store.load(record["fingerprint"], "provenance").where("dataset_id = 'a'").first().fingerprint == expected


def test_integrity_gate(spark, store):
    record = Z.freeze_label_set(store, sample_rows(spark), label_rows(spark), KEYS, facts={"papers": 3, "corpus": "abc"})
    seen = Z.observe({"papers": sample_rows(spark).agg(F.count("*")), "corpus": spark.range(1).select(F.lit("abc"))})
    assert Z.integrity_gate(store, record["fingerprint"], seen).count() == 0
    assert [tuple(r) for r in Z.integrity_gate(store, record["fingerprint"], seen.where("name = 'papers'"), {"papers": "4"}).orderBy("name").collect()] == [("corpus", None, "abc"), ("papers", "3", "4")]


def test_session_resumes_and_freezes(spark, store, tmp_path):
    books = SessionLedger(spark, str(tmp_path / "books"))
    labels, samples = label_rows(spark), sample_rows(spark)
    moment = lambda df, t: df.withColumn("approved_at", F.lit(t).cast("timestamp"))
    started = books.open(labels)
    assert started["started_from"] == P.canonical_fingerprint(L.with_record(labels), [], "sample_id", "record").first().fingerprint
    changed = label_rows(spark, lambda r: r[0].__setitem__(2, "unknown"))
    assert books.open(changed, started["session_id"]) == started

    def status(df):
        return {r.sample_id: r.status for r in books.status(started["session_id"], samples, df).collect()}

    assert status(labels) == {"s1": "missing", "s2": "missing", "s3": "missing"}
    for _ in range(2):
        books.approve(started["session_id"], 0, moment(labels.where("sample_id <> 's3'"), "2024-01-01"))
    assert books.approvals(started["session_id"]).count() == 2
    assert status(changed) == {"s1": "changed", "s2": "valid", "s3": "missing"}
    with pytest.raises(Z.FreezeRefusedError, match="changed: 1, missing: 1"):
        books.freeze(started["session_id"], store, samples, changed, KEYS)
    books.approve(started["session_id"], 1, moment(changed.where("sample_id <> 's2'"), "2024-01-02"))
    record = books.freeze(started["session_id"], store, samples, changed, KEYS)
    assert record["facts"] == {"session_id": started["session_id"], "reverification_count": 3, "started_from": started["started_from"]}
    assert Z.verify_label_set(store, record["fingerprint"], KEYS).count() == 0
    assert books.open(labels)["session_id"] != started["session_id"]
    with pytest.raises(SnapshotError, match="no session"):
        books.approve("00000000-0000-0000-0000-000000000000", 0, moment(labels, "2024-01-01"))
