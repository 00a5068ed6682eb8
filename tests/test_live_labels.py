"""Live state: totals after every batch equal a loop over the saves so far, and no batch reads the past."""

import json
import os
import random

from scriptorium.streaming import live as V

CLASSES = ["printed", "student_candidate", "teacher_candidate", "unknown"]


def saves(rng, n):
    rows = []
    for i in range(n):
        empty = rng.random() < 0.3
        rows.append({
            "event_id": i, "ts": f"2024-01-01T00:00:{rng.randrange(40):02d}Z", "sample_id": f"s{rng.randrange(6)}" if rng.random() < 0.9 else "nobody", "evidence_type": rng.choice(CLASSES),
            "answer_status": "verified_empty" if empty else "annotated", "answer_regions": json.dumps([] if empty else [{"bbox": {"x": 1, "y": 2, "width": rng.choice([0, 5, 5, 5]), "height": 5}}]), "human_verified": True,
        })
    return rows


def valid(row):
    boxes = json.loads(row["answer_regions"])
    return row["sample_id"] != "nobody" and all(b["bbox"]["width"] > 0 for b in boxes)


def by_loop(rows):
    best = {}
    for r in filter(valid, rows):
        if r["sample_id"] not in best or (r["ts"], r["event_id"]) > (best[r["sample_id"]]["ts"], best[r["sample_id"]]["event_id"]):
            best[r["sample_id"]] = r
    return best


def test_totals_follow_every_batch(spark, tmp_path):
    rows = saves(random.Random(4), 90)
    files = [rows[k : k + 18] for k in range(0, 90, 18)]
    (tmp_path / "saves").mkdir()
    samples = spark.createDataFrame([(f"s{i}", 100, 100) for i in range(7)], "sample_id string, crop_width int, crop_height int")
    root, seen = str(tmp_path / "live"), []

    def run():
        V.start_live_labels(
            spark, str(tmp_path / "saves"), samples, root=root, checkpoint=str(tmp_path / "ck"), files_per_batch=1, available_now=True,
            on_batch=lambda b: seen.append({r.evidence_type: r.samples for r in V.totals_after(spark, root, b).collect() if r.samples}),
        ).awaitTermination()

    for n, part in enumerate(files):
        (tmp_path / "saves" / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(tmp_path / "saves" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
        if n in (1, 4):  # started twice: the second run resumes from the stored state
            run()
    assert len(seen) == 5
    for n, totals in enumerate(seen):
        best = by_loop(sum(files[: n + 1], []))
        assert totals == {c: k for c in CLASSES if (k := sum(r["evidence_type"] == c for r in best.values()))}
    best = by_loop(rows)
    got = {r.sample_id: (r.event_id, r.evidence_type, r.answer_status, len(r.boxes)) for r in V.live_labels(spark, root).collect()}
    assert got == {s: (r["event_id"], r["evidence_type"], r["answer_status"], len(json.loads(r["answer_regions"]))) for s, r in best.items()}
    progress = V.live_progress(spark, root, 7).first()
    assert (progress.completed, progress.total, progress.ready) == (len(best), 7, len(best) == 7)
    # No batch holds more changes than there are samples, nor anything of an earlier batch.
    stored = spark.read.parquet(f"{root}/changes").groupBy("batch_id", "sample_id").count().collect()
    assert all(r["count"] == 1 for r in stored)


def test_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "live")
    change = lambda rows: spark.createDataFrame(rows, V.CHANGE.replace("ts timestamp", "ts string")).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["to_timestamp"]).to_timestamp("ts"))
    first = change([("s1", None, "printed", "2024-01-01", 1, "verified_empty", True, "[]"), ("s2", None, "printed", "2024-01-01", 2, "verified_empty", True, "[]")])
    second = change([("s1", "printed", "unknown", "2024-01-02", 3, "annotated", True, '[{"x":1,"y":2,"width":3,"height":4}]')])
    for batch, rows in ((0, first), (1, second), (1, second)):
        V.store_changes(rows, batch, root)
    assert {r.evidence_type: r.samples for r in V.totals_after(spark, root, 1).collect()} == {"printed": 1, "unknown": 1}
    assert V.last_batch(spark, root) == 1 and V.last_batch(spark, str(tmp_path / "none")) == -1
    assert V.live_progress(spark, str(tmp_path / "none"), 3).first().completed == 0
    assert [tuple(r.boxes[0]) for r in V.live_labels(spark, root).where("sample_id = 's1'").collect()] == [(1, 2, 3, 4)]
