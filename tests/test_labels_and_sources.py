"""Label store, streams, files on disk, and reports."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import ids
from scriptorium.functions import text as T
from scriptorium.plans import labels as L
from scriptorium.sources import inventory as I
from scriptorium.sources import manifests as M
from scriptorium.sources import sinks as K
from scriptorium.sources import words as W
from scriptorium.streaming import labels as ST

BOX = "struct<x:int,y:int,width:int,height:int>"
LABEL = f"sample_id string, evidence_type string, answer_status string, boxes array<{BOX}>, human_verified boolean"
ROWS = [("s2", "printed", "annotated", [(1, 2, 3, 4), (5, 6, 7, 8)], True), ("s1", "unknown", "verified_empty", [], True)]


def python_record(row):
    return {
        "sample_id": row[0], "evidence_type": row[1], "answer_status": row[2], "human_verified": row[4],
        "answer_regions": [{"bbox": dict(zip(("x", "y", "width", "height"), b, strict=True))} for b in row[3]],
    }


def canonical(value):
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def test_fingerprints_equal_canonical_json(spark):
    df = spark.createDataFrame(ROWS, LABEL).withColumn("dataset_id", F.lit("d"))
    records = {r.sample_id: r.fingerprint for r in L.with_record(df).collect()}
    assert records == {r[0]: canonical(python_record(r)) for r in ROWS}
    expected = canonical({"schema_version": "1.0", "annotations": [python_record(r) for r in sorted(ROWS)]})
    _, p = L.freeze_labels(df, ["dataset_id"])
    assert p.first().fingerprint == expected
    swapped = df.withColumn("boxes", F.reverse("boxes"))
    assert L.verify_frozen(df, p, ["dataset_id"]).count() == 0
    assert L.verify_frozen(swapped, p, ["dataset_id"]).count() == 1


def test_uuid5(spark):
    texts = ["paper-a", "prüfung/1", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ids.uuid5(F.col("t"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in texts]


def test_strict_boxes(spark):
    good = '[{"bbox": {"x": 0, "y": 2, "width": 3, "height": 4}}]'
    bad = [good.replace("3", '"3"'), good.replace("3", "3.0"), good.replace(', "height": 4', ""), good.replace("4}", '4, "z": 1}'), "{}", None]
    rows = spark.createDataFrame([(t,) for t in [good, "[]", *bad]], "t string").select(L.strict_boxes(F.col("t")).alias("b")).collect()
    assert [None if r.b is None else len(r.b) for r in rows] == [1, 0] + [None] * len(bad)


def test_version_history_across_buckets(spark):
    saves = [(i, f"2024-01-0{1 + i // 2} 00:00:0{i}", "s", kind) for i, kind in enumerate(["printed", "printed", "printed", "unknown", "unknown", "printed"])]
    df = spark.createDataFrame(saves, "event_id int, ts string, sample_id string, evidence_type string").select(
        "event_id", F.to_timestamp("ts").alias("ts"), "sample_id", "evidence_type", F.lit("verified_empty").alias("answer_status"),
        F.array().cast(f"array<{BOX}>").alias("boxes"), F.lit(True).alias("human_verified"),
    )
    kept = sorted(r.event_id for r in L.version_history(df, "ts", "event_id", F.date_trunc("day", "ts")).collect())
    assert kept == [0, 3, 5]


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    saves = tmp_path / "saves"
    saves.mkdir()
    events = [
        {"event_id": i, "ts": f"2024-01-01T00:00:{i:02d}Z", "sample_id": f"s{i % 3}", "evidence_type": ["printed", "unknown"][i % 2], "answer_status": "annotated",
         "answer_regions": json.dumps([{"bbox": {"x": i, "y": 0, "width": 5 if i != 7 else 0, "height": 5}}]), "human_verified": True}
        for i in range(10)
    ] + [{"event_id": 50, "ts": "2024-01-01T00:01:00Z", "sample_id": "nobody", "evidence_type": "printed", "answer_status": "verified_empty", "answer_regions": "[]", "human_verified": True}]
    for n in range(0, len(events), 4):
        (saves / f"{n}.json").write_text("\n".join(json.dumps(e) for e in events[n:n + 4]))
    samples = spark.createDataFrame([(f"s{i}", 100, 100) for i in range(3)], "sample_id string, crop_width int, crop_height int")
    log, quarantine = str(tmp_path / "log"), str(tmp_path / "quarantine")
    seen = []
    q = ST.start_label_stream(
        spark, str(saves), samples, log=log, quarantine=quarantine, checkpoint=str(tmp_path / "ck"), files_per_batch=1, available_now=True,
        on_progress=lambda df, _: seen.append(df.first().completed),
    )
    q.awaitTermination()
    current = {r.sample_id: r.event_id for r in ST.read_current(spark, log).collect()}
    assert current == {"s0": 9, "s1": 4, "s2": 8}
    assert {r.event_id: r.reject_reason for r in spark.read.parquet(quarantine).collect()} == {7: "positive_boxes", 50: "known_sample"}
    assert seen[-1] == 3
    batch = ST.parse_saves(spark.read.schema(ST.SAVE_SCHEMA).json(str(saves / "0.json")))
    before = spark.read.parquet(log).count()
    ST.apply_batch(batch, 0, samples, str(tmp_path / "log2"), str(tmp_path / "q2"))
    ST.apply_batch(batch, 0, samples, str(tmp_path / "log2"), str(tmp_path / "q2"))
    assert spark.read.parquet(str(tmp_path / "log2")).count() == 4 and spark.read.parquet(log).count() == before


def test_inventory_admission_and_hash(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"x")
    files = I.file_inventory(spark, str(tmp_path))
    assert [(r.filename, r.size_bytes) for r in files.collect()] == [("a.pdf", 3)]
    assert I.content_fingerprints(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    with pytest.raises(ValueError):
        I.file_inventory(spark, str(tmp_path), "*.none")


def test_word_ingest_golden(spark):
    schema = "page int, " + ", ".join(f"{c} array<string>" for c in W.ARRAYS)
    ok = (1, ["A", " ", "B"], ["96.5", "-1", "-1"], ["1", "0", "5"], ["2", "0", "6"], ["3", "0", "7"], ["4", "0", "8"], ["1", "0", "0"], ["1", "0", "1"], ["1", "0", "1"], ["1", "0", "2"])
    short = (2, ["A"], [], ["1"], ["2"], ["3"], ["4"], ["1"], ["1"], ["1"], ["1"])
    fraction = (3, ["A"], ["1"], ["1.5"], ["2"], ["3"], ["4"], ["1"], ["1"], ["1"], ["1"])
    words, rejected = W.ingest_word_arrays(spark.createDataFrame([ok, short, fraction], schema), ["page"])
    got = [(r.word_index, r.text, r.confidence, r.x, r.block_number, r.word_number) for r in words.orderBy("word_index").collect()]
    assert got == [(0, "A", 0.965, 1, 1, 1), (1, "B", None, 5, None, 2)]
    assert {r.page: r.reject_reason for r in rejected.collect()} == {2: "misaligned_arrays", 3: "non_integral_number"}


def test_extractor_keeps_failures(spark):
    def read(row):
        if row["page"] == 2:
            raise RuntimeError("broken scan")
        return {"raw_text": None if row["page"] == 3 else "text"}

    out = {r.page: (r.status, r.raw_text, r.error) for r in W.extract_pages(spark.createDataFrame([(1,), (2,), (3,)], "page int"), read, keys=["page"], provider="p", model_version="1").collect()}
    assert out == {1: ("success", "text", None), 2: ("failure", None, "broken scan"), 3: ("failure", None, "extractor returned no text")}


def test_manifest_files_and_worksheet(spark, tmp_path):
    sample = {"sample_id": "s1", "paper_alias": "paper-a", "page_number": 1, "region": {"x": 1, "y": 2, "width": 3, "height": 4}, "categories": ["c"]}
    (tmp_path / "good.json").write_text(json.dumps({"schema_version": "1.0", "samples": [sample]}))
    (tmp_path / "bad.json").write_text('{"schema_version": "1.0", "samples": [')
    rows, corrupt = M.read_manifest(spark, str(tmp_path), "ocr")
    assert [(r.sample_id, r.region.width) for r in rows.collect()] == [("s1", 3)] and corrupt.count() == 1
    sheet = "# T\n\n## Sample 001\n\nSample ID: s1\nGround truth student text:\n kept text \n\n\n## Sample 002\n\nno id\n"
    parsed, bad = M.parse_worksheet(spark.createDataFrame([(1, sheet)], "k int, t string"), "t", ["k"])
    assert [(r.sample_id, r.entered_text) for r in parsed.collect()] == [("s1", " kept text ")]
    assert [r.rule for r in bad.collect()] == ["invalid_section"]


def test_sinks_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "secret")], "n int, source_path string")
    K.write_once(df, str(tmp_path), "f" * 64)
    with pytest.raises(Exception, match="(?i)exists"):
        K.write_once(df, str(tmp_path), "f" * 64)
    assert K.safe_report(df, ["n"], ["source_path"]).columns == ["n"]
    with pytest.raises(ValueError):
        K.safe_report(df, ["source_path"], ["source_path"])


def test_registry_names_and_views():
    from scriptorium import catalog

    queries, oracles = catalog.queries(), catalog.oracles()
    assert set(oracles) <= set(queries) and len(queries) > 150


@pytest.mark.parametrize("name", ["f6_cer", "e1_detect_markers", "w10_box_matches", "l2_version_history", "a20_store_fingerprint"])
def test_queries_match_their_sql(spark, name):
    from scriptorium import catalog
    from tests.conftest import SF
    from tests.oracle import compare, connect

    assert compare(catalog.queries()[name](spark, SF), connect(SF), catalog.oracles()[name]) == []


def test_partitioning_does_not_change_results(spark):
    from scriptorium import catalog
    from tests.conftest import SF

    def run(name):
        return sorted(map(str, catalog.queries()[name](spark, SF).collect()))

    names = ["e6_answer_regions", "w14_balanced_selection", "e2_select_markers"]
    first = {n: run(n) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {n: run(n) for n in names} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_geometry_is_never_repaired(spark):
    def raw(x, tail=""):
        return '[{"bbox": {"x": %s, "y": 3, "width": 10, "height": 20%s}}]' % (x, tail)

    cases = {
        raw("1"): 1, raw(" 1\n"): 1, "[]": 0, "[ ]": 0, raw("1 2"): None, raw("01"): None, raw("1.5"): None, raw('"1"'): None,
        raw("99999999999"): None, raw("1", ', "x": 2'): None, "": None, "[] x": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", L.strict_boxes(F.col("raw")).alias("b"))
    assert {r.raw: None if r.b is None else len(r.b) for r in rows.collect()} == {k: None if v is None else min(v, 1) for k, v in cases.items()}


def test_worksheet_of_1200_samples(spark):
    body = "".join(f"## Sample {i:03d}\n\nSample ID: s{i}\nGround truth student text:\ntext {i}\n\n" for i in range(1, 1201))
    rows, bad = M.parse_worksheet(spark.createDataFrame([(1, body)], "k int, sheet string"), "sheet", ["k"])
    assert {r.sample_id: r.entered_text for r in rows.collect()} == {f"s{i}": f"text {i}" for i in range(1, 1201)}
    assert bad.count() == 0


def test_note_on_missing_text(spark):
    rows = spark.createDataFrame([(None, "n"), ("", "n"), ("n", "n"), ("a", "n"), ("a", None)], "t string, n string")
    assert [r[0] for r in rows.select(T.append_note(F.col("t"), F.col("n"))).collect()] == ["n", "n", "n", "a\nn", "a"]


def test_coordinate_beyond_32_bits_rejects_the_page(spark):
    columns = ("text", "conf", "left", "top", "width", "height", "block_num", "par_num", "line_num", "word_num")
    one = {c: ["1"] for c in columns}
    pages = spark.createDataFrame([(1, *one.values()), (2, *{**one, "left": ["1e10"]}.values())], "k int, " + ", ".join(f"{c} array<string>" for c in columns))
    rows, rejected = W.ingest_word_arrays(pages, ["k"])
    assert [r.k for r in rows.collect()] == [1]
    assert [(r.k, r.reject_reason) for r in rejected.collect()] == [(2, "non_integral_number")]
