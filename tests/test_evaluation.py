"""Hand-computed evaluation numbers."""

import pytest
from scriptorium.plans import evaluation as V
from scriptorium.operators.summaries import exact_medians
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,width:int,height:int>"


def test_classification_golden(spark):
    rows = [("printed", "printed"), ("student_candidate", "printed"), ("teacher_candidate", "student_candidate"), ("unknown", "unknown")]
    cells = V.confusion_cells(spark.createDataFrame(rows, "human string, predicted string"))
    s = V.classification_summary(cells).first()
    assert (s.sample_count, s.overall_accuracy, s.unknown_prediction_rate, s.human_unknown_rate) == (4, 0.5, 0.25, 0.25)
    m = {r.evidence_type: r for r in V.class_metrics(cells).collect()}
    assert (m["student_candidate"].precision, m["student_candidate"].recall) == (0.0, 0.0)
    # Support without predictions: undefined precision, but an F1 of 0 that counts.
    assert m["teacher_candidate"].precision is None and m["teacher_candidate"].f1 == 0.0
    assert abs(s.macro_f1 - (2 / 3 + 0 + 0 + 1) / 4) < 1e-12
    matrix = {r.human: r for r in V.confusion_matrix(cells).collect()}
    assert matrix["student_candidate"]["printed"] == 1 and matrix["teacher_candidate"]["teacher_candidate"] == 0


def test_undefined_class_is_null(spark):
    cells = V.confusion_cells(spark.createDataFrame([("printed", "printed")], "human string, predicted string"))
    teacher = V.class_metrics(cells).where("evidence_type = 'teacher_candidate'").first()
    assert (teacher.precision, teacher.recall, teacher.f1) == (None, None, None)


def test_empty_samples_golden(spark):
    labels = spark.createDataFrame([("a", "verified_empty"), ("b", "verified_empty")], "sample_id string, answer_status string")
    predicted = spark.createDataFrame([("b", 0, (0, 0, 5, 5))], f"sample_id string, predicted_idx int, predicted_box {BOX}")
    r = V.empty_sample_summary(labels, predicted).first()
    assert (r.correctly_predicted_empty, r.false_positive_empty_samples, r.empty_prediction_precision, r.empty_recall) == (1, 1, 1.0, 0.5)
    human = predicted.where("false").select("sample_id", F.col("predicted_idx").alias("human_idx"), F.col("predicted_box").alias("human_box"))
    matches = spark.createDataFrame([], "sample_id string, threshold double, human_idx int, predicted_idx int, iou double")
    s = V.localization_summary(human, predicted, matches, labels).first()
    assert s.recall_at_50 is None and s.precision_at_50 == 0.0 and s.mean_matched_iou is None


def test_structure_golden(spark):
    truth = spark.createDataFrame([("p", 1, i, n, (100, y, 80, 40)) for i, (n, y) in enumerate([(1, 100), (2, 300), (3, 600)])], f"paper_id string, page_number int, truth_idx int, truth_number int, truth_box {BOX}")
    found = spark.createDataFrame([("p", 1, i, n, (100, y, 80, 40)) for i, (n, y) in enumerate([(1, 100), (2, 300), (4, 700)])], f"paper_id string, page_number int, detected_idx int, detected_number int, detected_box {BOX}")
    candidates = spark.createDataFrame([("p", n) for n in (1, 2, 2, 4)], "paper_id string, test_number int")
    papers = spark.createDataFrame([("p", 1), ("empty", 1)], "paper_id string, page_count long")
    rows = {r.paper_id: r for r in V.structure_results(truth, found, candidates, papers).collect()}
    r = rows["p"]
    assert (r.true_positives, r.false_positives, r.false_negatives, r.duplicate_markers, r.missing_test_numbers) == (2, 1, 1, 1, [3])
    assert all(abs(v - 2 / 3) < 1e-12 for v in (r.precision, r.recall, r.ordering_accuracy))
    e = rows["empty"]
    assert (e.precision, e.recall, e.f1, e.test_number_accuracy, e.ordering_accuracy) == (1.0, 1.0, 1.0, 1.0, 1.0)


def test_exact_medians(spark):
    import random
    import statistics

    rng = random.Random(8)
    rows = [(g, float(rng.randrange(50)) if g else rng.random()) for g in range(3) for _ in range(101 + g)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r.m for r in exact_medians(df, ["g"], {"m": F.col("v")}).collect()}
    assert got == {g: statistics.median(v for k, v in rows if k == g) for g in range(3)}


def test_summary_keeps_failures(spark):
    samples = spark.createDataFrame([("a", "verified", "one two"), ("b", "verified", "x"), ("c", "pending", None)], "sample_id string, ground_truth_status string, ground_truth_text string")
    results = spark.createDataFrame([("a", "success", "one too", 5.0), ("b", "failure", None, None), ("c", "success", "x", 1.0)], "sample_id string, status string, prediction string, duration_ms double")
    scored = V.score_ocr(samples, results).withColumn("preprocessing_ms", F.lit(None).cast("double"))
    s = V.summarize_ocr(scored).first()
    assert (s.total_samples, s.successful_samples, s.failed_samples, s.mean_wer, s.median_wer) == (2, 1, 1, 0.5, 0.5)


def test_ids_that_do_not_line_up_are_refused(spark):
    box = "struct<x:int,y:int,width:int,height:int>"
    samples = spark.createDataFrame([(1, (0, 0, 9, 9), ["c"]), (2, (0, 0, 9, 9), ["c"])], f"sample_id int, region {box}, categories array<string>")
    annotations = spark.createDataFrame([(1, "printed", "verified_empty"), (3, "printed", "verified_empty")], "sample_id int, evidence_type string, answer_status string")
    none = spark.createDataFrame([], f"sample_id int, human_idx int, human_box {box}")
    with pytest.raises(ValueError, match="missing 1, unexpected 1"):
        V.evaluate_evidence(samples, annotations, none, none, none)


def test_localization_matches_boxes_once(spark, monkeypatch):
    import __spark_entry__ as entry

    seen = []
    whole = V.localization_summary
    monkeypatch.setattr(V, "localization_summary", lambda h, p, m, l: seen.append(m) or whole(h, p, m, l))
    entry.queries()["a16_localization_summary"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
