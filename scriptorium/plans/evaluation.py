"""Evaluation of text, structure, evidence classes and answer boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import boxes as B
from scriptorium.functions import text as T
from scriptorium.functions.scoring import EVIDENCE_TYPES
from scriptorium.operators.joins import band_join, coverage
from scriptorium.operators.matching import match_boxes, match_in_truth_order
from scriptorium.operators.sequences import lcs_length
from scriptorium.operators.summaries import exact_medians, join_summaries, ratio, ratio_or
from scriptorium.session import cut_lineage

READY = ("verified", "verified_empty")


# Text -----------------------------------------------------------------------------------


def score_ocr(samples: DataFrame, results: DataFrame, compose: bool = True) -> DataFrame:
    """CER and WER of every ready sample; failures keep their row without metrics."""
    ready = samples.where(F.col("ground_truth_status").isin(*READY))
    joined = ready.join(results, "sample_id")
    ok = F.col("status") == "success"
    normal = joined.withColumn("_ref", F.when(ok, T.normalize_metric(F.col("ground_truth_text"), compose))).withColumn(
        "_pred", F.when(ok, T.normalize_metric(F.col("prediction"), compose))
    )
    return (
        normal.withColumn("cer", F.when(ok, T.cer(F.col("_ref"), F.col("_pred"))))
        .withColumn("wer", F.when(ok, T.wer(F.col("_ref"), F.col("_pred"))))
        .drop("_ref", "_pred")
    )


def summarize_ocr(scored: DataFrame, keys: Sequence[str] = (), store: bool = True) -> DataFrame:
    """Counts, means and exact medians; undefined rates drop out of the averages.

    The summary reads the rates three times. ``store`` keeps them between, which pays when they
    are edit distances; rates that are columns of a table are read again instead.
    """
    keys = list(keys)
    ok = F.col("status") == "success"
    rates = scored.select(
        *keys,
        ok.alias("ok"),
        (ok & (F.col("prediction") == "")).alias("empty"),
        F.when(ok, F.col("cer.rate")).alias("cer"),
        F.when(ok, F.col("wer.rate")).alias("wer"),
        F.when(ok, F.col("duration_ms")).alias("duration"),
        F.when(ok, F.col("preprocessing_ms")).alias("preprocessing"),
    )
    if store:
        rates = cut_lineage(rates)
    values = ["cer", "wer", "duration", "preprocessing"]
    counts = rates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if("ok").alias("successful_samples"),
        F.count_if(~F.col("ok")).alias("failed_samples"),
        *[F.avg(v).alias(f"mean_{v}") for v in values],
        F.count_if("empty").alias("empty_successful_predictions"),
    )
    medians = exact_medians(rates, keys, {f"median_{v}": F.col(v) for v in values})
    return join_summaries(counts, medians, keys)


def with_report_labels(scored: DataFrame) -> DataFrame:
    """One row per report label: difficulty, every category, annotation risk."""
    labels = F.concat(
        F.array(F.concat(F.lit("difficulty:"), F.col("difficulty"))),
        F.transform("categories", lambda c: F.concat(F.lit("category:"), c)),
        F.array_compact(F.array(F.when(F.col("teacher_annotations_present"), F.lit("teacher-annotation-risk")))),
    )
    return scored.withColumn("label", F.explode(labels))


def verified_empty_behaviour(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    empty = scored.where(F.col("ground_truth_status") == "verified_empty")
    ok = F.col("status") == "success"
    return empty.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(ok & (F.col("prediction") == "")).alias("empty_predictions"),
        F.count_if(ok & (F.col("prediction") != "")).alias("nonempty_predictions"),
        F.count_if(~ok).alias("failed"),
    )


def compare_runs(baseline: DataFrame, variant: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Variant minus baseline; NULL as soon as one side is undefined."""
    metrics = ["mean_cer", "median_cer", "mean_wer", "median_wer"]
    a = baseline.select(*keys, *[F.col(m).alias(f"base_{m}") for m in metrics])
    b = variant.select(*keys, *metrics)
    return join_summaries(b, a, list(keys)).select(
        *keys, *[(F.col(m) - F.col(f"base_{m}")).alias(f"delta_{m}") for m in metrics]
    )


# Evidence classes -------------------------------------------------------------------------


def dominant_class(samples: DataFrame, evidence: DataFrame, key: str = "sample_id") -> DataFrame:
    """Class with the uniquely largest total box area, otherwise unknown."""
    areas = evidence.groupBy(key, "evidence_type").agg(F.sum(B.area("box")).alias("area"))
    best = areas.groupBy(key).agg(
        F.max(F.struct("area", "evidence_type")).alias("top"),
        F.min(F.struct(-F.col("area"), "evidence_type")).alias("other"),
    )
    unique = F.col("top.evidence_type") == F.col("other.evidence_type")
    picked = best.select(key, F.when(unique, F.col("top.evidence_type")).otherwise("unknown").alias("predicted_class"))
    return samples.select(key).join(picked, key, "left").withColumn(
        "predicted_class", F.coalesce("predicted_class", F.lit("unknown"))
    )


def confusion_cells(labels: DataFrame) -> DataFrame:
    """Dense (human, predicted, n) cells including zeros."""
    counts = labels.groupBy("human", "predicted").agg(F.count(F.lit(1)).alias("n"))
    classes = F.array(*[F.lit(c) for c in EVIDENCE_TYPES])
    grid = (
        labels.sparkSession.range(1)
        .select(F.explode(classes).alias("human"))
        .select("human", F.explode(classes).alias("predicted"))
    )
    return grid.join(counts, ["human", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def confusion_matrix(cells: DataFrame) -> DataFrame:
    return cells.groupBy("human").pivot("predicted", list(EVIDENCE_TYPES)).agg(F.sum("n"))


def class_metrics(cells: DataFrame) -> DataFrame:
    """Per class support, predictions, TP/FP/FN and P/R/F1 with NULL for 0/0."""
    hit = F.when(F.col("human") == F.col("predicted"), F.col("n")).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    sides = F.explode(
        F.array(
            F.struct(F.col("human").alias("evidence_type"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
            F.struct(F.col("predicted").alias("evidence_type"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
        )
    )
    summed = (
        cells.select(sides.alias("s")).select("s.*").groupBy("evidence_type")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("true_positives"))
    )
    tp, support, predicted = F.col("true_positives"), F.col("support"), F.col("predicted")
    return (
        summed.withColumn("false_positives", predicted - tp)
        .withColumn("false_negatives", support - tp)
        .withColumn("precision", ratio(tp, predicted))
        .withColumn("recall", ratio(tp, support))
        .withColumn("f1", ratio(2 * tp, predicted + support))
    )


def classification_summary(cells: DataFrame) -> DataFrame:
    """Accuracy, macro F1 over defined classes, weighted F1 over supported ones."""
    metrics = class_metrics(cells)
    supported = (F.col("support") > 0) & F.col("f1").isNotNull()
    scores = metrics.agg(
        F.avg("f1").alias("macro_f1"),
        ratio(
            F.sum(F.when(supported, F.col("f1") * F.col("support"))), F.sum(F.when(supported, F.col("support")))
        ).alias("weighted_f1"),
    )
    n = F.col("n")
    totals = cells.agg(
        F.sum(n).alias("sample_count"),
        ratio(F.sum(F.when(F.col("human") == F.col("predicted"), n).otherwise(0)), F.sum(n)).alias("overall_accuracy"),
        ratio(F.sum(F.when(F.col("predicted") == "unknown", n).otherwise(0)), F.sum(n)).alias("unknown_prediction_rate"),
        ratio(F.sum(F.when(F.col("human") == "unknown", n).otherwise(0)), F.sum(n)).alias("human_unknown_rate"),
    )
    return join_summaries(totals, scores, [])


def cross_class_errors(cells: DataFrame) -> DataFrame:
    """Counts that matter most when teacher and student ink are mixed up."""
    metrics = class_metrics(cells)

    def pick(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("evidence_type") == kind, F.col(column)))

    per_class = metrics.agg(
        pick("student_candidate", "false_positives").alias("student_false_positives"),
        pick("student_candidate", "false_negatives").alias("student_false_negatives"),
        F.max(F.when(F.col("evidence_type") == "teacher_candidate", F.col("f1")))
        .isNotNull()
        .alias("teacher_metrics_defined"),
    )

    def cell(human: str, predicted: str) -> Column:
        return F.sum(F.when((F.col("human") == human) & (F.col("predicted") == predicted), F.col("n")).otherwise(0))

    swapped = cells.agg(
        cell("teacher_candidate", "student_candidate").alias("teacher_to_student_errors"),
        cell("student_candidate", "teacher_candidate").alias("student_to_teacher_errors"),
    )
    return join_summaries(per_class, swapped, [])


# Answer boxes -----------------------------------------------------------------------------


def crop_relative_boxes(samples: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes in crop coordinates, violations for boxes outside their crop)."""
    moved = answers.join(samples.select("sample_id", "region"), "sample_id").withColumn(
        "relative_box", B.crop_relative("box", "region")
    )
    inside = (
        (F.col("relative_box.x") >= 0)
        & (F.col("relative_box.y") >= 0)
        & (B.right("relative_box") <= F.col("region.width"))
        & (B.bottom("relative_box") <= F.col("region.height"))
    )
    return moved.where(inside), moved.where(~inside).select(
        "sample_id", "answer_no", F.lit("answer_outside_crop").alias("rule")
    )


def localization_summary(human: DataFrame, predicted: DataFrame, matches: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals over all samples. ``matches`` holds thresholds 0, 0.25 and 0.5.

    The mean and median IoU come from the matches at threshold 0 and are independent of the
    runs at 0.25 and 0.50. ``labels``: sample_id, answer_status.
    """
    h = human.agg(F.count(F.lit(1)).alias("human_box_count"))
    p = predicted.agg(F.count(F.lit(1)).alias("predicted_box_count"))
    m = matches.agg(
        F.count_if(F.col("threshold") == 0).alias("positive_overlap_match_count"),
        F.avg(F.when(F.col("threshold") == 0, F.col("iou"))).alias("mean_matched_iou"),
        F.count_if(F.col("threshold") == 0.5).alias("matched_at_50"),
        F.count_if(F.col("threshold") == 0.25).alias("matched_at_25"),
    )
    median = exact_medians(matches.where(F.col("threshold") == 0), [], {"median_matched_iou": F.col("iou")})
    out = join_summaries(join_summaries(join_summaries(h, p, []), m, []), median, [])
    for at in ("50", "25"):
        matched = F.col(f"matched_at_{at}")
        out = (
            out.withColumn(f"precision_at_{at}", ratio(matched, F.col("predicted_box_count")))
            .withColumn(f"recall_at_{at}", ratio(matched, F.col("human_box_count")))
            .withColumn(f"f1_at_{at}", ratio(2 * matched, F.col("predicted_box_count") + F.col("human_box_count")))
            .withColumn(f"missed_at_{at}", F.col("human_box_count") - matched)
            .withColumn(f"extra_at_{at}", F.col("predicted_box_count") - matched)
        )
    return join_summaries(out, empty_sample_summary(labels, predicted), [])


def empty_sample_summary(labels: DataFrame, predicted: DataFrame) -> DataFrame:
    has_boxes = predicted.select("sample_id").distinct().withColumn("has_boxes", F.lit(True))
    flagged = labels.join(has_boxes, "sample_id", "left").withColumn(
        "has_boxes", F.coalesce("has_boxes", F.lit(False))
    )
    empty = F.col("answer_status") == "verified_empty"
    counted = flagged.agg(
        F.count_if(empty).alias("verified_empty_samples"),
        F.count_if(~F.col("has_boxes")).alias("predicted_empty_samples"),
        F.count_if(empty & ~F.col("has_boxes")).alias("correctly_predicted_empty"),
        F.count_if(empty & F.col("has_boxes")).alias("false_positive_empty_samples"),
    )
    return counted.withColumn(
        "empty_prediction_precision", ratio(F.col("correctly_predicted_empty"), F.col("predicted_empty_samples"))
    ).withColumn("empty_recall", ratio(F.col("correctly_predicted_empty"), F.col("verified_empty_samples")))


def sample_categories(samples: DataFrame) -> DataFrame:
    """Stored tags preceded by the discovery category and the section context."""
    context = F.when(F.col("test_number").isNotNull(), "detected_test").otherwise("no_detected_test")
    return samples.withColumn("categories", F.concat(F.array(F.col("discovery_category"), context), F.col("context_tags")))


def sample_rows(labels: DataFrame, classes: DataFrame, human: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """One evaluation row per sample. ``labels``: sample_id, evidence_type, categories."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("sample_id").agg(F.count(F.lit(1)).alias(name))

    m = matches.groupBy("sample_id").agg(
        F.count_if(F.col("threshold") == 0.5).alias("matched_answer_boxes_at_50"),
        F.avg(F.when(F.col("threshold") == 0, F.col("iou"))).alias("mean_positive_iou"),
    )
    zero = F.lit(0).cast("long")
    return (
        labels.join(classes, "sample_id")
        .join(counted(human, "human_answer_boxes"), "sample_id", "left")
        .join(counted(predicted, "predicted_answer_boxes"), "sample_id", "left")
        .join(m, "sample_id", "left")
        .withColumn("class_correct", F.col("evidence_type") == F.col("predicted_class"))
        .withColumn("human_answer_boxes", F.coalesce("human_answer_boxes", zero))
        .withColumn("predicted_answer_boxes", F.coalesce("predicted_answer_boxes", zero))
        .withColumn("matched_answer_boxes_at_50", F.coalesce("matched_answer_boxes_at_50", zero))
    )


def stratified(rows: DataFrame) -> DataFrame:
    """Errors, misses and extras per category."""
    matched = F.col("matched_answer_boxes_at_50")
    return (
        rows.withColumn("category", F.explode("categories"))
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.count_if(~F.col("class_correct")).alias("classification_errors"),
            F.count_if(matched < F.col("human_answer_boxes")).alias("answer_miss_samples"),
            F.count_if(matched < F.col("predicted_answer_boxes")).alias("answer_extra_samples"),
        )
    )


def evaluate_evidence(samples: DataFrame, annotations: DataFrame, human: DataFrame, evidence: DataFrame, answers: DataFrame) -> dict[str, DataFrame]:
    """All evidence metrics of one benchmark; ids must line up before numbers mean anything.

    Samples and annotations that do not cover each other are refused with a ``ValueError``.
    ``samples``: sample_id, region, categories. ``annotations``: sample_id, evidence_type,
    answer_status. ``human``: sample_id, human_idx, human_box. ``evidence``: sample_id,
    evidence_type, box. ``answers``: sample_id, answer_no, box (page coordinates).
    """
    apart = {r["problem"]: r["n"] for r in coverage(samples, annotations, "sample_id").groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()}
    if apart:
        raise ValueError("samples and annotations differ: " + ", ".join(f"{k} {v}" for k, v in sorted(apart.items())))
    classes = dominant_class(samples, evidence)
    relative, outside = crop_relative_boxes(samples, answers)
    predicted = relative.select(
        "sample_id", F.col("answer_no").alias("predicted_idx"), F.col("relative_box").alias("predicted_box")
    )
    matches = cut_lineage(match_boxes(human, predicted, ["sample_id"], [0.0, 0.25, 0.5]))
    labels = annotations.join(samples.select("sample_id", "categories"), "sample_id")
    rows = cut_lineage(sample_rows(labels, classes, human, predicted, matches))
    cells = confusion_cells(rows.select(F.col("evidence_type").alias("human"), F.col("predicted_class").alias("predicted")))
    return {
        "violations": outside,
        "cells": cells,
        "classes": class_metrics(cells),
        "classification": classification_summary(cells),
        "localization": localization_summary(human, predicted, matches, annotations),
        "samples": rows,
        "stratified": stratified(rows),
    }


# Structure --------------------------------------------------------------------------------


def marker_edges(truth: DataFrame, detected: DataFrame, require_number: bool) -> DataFrame:
    """Truth/detected pairs on one page within max(80, 3 marker heights) of each other.

    ``truth``: paper_id, page_number, truth_idx, truth_number, truth_box. ``detected``:
    paper_id, page_number, detected_idx, detected_number, detected_box.
    """
    reach = F.greatest(F.lit(80), F.col("truth_box.height") * 3)
    pairs = band_join(
        truth,
        detected,
        ["paper_id", "page_number"],
        B.centre_y("truth_box") - reach,
        B.centre_y("truth_box") + reach,
        B.centre_y("detected_box"),
    )
    if require_number:
        pairs = pairs.where(F.col("truth_number") == F.col("detected_number"))
    return pairs.withColumn("distance", B.vertical_distance("truth_box", "detected_box"))


def match_markers(edges: DataFrame) -> DataFrame:
    """(paper_id, truth_idx, detected_idx): truth order, matched per island of close markers of a page."""
    a, b = B.centre_y("truth_box"), B.centre_y("detected_box")
    return match_in_truth_order(edges, ["paper_id"], on=["page_number"], span=(F.least(a, b), F.greatest(a, b)))


def structure_results(truth: DataFrame, detected: DataFrame, candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """One row per paper: marker counts, P/R/F1, number and ordering accuracy.

    ``papers``: paper_id, page_count. ``candidates``: paper_id, test_number (all candidates).
    """
    key = ["paper_id"]
    exact = match_markers(marker_edges(truth, detected, True))
    placed = marker_edges(truth, detected, False)
    spatial = match_markers(placed).join(
        placed.select(*key, "truth_idx", "detected_idx", "truth_number", "detected_number"),
        [*key, "truth_idx", "detected_idx"],
    )
    zero = F.lit(0).cast("long")

    def per_paper(df: DataFrame, **aggregates: Column) -> DataFrame:
        return df.groupBy(*key).agg(*[a.alias(n) for n, a in aggregates.items()])

    def sequence(df: DataFrame, idx: str, number: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(idx, number))), lambda v: v[number])

    surplus = (
        candidates.groupBy(*key, "test_number").agg((F.count(F.lit(1)) - 1).alias("extra"))
        .groupBy(*key).agg(F.sum("extra").alias("duplicate_markers"))
    )
    out = papers
    for part in (
        per_paper(truth, expected_markers=F.count(F.lit(1)), truth_numbers=sequence(truth, "truth_idx", "truth_number")),
        per_paper(detected, detected_markers=F.count(F.lit(1)), found_numbers=sequence(detected, "detected_idx", "detected_number")),
        per_paper(exact, true_positives=F.count(F.lit(1))),
        per_paper(
            spatial,
            located=F.count(F.lit(1)),
            number_correct=F.count_if(F.col("truth_number") == F.col("detected_number")),
        ),
        surplus,
    ):
        out = out.join(part, key, "left")
    for name in ("expected_markers", "detected_markers", "true_positives", "located", "number_correct", "duplicate_markers"):
        out = out.withColumn(name, F.coalesce(name, zero))
    none = F.array().cast("array<int>")
    tp, expected, found = F.col("true_positives"), F.col("expected_markers"), F.col("detected_markers")
    both = F.col("precision") + F.col("recall")
    return (
        out.withColumn("truth_numbers", F.coalesce("truth_numbers", none))
        .withColumn("found_numbers", F.coalesce("found_numbers", none))
        .withColumn("false_positives", found - tp)
        .withColumn("false_negatives", expected - tp)
        .withColumn("precision", ratio_or(tp, found, 1.0))
        .withColumn("recall", ratio_or(tp, expected, 1.0))
        .withColumn("f1", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / both))
        .withColumn(
            "test_number_accuracy",
            ratio_or(
                F.col("number_correct"), F.col("located"),
                F.when((expected == 0) & (found == 0), 1.0).otherwise(0.0),
            ),
        )
        .withColumn("ordering_accuracy", ordering_accuracy(F.col("truth_numbers"), F.col("found_numbers")))
        .withColumn("missing_test_numbers", F.array_sort(F.array_except("truth_numbers", "found_numbers")))
        .drop("located", "number_correct")
    )


def ordering_accuracy(expected: Column, detected: Column) -> Column:
    longest = F.greatest(F.size(expected), F.size(detected))
    return ratio_or(lcs_length(expected, detected), longest, 1.0)


def structure_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Micro-averaged counts; accuracies are means over papers."""
    sums = ["page_count", "expected_markers", "detected_markers", "true_positives", "false_positives", "false_negatives", "duplicate_markers"]
    summed = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paper_count"),
        *[F.sum(c).alias(c) for c in sums],
        F.avg("test_number_accuracy").alias("mean_test_number_accuracy"),
        F.avg("ordering_accuracy").alias("mean_ordering_accuracy"),
    )
    both = F.col("precision") + F.col("recall")
    return (
        summed.withColumn("precision", ratio_or(F.col("true_positives"), F.col("detected_markers"), 1.0))
        .withColumn("recall", ratio_or(F.col("true_positives"), F.col("expected_markers"), 1.0))
        .withColumn("f1", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / both))
    )
