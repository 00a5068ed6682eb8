"""Rule scores for markers, evidence classes and mark-risk proposals.

Thresholds and weights are fixed values of the scoring rules and appear literally.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.boxes import bottom, col, unit

EVIDENCE_TYPES = ("printed", "student_candidate", "teacher_candidate", "unknown")


def _mean(*values: Column) -> Column:
    total = values[0]
    for value in values[1:]:
        total = total + value
    return total / F.lit(float(len(values)))


def _flags(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in pairs]))


def marker_geometry(line_length: Column, x: Column, y: Column, page_width: Column, page_height: Column) -> Column:
    compact = F.when(line_length <= 3, 1.0).otherwise(0.45)
    horizontal = F.when(x <= page_width * F.lit(0.7), 1.0).otherwise(0.5)
    vertical = F.when(y >= page_height * F.lit(0.92), 0.1).otherwise(1.0)
    return _mean(compact, horizontal, vertical)


def marker_confidence(
    similarity: Column,
    numeric: Column,
    ocr: Column,
    geometry: Column,
    long_line: Column,
    first_word_y: Column,
    page_height: Column,
) -> Column:
    base = 0.35 * similarity + 0.2 * numeric + 0.2 * F.coalesce(ocr, F.lit(0.5)) + 0.25 * geometry
    base = base * F.when(long_line, 0.65).otherwise(1.0)
    base = base * F.when(first_word_y >= page_height * F.lit(0.92), 0.55).otherwise(1.0)
    return F.least(F.lit(1.0), base)


def sequence_support(gap: Column) -> Column:
    return F.when(gap == 1, 1.0).when(gap == 2, 0.7).otherwise(0.4)


def irregularity(geo) -> Column:
    geo = col(geo)
    return _mean(geo["baseline_irregularity"], geo["height_irregularity"], geo["spacing_irregularity"])


def teacher_score(ink, geo) -> Column:
    ink, geo = col(ink), col(geo)
    return unit(
        0.50 * ink["red_foreground_ratio"]
        + 0.20 * ink["mean_saturation"]
        + 0.20 * geo["isolation"]
        + 0.10 * geo["margin_position"]
    )


def printed_score(ink, geo, ocr: Column) -> Column:
    ink, geo = col(ink), col(geo)
    return unit(
        0.35 * F.coalesce(ocr, F.lit(0.0))
        + 0.30 * geo["regularity"]
        + 0.20 * geo["line_density"]
        + 0.15 * (1 - ink["mean_saturation"])
    )


def student_score(ink, geo) -> Column:
    ink, geo = col(ink), col(geo)
    return unit(
        0.40 * irregularity(geo)
        + 0.20 * geo["fragmentation"]
        + 0.20 * ink["blue_foreground_ratio"]
        + 0.10 * ink["edge_density"]
        + 0.10 * ink["dark_foreground_ratio"]
    )


def classify(ink, geo, ocr: Column) -> Column:
    """Struct(evidence_type, confidence): one supported class wins, otherwise unknown."""
    ink, geo = col(ink), col(geo)
    teacher, printed, student = teacher_score(ink, geo), printed_score(ink, geo, ocr), student_score(ink, geo)
    is_teacher = (
        (ink["red_foreground_ratio"] >= 0.30)
        & (ink["mean_saturation"] >= 0.25)
        & ((geo["isolation"] >= 0.65) | (geo["margin_position"] >= 1.0))
        & (teacher >= 0.58)
    )
    is_printed = F.coalesce(
        (ocr >= 0.72)
        & (geo["regularity"] >= 0.68)
        & (geo["line_density"] >= 0.10)
        & (ink["red_foreground_ratio"] < 0.18)
        & (ink["blue_foreground_ratio"] < 0.18)
        & (printed >= 0.62),
        F.lit(False),
    )
    second_sign = (
        (ink["blue_foreground_ratio"] >= 0.12)
        | (geo["fragmentation"] >= 0.55)
        | ((ink["dark_foreground_ratio"] >= 0.08) & (ink["connected_component_count"] >= 4))
    )
    is_student = (
        (irregularity(geo) >= 0.52) & second_sign & (ink["red_foreground_ratio"] < 0.30) & (student >= 0.42)
    )
    supported = is_teacher.cast("int") + is_printed.cast("int") + is_student.cast("int")

    def result(kind: str, score: Column) -> Column:
        return F.struct(F.lit(kind).alias("evidence_type"), score.alias("confidence"))

    return (
        F.when(supported != 1, result("unknown", unit(1 - F.greatest(teacher, printed, student))))
        .when(is_teacher, result("teacher_candidate", teacher))
        .when(is_printed, result("printed", printed))
        .otherwise(result("student_candidate", student))
    )


def evidence_signals(ink, geo, ocr: Column) -> Column:
    ink, geo = col(ink), col(geo)
    return _flags(
        (ocr >= 0.72, "high_ocr_confidence"),
        (ocr <= 0.45, "low_ocr_confidence"),
        (geo["regularity"] >= 0.68, "regular_geometry"),
        (geo["baseline_irregularity"] >= 0.52, "irregular_baseline"),
        (geo["height_irregularity"] >= 0.52, "irregular_height"),
        (geo["spacing_irregularity"] >= 0.52, "irregular_spacing"),
        (geo["line_density"] >= 0.20, "dense_text"),
        (geo["fragmentation"] >= 0.55, "fragmented_strokes"),
        (ink["mean_saturation"] >= 0.25, "chromatic_ink"),
        (ink["red_foreground_ratio"] >= 0.30, "red_ink_dominant"),
        (ink["blue_foreground_ratio"] >= 0.12, "blue_ink_dominant"),
        (geo["isolation"] >= 0.65, "isolated_mark"),
        (geo["margin_position"] >= 1.0, "margin_position"),
        (ink["local_contrast"] >= 0.30, "high_local_contrast"),
    )


def component_geometry(box, page_width: Column, ink) -> Column:
    """Geometry of ink without any word line; unmeasured irregularities sit at 0.5."""
    from scriptorium.functions.boxes import touches_margin

    ink = col(ink)
    half = F.lit(0.5)
    return F.struct(
        F.lit(0.0).alias("regularity"),
        half.alias("baseline_irregularity"),
        half.alias("height_irregularity"),
        half.alias("spacing_irregularity"),
        ink["foreground_ratio"].alias("line_density"),
        unit(ink["connected_component_count"] / F.lit(6.0)).alias("fragmentation"),
        F.lit(1.0).alias("isolation"),
        touches_margin(box, page_width).alias("margin_position"),
        F.lit(0).alias("word_count_in_line"),
    )


def mark_risk_signals(component, f, nearby: Column, confident_nearby: Column, page_height: Column) -> Column:
    component, f = col(component), col(f)
    aspect = component["width"] / component["height"].cast("double")
    chromatic = (f["chromatic_foreground_ratio"] >= 0.08) | (f["mean_saturation"] >= 0.10)
    any_near = nearby > 0
    at_edge = (component["y"] <= page_height * F.lit(0.12)) | (bottom(component) >= page_height * F.lit(0.88))
    return F.array_distinct(
        _flags(
            (chromatic, "chromatic_ink"),
            (
                (f["component_area_ratio"] <= 0.0015) & (f["local_whitespace_ratio"] >= 0.45),
                "small_isolated_component",
            ),
            (f["margin_proximity"] >= 0.58, "margin_activity"),
            (
                (f["component_area_ratio"] <= 0.001)
                & aspect.between(0.25, 4.0)
                & ((f["margin_proximity"] >= 0.35) | (f["ocr_proximity"] >= 0.45)),
                "score_like_geometry",
            ),
            ((f["angled_line_count"] >= 2) & (f["edge_density"] >= 0.04), "tick_cross_geometry"),
            ((aspect >= 3.5) | (f["angled_line_count"] >= 3), "correction_stroke_risk"),
            (any_near, "ocr_context_nearby"),
            (confident_nearby, "high_confidence_print_nearby"),
            (chromatic & any_near, "student_teacher_mixed_risk"),
            (chromatic & confident_nearby, "print_teacher_mixed_risk"),
            (nearby >= 8, "paragraph_teacher_risk"),
            (nearby.between(1, 4), "short_answer_teacher_risk"),
            (at_edge, "margin_activity"),
        )
    )


def mark_risk_category(signals: Column) -> Column:
    def has(*names: str) -> Column:
        return F.arrays_overlap(signals, F.array(*[F.lit(n) for n in names]))

    return (
        F.when(has("student_teacher_mixed_risk", "print_teacher_mixed_risk"), "mixed_teacher_context_risk")
        .when(has("tick_cross_geometry", "correction_stroke_risk"), "tick_cross_correction_risk")
        .when(has("margin_activity", "score_like_geometry"), "margin_score_risk")
        .when(has("chromatic_ink"), "chromatic_ink_risk")
        .otherwise("ambiguous_mark_risk")
    )


# Category bonus of the mark-risk score.
MARK_RISK_BONUS = {
    "mixed_teacher_context_risk": 0.22,
    "tick_cross_correction_risk": 0.18,
    "margin_score_risk": 0.16,
    "chromatic_ink_risk": 0.14,
    "ambiguous_mark_risk": 0.08,
    "hard_negative_control": 0.02,
}


def mark_risk_score(category: Column, signals: Column, f) -> Column:
    f = col(f)
    bonus = F.lit(None).cast("double")
    for name, value in MARK_RISK_BONUS.items():
        bonus = F.when(category == name, F.lit(value)).otherwise(bonus)
    return F.least(
        F.lit(1.0),
        bonus
        + F.least(F.lit(0.35), F.size(signals) * F.lit(0.055))
        + 0.12 * f["chromatic_foreground_ratio"]
        + 0.10 * f["margin_proximity"]
        + 0.08 * F.least(F.lit(1.0), f["angled_line_count"] / F.lit(4.0)),
    )


def printed_line_score(mean_confidence: Column, words: Column) -> Column:
    return F.coalesce(mean_confidence, F.lit(0.0)) * F.least(F.lit(1.0), words / F.lit(6.0))


def irregular_line_score(mean_confidence: Column, height_stddev: Column, words: Column) -> Column:
    low = 1 - F.coalesce(mean_confidence, F.lit(0.5))
    irregular = F.when(words < 2, F.lit(0.0)).otherwise(F.least(F.lit(1.0), height_stddev / F.lit(20.0)))
    return 0.65 * low + 0.35 * irregular


def context_tags(base: Column, x: Column, page_width: Column) -> Column:
    margin = F.when(x < page_width * F.lit(0.12), F.array(F.lit("margin_region"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_distinct(F.concat(base, margin))


def line_tag(words: Column) -> Column:
    return F.array(F.when(words >= 8, F.lit("paragraph")).otherwise(F.lit("short_answer")))


def component_gate(component, contour_area: Column, page_width: Column, page_height: Column) -> Column:
    """Size gate applied before any feature of a mark component is looked at."""
    component = col(component)
    return ~(
        (component["width"] < 4)
        | (component["height"] < 4)
        | (contour_area < 16)
        | (contour_area > page_width.cast("double") * page_height * F.lit(0.008))
        | (component["width"] > page_width * F.lit(0.28))
        | (component["height"] > page_height * F.lit(0.18))
    )


