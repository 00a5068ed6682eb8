"""Rule sets of the engine's entities, declared once and checked in one pass each.

An entity is a table with a key and rules over one row: plain conditions, a state machine (what
each status demands), exclusive payloads (what success has, failure must not have), and counts
that balance. Rules between rows (unique ids, stored order, page numbers from 1 to n) are
declared beside them. ``violations`` compiles the row rules into a single expression, so
a table is read once for them however many there are; uniqueness is one aggregate and order one
window per group. Undecidable rules count as broken.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import boxes as B
from scriptorium.functions.scoring import EVIDENCE_TYPES
from scriptorium.operators.rules import check_rules, unique_violations

# Patterns that identifiers, reasons and labels must match.
SAFE_ID = r"\A[a-z0-9][a-z0-9_-]{2,63}\z"
REASON = r"\A[a-z0-9_+.-]{3,80}\z"
TEST_LABEL = r"\ATest [0-9]{2}\z"


def matches(name: str, pattern: str) -> Column:
    return F.col(name).rlike(pattern)


def positive(*names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out &= F.col(name) > 0
    return out


def page_box() -> Column:
    return B.box(0, 0, F.col("page_width"), F.col("page_height"))


def fits_page(name: str = "region") -> Column:
    """A box with sides, inside its page; a missing box fits."""
    b = F.col(name)
    return b.isNull() | ((b["width"] > 0) & (b["height"] > 0) & B.contains(page_box(), b))


def all_distinct(name: str) -> Column:
    return F.size(F.array_distinct(name)) == F.size(name)


def null(*names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out &= F.col(name).isNull()
    return out


def given(*names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out &= F.col(name).isNotNull()
    return out


def by_state(status: str, demands: Mapping[str, Column]) -> dict[str, Column]:
    """A rule per status, named after it, and one that the status is known."""
    at = F.coalesce(F.col(status), F.lit(""))
    known = {f"{state}_state": (at != state) | demand for state, demand in demands.items()}
    return {"known_status": F.col(status).isin(*demands), **known}


@dataclass(frozen=True)
class Entity:
    """``rules`` over a row; ``unique``: columns that identify it; ``order``: (group, position, sort columns) it is stored in."""

    name: str
    key: tuple[str, ...]
    rules: Mapping[str, Column]
    unique: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    order: Mapping[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = field(default_factory=dict)
    pages: tuple[tuple[str, ...], str, str] | None = None


def order_broken(df: DataFrame, key: Sequence[str], group: Sequence[str], position: str, by: Sequence[str], rule: str) -> DataFrame:
    """Rows that sort before the row stored ahead of them."""
    value = F.struct(*by)
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(position))
    return df.withColumn("_value", value).withColumn("_before", before).where(F.col("_value") < F.col("_before")).select(*key, F.lit(rule).alias("rule"))


def pages_broken(df: DataFrame, key: Sequence[str], group: Sequence[str], number: str, count: str) -> DataFrame:
    """One row per group whose page numbers are not 1 to its page count; keys outside the group are NULL."""
    pages = df.groupBy(*group).agg(F.min(number).alias("_low"), F.max(number).alias("_high"), F.countDistinct(number).alias("_kinds"), F.count(F.lit(1)).alias("_rows"), F.max(count).alias("_count"))
    good = (F.col("_low") == 1) & (F.col("_high") == F.col("_count")) & (F.col("_kinds") == F.col("_count")) & (F.col("_rows") == F.col("_count"))
    kinds = dict(df.dtypes)
    return pages.where(~F.coalesce(good, F.lit(False))).select(*[F.col(k) if k in group else F.lit(None).cast(kinds[k]).alias(k) for k in key], F.lit("pages_from_1_to_n").alias("rule"))


def violations(df: DataFrame, entity: Entity) -> DataFrame:
    """(key, rule) for everything that is wrong with the rows of an entity."""
    key = list(entity.key)
    out = check_rules(df, key, entity.rules)
    for rule, columns in entity.unique.items():
        twice = unique_violations(df, columns, rule)
        out = out.unionByName(twice.select(*[F.col(k) if k in columns else F.lit(None).cast(dict(df.dtypes)[k]).alias(k) for k in key], "rule"))
    for rule, (group, position, by) in entity.order.items():
        out = out.unionByName(order_broken(df, key, group, position, by, rule))
    if entity.pages:
        out = out.unionByName(pages_broken(df, key, *entity.pages))
    return out


def valid(df: DataFrame, entity: Entity) -> DataFrame:
    """Rows with no broken row rule, for pipelines that go on with what is good."""
    good = F.lit(True)
    for rule in entity.rules.values():
        good &= F.coalesce(rule, F.lit(False))
    return df.where(good)


def ocr_sample() -> Entity:
    text = F.col("ground_truth_text")
    states = by_state("ground_truth_status", {"pending": text.isNull(), "verified": F.regexp_replace(text, r"(?U)\s+", "") != "", "verified_empty": text == ""})
    return Entity("ocr_sample", ("sample_id",), {
        "safe_id": matches("sample_id", SAFE_ID), "safe_alias": matches("paper_alias", SAFE_ID), "positive_page": positive("page_number", "page_width", "page_height"),
        "has_category": F.size("categories") > 0, "safe_categories": F.forall("categories", lambda c: c.rlike(SAFE_ID)), "region_inside_page": fits_page(), **states,
    }, unique={"unique_id": ("sample_id",)})


def ocr_result() -> Entity:
    measures = ("prediction", "cer", "wer", "duration_ms")
    return Entity("ocr_result", ("sample_id",), by_state("status", {
        "success": given(*measures) & null("error"), "failure": given("error") & null(*measures, "evidence", "preprocessing"),
    }), unique={"unique_id": ("sample_id",)})


def ocr_summary(keys: tuple[str, ...] = ("run",)) -> Entity:
    return Entity("ocr_summary", keys, {
        "counts_not_negative": (F.col("successful_samples") >= 0) & (F.col("failed_samples") >= 0), "counts_balance": F.col("successful_samples") + F.col("failed_samples") == F.col("total_samples"),
        "empty_among_successful": F.col("empty_successful_predictions") <= F.col("successful_samples"),
    })


def evidence_sample() -> Entity:
    answers = F.col("answer_regions")
    local = F.forall(answers, lambda a: (a["x"] >= 0) & (a["y"] >= 0) & (a["x"] + a["width"] <= F.col("region")["width"]) & (a["y"] + a["height"] <= F.col("region")["height"]))
    states = by_state("human_status", {
        "pending": null("evidence_type") & ~F.col("answer_regions_verified") & (F.size(answers) == 0), "human_verified": F.col("evidence_type").isin(*EVIDENCE_TYPES) & F.col("answer_regions_verified"),
    })
    return Entity("evidence_sample", ("sample_id",), {
        "region_inside_page": fits_page() & given("region"), "distinct_categories": all_distinct("categories"), "answers_inside_region": local, **states,
    }, unique={"unique_id": ("sample_id",)})


def expansion_sample() -> Entity:
    return Entity("expansion_sample", ("position", "sample_id"), {
        "region_inside_page": fits_page() & given("region"), "distinct_tags": all_distinct("context_tags"), "reason": matches("discovery_reason", REASON), "absolute_path": F.col("source_path").startswith("/"),
    }, unique={"unique_id": ("sample_id",)}, order={"sorted_ids": ((), "position", ("sample_id",))})


def mark_risk_candidate() -> Entity:
    return Entity("mark_risk_candidate", ("sample_id",), {
        "region_inside_page": fits_page() & given("region"), "component_inside_region": B.contains("region", "component"), "distinct_signals": all_distinct("signals"), "absolute_path": F.col("source_path").startswith("/"),
    }, unique={"unique_id": ("sample_id",)})


def expected_marker() -> Entity:
    place = ("paper_id", "page_number", "test_number")
    return Entity("expected_marker", (*place, "position"), {"page_exists": F.col("page_number").between(1, F.col("page_count"))}, unique={"unique_marker": place},
                  order={"document_order": (("paper_id",), "position", ("page_number", "y", "test_number"))})


def detected_test() -> Entity:
    return Entity("detected_test", ("paper_id", "test_number"), {
        "number_of_marker": F.col("test_number") == F.col("marker_number"), "label": matches("label", TEST_LABEL) & (F.substring("label", 6, 2).try_cast("int") == F.col("test_number")),
        "contiguous_pages": F.col("page_numbers") == F.sequence(F.col("start_page"), F.greatest("start_page", "end_page")), "starts_on_marker_page": F.col("start_page") == F.col("marker_page"),
    }, unique={"unique_test": ("paper_id", "test_number")}, order={"increasing_tests": (("paper_id",), "position", ("test_number",))})


def page_evidence() -> Entity:
    return Entity("page_evidence", ("paper_id", "page_number"), {
        "inside_page": F.forall("boxes", lambda b: B.contains(page_box(), b)), "regions_of_page": F.forall("region_pages", lambda p: p == F.col("page_number")),
    }, unique={"unique_page": ("paper_id", "page_number")}, pages=(("paper_id",), "page_number", "page_count"))


def test_evidence() -> Entity:
    same = lambda c: (c["paper_id"] == F.col("paper_id")) & (c["page_number"] == F.col("page_number")) & (c["test_number"] == F.col("test_number"))
    return Entity("test_evidence", ("paper_id", "page_number", "test_number"), {
        "region_inside_page": fits_page() & given("region"), "children_of_test": F.forall("children", same), "children_inside_region": F.forall("children", lambda c: B.contains(F.col("region"), c["box"])),
    })


ENTITIES = (ocr_sample, ocr_result, ocr_summary, evidence_sample, expansion_sample, mark_risk_candidate, expected_marker, detected_test, page_evidence, test_evidence)
