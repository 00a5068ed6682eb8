"""Label log, current labels, versions, frozen snapshots and gates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import boxes as B
from scriptorium.functions import text as T
from scriptorium.functions.scoring import EVIDENCE_TYPES
from scriptorium.operators import fingerprints as P
from scriptorium.operators.joins import coverage
from scriptorium.operators.rules import check_rules, split_valid, unique_violations

# Texts accepted as an explicit statement that a sample is empty.
EMPTY_STATEMENTS = ("empty", "none", "no student-answer text", "no student answer text")
BOX_SCHEMA = "array<struct<bbox:struct<x:string,y:string,width:string,height:string>>>"


def strict_boxes(raw: Column) -> Column:
    """Box array from JSON text; NULL when a coordinate is not a plain integer literal.

    Text and floating-point coordinates must not be coerced, so coordinates are read as
    strings and the JSON text itself is checked for the exact field set. White space may stand
    between tokens only; a coordinate beyond 32 bits makes the value NULL.
    """
    integer = r"(?:0|-?[1-9][0-9]*)"
    gap = r"[ \t\r\n]*"
    field = rf'{gap}"(?:x|y|width|height)"{gap}:{gap}{integer}{gap}'
    one = rf'{gap}\{{{gap}"bbox"{gap}:{gap}\{{{field},{field},{field},{field}\}}{gap}\}}{gap}'
    plain = raw.rlike(rf"\A{gap}\[(?:{one}(?:,{one})*|{gap})\]{gap}\z")
    parsed = F.from_json(F.when(plain, raw), BOX_SCHEMA)
    sides = ("x", "y", "width", "height")
    boxes = F.transform(parsed, lambda r: B.box(*[r["bbox"][side].try_cast("int") for side in sides]))
    complete = F.forall(boxes, lambda b: b["x"].isNotNull() & b["y"].isNotNull() & b["width"].isNotNull() & b["height"].isNotNull())
    return F.when(complete, boxes)


def save_rules(crop_width: Column, crop_height: Column) -> dict[str, Column]:
    """Rules every save must satisfy, first broken rule wins as reject reason."""
    boxes = F.col("boxes")
    return {
        "known_sample": crop_width.isNotNull(),
        "known_class": F.col("evidence_type").isin(*EVIDENCE_TYPES),
        "integer_boxes": boxes.isNotNull(),
        "positive_boxes": F.forall(boxes, lambda b: (b["width"] > 0) & (b["height"] > 0) & (b["x"] >= 0) & (b["y"] >= 0)),
        "boxes_inside_crop": F.forall(
            boxes, lambda b: (b["x"] + b["width"] <= crop_width) & (b["y"] + b["height"] <= crop_height)
        ),
        "answer_state_explicit": F.when(F.col("answer_status") == "annotated", F.size(boxes) > 0).when(
            F.col("answer_status") == "verified_empty", F.size(boxes) == 0
        ),
        "human_verified": F.col("human_verified"),
    }


def validated_saves(saves: DataFrame, samples: DataFrame) -> DataFrame:
    """Saves with ``reject_reason``. ``samples``: sample_id, crop_width, crop_height."""
    joined = saves.join(samples.select("sample_id", "crop_width", "crop_height"), "sample_id", "left")
    return split_valid(joined, save_rules(F.col("crop_width"), F.col("crop_height"))).drop("crop_width", "crop_height")


def current_labels(saves: DataFrame, order: Sequence[str], key: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Latest save per sample. An aggregate, not a window: partial maxima shrink hot samples."""
    rest = [c for c in saves.columns if c not in key]
    return saves.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(*key, "_s.*").select(
        *saves.columns
    )


def with_record(labels: DataFrame) -> DataFrame:
    record = P.annotation_json(F.col("boxes"))
    return labels.withColumn("record", record).withColumn("fingerprint", P.record_fingerprint(F.col("record")))


def version_history(saves: DataFrame, moment: str, sequence: str, bucket: Column) -> DataFrame:
    """Saves that changed the content of their sample; repeated content adds nothing.

    ``bucket`` splits time so that one busy sample is compared by many tasks; the first save
    of a bucket is compared with the last one of the sample's bucket before it.
    """
    key = ["sample_id"]
    rows = with_record(saves).withColumn("_bucket", bucket)
    last = (
        rows.groupBy(*key, "_bucket")
        .agg(F.max_by("fingerprint", F.struct(moment, sequence)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*key).orderBy("_bucket")))
        .drop("_last")
    )
    inside = Window.partitionBy(*key, "_bucket").orderBy(moment, sequence)
    previous = F.coalesce(F.lag("fingerprint").over(inside), F.col("_carry"))
    return (
        rows.join(last, [*key, "_bucket"])
        .withColumn("previous_fingerprint", previous)
        .where(F.col("previous_fingerprint").isNull() | (F.col("previous_fingerprint") != F.col("fingerprint")))
        .drop("_bucket", "_carry")
    )


def progress(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Completed and total samples, readiness and class distribution as columns."""
    joined = samples.select("sample_id").join(labels.select("sample_id", "evidence_type"), "sample_id", "left")
    return joined.agg(
        F.count("evidence_type").alias("completed"),
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("evidence_type") == c).alias(f"n_{c}") for c in EVIDENCE_TYPES],
    ).withColumn("ready", F.col("completed") == F.col("total"))


def validate_labels(samples: DataFrame, labels: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Problems that keep a label set from being complete and valid.

    ``images`` (sample_id) lists samples whose crop image exists.
    """
    problems = coverage(samples, labels, "sample_id")
    checked = labels.join(samples.select("sample_id", "crop_width", "crop_height"), "sample_id")
    inside = F.forall(
        "boxes", lambda b: (b["x"] + b["width"] <= F.col("crop_width")) & (b["y"] + b["height"] <= F.col("crop_height"))
    )
    rules = {"not_human_verified": F.col("human_verified"), "box_outside_crop": inside}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    problems = problems.unionByName(checked.select("sample_id", F.explode(broken).alias("problem")))
    if images is not None:
        absent = samples.select("sample_id").join(images.select("sample_id"), "sample_id", "left_anti")
        problems = problems.unionByName(absent.withColumn("problem", F.lit("image_missing")))
    return problems


def label_problems(labels: DataFrame) -> DataFrame:
    """sample_id and ``problem`` of labels that contradict themselves, or of samples labelled twice."""
    boxes = F.col("boxes")
    rules = {
        "unknown_class": F.col("evidence_type").isin(*EVIDENCE_TYPES),
        "answer_state": F.when(F.col("answer_status") == "annotated", F.size(boxes) > 0).when(F.col("answer_status") == "verified_empty", F.size(boxes) == 0),
        "box_not_positive": F.forall(boxes, lambda b: (b["width"] > 0) & (b["height"] > 0) & (b["x"] >= 0) & (b["y"] >= 0)),
    }
    broken = check_rules(labels, ["sample_id"], rules).withColumnRenamed("rule", "problem")
    twice = unique_violations(labels, ["sample_id"], "duplicate_label").withColumnRenamed("rule", "problem")
    return broken.unionByName(twice)


def provenance(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Safe counts that accompany a frozen label set."""
    return labels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("annotation_count"),
        *[F.count_if(F.col("evidence_type") == c).alias(f"n_{c}") for c in EVIDENCE_TYPES],
        F.count_if(F.size("boxes") > 0).alias("samples_with_answer_regions"),
        F.count_if(F.col("answer_status") == "verified_empty").alias("verified_empty_count"),
        F.coalesce(F.sum(F.size("boxes")), F.lit(0)).cast("long").alias("human_answer_box_count"),
    )


def freeze_labels(labels: DataFrame, keys: Sequence[str], form: Callable[..., DataFrame] = P.canonical_fingerprint) -> tuple[DataFrame, DataFrame]:
    """(snapshot rows, one provenance row per dataset with its fingerprint of the chosen form)."""
    snapshot = with_record(labels)
    prints = form(snapshot, keys, "sample_id", "record").drop("record_count")
    return snapshot, provenance(labels, keys).join(prints, list(keys))


def verify_frozen(snapshot: DataFrame, recorded: DataFrame, keys: Sequence[str], form: Callable[..., DataFrame] = P.canonical_fingerprint) -> DataFrame:
    """Datasets whose recomputed fingerprint or counts differ from the recorded ones."""
    keys = list(keys)
    _, now = freeze_labels(snapshot, keys, form)
    compared = ["fingerprint", "annotation_count", "human_answer_box_count"]
    again = now.select(*keys, *[F.col(c).alias(f"now_{c}") for c in compared])
    joined = recorded.select(*keys, *compared).join(again, keys, "full_outer")
    same = F.lit(True)
    for name in compared:
        same = same & F.col(name).eqNullSafe(F.col(f"now_{name}"))
    return joined.where(~same)


def approvals(ledger: DataFrame, order: Sequence[str]) -> DataFrame:
    """Last approved fingerprint per session and sample."""
    return current_labels(ledger, order, ("session_id", "sample_id"))


def reverification_status(samples: DataFrame, labels: DataFrame, approved: DataFrame) -> DataFrame:
    """valid, changed or missing approval per sample; approvals of unknown samples show up too."""
    current = labels.select("sample_id", F.col("fingerprint").alias("current_fingerprint"))
    known = samples.select("sample_id").withColumn("_known", F.lit(True))
    return (
        known.join(approved.select("sample_id", "approved_fingerprint"), "sample_id", "full_outer")
        .join(current, "sample_id", "left")
        .select(
            "sample_id",
            F.when(F.col("_known").isNull(), "unknown_sample")
            .when(F.col("approved_fingerprint").isNull(), "missing")
            .when(F.col("approved_fingerprint") == F.col("current_fingerprint"), "valid")
            .otherwise("changed")
            .alias("status"),
        )
    )


def still_valid(labels: DataFrame, approved: DataFrame) -> DataFrame:
    """Labels whose current content is the approved one."""
    keys = approved.select("sample_id", F.col("approved_fingerprint").alias("fingerprint"))
    return labels.join(keys, ["sample_id", "fingerprint"], "left_semi")


def freeze_ground_truth(samples: DataFrame, worksheet: DataFrame, verified_empty: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frozen samples, violations) from transcriptions entered in a worksheet: one of them is empty.

    ``samples``: sample_id, notes. ``worksheet``: sample_id, entered_text. ``verified_empty``:
    sample_id. ``notes``: sample_id, note. All or nothing: any violation leaves no frozen row.
    """
    entered = (
        samples.join(worksheet, "sample_id")
        .join(verified_empty.select("sample_id").withColumn("_empty", F.lit(True)), "sample_id", "left")
        .join(notes, "sample_id", "left")
        .withColumn("_empty", F.coalesce("_empty", F.lit(False)))
        .withColumn("_text", F.regexp_replace("entered_text", r"(?U)\A\s+|\s+\z", ""))
    )
    blank = F.length("_text") == 0
    rule = F.when(
        F.col("_empty") & ~blank & ~F.lower("_text").isin(*EMPTY_STATEMENTS), "unexpected_text_in_verified_empty"
    ).when(~F.col("_empty") & blank, "pending_blank_transcription")
    outcome = entered.withColumn("rule", rule)
    frozen = outcome.where(F.col("rule").isNull()).select(
        "sample_id",
        F.when(F.col("_empty"), "verified_empty").otherwise("verified").alias("ground_truth_status"),
        F.when(F.col("_empty"), "").otherwise(F.col("entered_text")).alias("ground_truth_text"),
        F.when(F.col("note").isNull(), F.col("notes")).otherwise(T.append_note(F.col("notes"), F.col("note"))).alias("notes"),
    )
    problems = coverage(samples, worksheet, "sample_id").select("sample_id", F.col("problem").alias("rule"))
    unknown = coverage(samples, verified_empty, "sample_id").where("problem = 'unexpected'").select(
        "sample_id", F.lit("unknown_verified_empty").alias("rule")
    )
    unknown_notes = coverage(samples, notes, "sample_id").where("problem = 'unexpected'").select(
        "sample_id", F.lit("unknown_note").alias("rule")
    )
    blank_notes = notes.where(F.coalesce(F.regexp_replace("note", r"(?U)\s+", ""), F.lit("")) == "").select("sample_id", F.lit("blank_note").alias("rule"))
    violations = outcome.where(F.col("rule").isNotNull()).select("sample_id", "rule")
    for more in (problems, unknown, unknown_notes, blank_notes, unique_violations(worksheet, ["sample_id"], "duplicate_sample"), unique_violations(notes, ["sample_id"], "duplicate_note")):
        violations = violations.unionByName(more)
    any_bad = F.broadcast(violations.limit(1).select(F.lit(1).alias("_any")))
    return frozen.withColumn("_any", F.lit(1)).join(any_bad, "_any", "left_anti").drop("_any"), violations


def ground_truth_record() -> Column:
    return P.canonical_json(
        {"sample_id": F.col("sample_id"), "status": F.col("ground_truth_status"), "student_text": F.col("ground_truth_text")}
    )


def compare_constants(observed: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Integrity gate: (name, observed, expected) rows that disagree."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(str(v)).alias("expected")) for k, v in expected.items()]))
    wanted = observed.sparkSession.range(1).select(pairs.alias("p")).select("p.*")
    return observed.join(wanted, "name", "full_outer").where(~F.col("observed").eqNullSafe(F.col("expected")))


def gate_benchmark(samples: DataFrame, recorded: DataFrame, keys: Sequence[str], fingerprints: Callable[..., DataFrame]) -> DataFrame:
    """Per dataset: first reason why the benchmark must not be scored, NULL when it may.

    ``recorded``: keys, sample_count and fingerprint as frozen. ``fingerprints`` makes keys and
    fingerprint of the samples. A dataset that only one side knows is not ready or not frozen.
    """
    keys = list(keys)
    ready = F.col("ground_truth_status").isin("verified", "verified_empty")
    facts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"), F.count_if(~F.coalesce(ready, F.lit(False))).alias("pending_count"))
    frozen = recorded.select(*keys, F.col("sample_count").alias("_count"), F.col("fingerprint").alias("_print"))
    joined = facts.join(fingerprints(samples, keys), keys).join(frozen, keys, "full_outer")
    unready = F.col("sample_count").isNull() | (F.col("pending_count") > 0) | (F.col("sample_count") != F.col("_count"))
    return joined.select(
        *keys, "sample_count", "pending_count", "fingerprint",
        F.when(F.col("_print").isNull(), "not_frozen").when(unready, "not_ready").when(F.col("fingerprint") != F.col("_print"), "fingerprint_mismatch").alias("blocked_by"),
    )


def labelled_datasets(datasets: DataFrame, labels: DataFrame) -> DataFrame:
    """Datasets that must not be rebuilt because human labels exist."""
    return datasets.join(labels.select("dataset_id").distinct(), "dataset_id", "left_semi")
