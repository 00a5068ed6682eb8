"""Each rule of each entity broken once: exactly that rule is reported."""

import pytest

from scriptorium.operators import entities as N

BOX = "struct<x:int,y:int,width:int,height:int>"
PAGE = {"page_width": 100, "page_height": 200}
CASES = {
    "ocr_sample": (
        f"sample_id string, paper_alias string, page_number int, page_width int, page_height int, categories array<string>, region {BOX}, ground_truth_status string, ground_truth_text string",
        {"sample_id": "s-001", "paper_alias": "paper-a", "page_number": 1, **PAGE, "categories": ["abc"], "region": (1, 1, 99, 199), "ground_truth_status": "verified", "ground_truth_text": "x"},
        {"safe_id": {"sample_id": "S 1"}, "safe_alias": {"paper_alias": "-ab"}, "positive_page": {"page_number": 0}, "has_category": {"categories": []}, "safe_categories": {"categories": ["A"]}, "region_inside_page": {"region": (1, 1, 100, 1)},
         "known_status": {"ground_truth_status": "else"}, "pending_state": {"ground_truth_status": "pending"}, "verified_state": {"ground_truth_text": " \n"}, "verified_empty_state": {"ground_truth_status": "verified_empty"}},
        [{"region": None}, {"ground_truth_status": "pending", "ground_truth_text": None}, {"ground_truth_status": "verified_empty", "ground_truth_text": ""}],
    ),
    "ocr_result": (
        "sample_id string, status string, prediction string, cer double, wer double, duration_ms double, error string, evidence string, preprocessing string",
        {"sample_id": "a", "status": "success", "prediction": "", "cer": 0.0, "wer": 0.0, "duration_ms": 1.0, "error": None, "evidence": None, "preprocessing": None},
        {"success_state": {"wer": None}, "failure_state": {"status": "failure", "error": "e"}, "known_status": {"status": "late"}},
        [{"status": "failure", "error": "e", "prediction": None, "cer": None, "wer": None, "duration_ms": None}],
    ),
    "ocr_summary": (
        "run string, total_samples int, successful_samples int, failed_samples int, empty_successful_predictions int",
        {"run": "r", "total_samples": 5, "successful_samples": 3, "failed_samples": 2, "empty_successful_predictions": 3},
        {"counts_balance": {"total_samples": 6}, "empty_among_successful": {"empty_successful_predictions": 4}, "counts_not_negative": {"failed_samples": -1, "total_samples": 2}}, [],
    ),
    "evidence_sample": (
        f"sample_id string, page_width int, page_height int, region {BOX}, categories array<string>, answer_regions array<{BOX}>, human_status string, evidence_type string, answer_regions_verified boolean",
        {"sample_id": "a", **PAGE, "region": (0, 0, 50, 50), "categories": ["a", "b"], "answer_regions": [(0, 0, 50, 50)], "human_status": "human_verified", "evidence_type": "printed", "answer_regions_verified": True},
        {"region_inside_page": {"region": (60, 0, 50, 50)}, "distinct_categories": {"categories": ["a", "a"]}, "answers_inside_region": {"answer_regions": [(1, 0, 50, 50)]}, "pending_state": {"human_status": "pending"},
         "human_verified_state": {"evidence_type": None}, "known_status": {"human_status": None}},
        [{"human_status": "pending", "evidence_type": None, "answer_regions_verified": False, "answer_regions": []}],
    ),
    "mark_risk_candidate": (
        f"sample_id string, page_width int, page_height int, region {BOX}, component {BOX}, signals array<string>, source_path string",
        {"sample_id": "a", **PAGE, "region": (0, 0, 50, 50), "component": (5, 5, 5, 5), "signals": ["a"], "source_path": "/p"},
        {"region_inside_page": {"region": (0, 0, 101, 50)}, "component_inside_region": {"component": (46, 5, 5, 5)}, "distinct_signals": {"signals": ["a", "a"]}, "absolute_path": {"source_path": "p"}}, [],
    ),
    "detected_test": (
        "paper_id int, position int, test_number int, marker_number int, label string, page_numbers array<int>, start_page int, end_page int, marker_page int",
        {"paper_id": 1, "position": 1, "test_number": 7, "marker_number": 7, "label": "Test 07", "page_numbers": [2, 3], "start_page": 2, "end_page": 3, "marker_page": 2},
        {"number_of_marker": {"marker_number": 8}, "label": {"label": "Test 08"}, "contiguous_pages": {"page_numbers": [2, 4]}, "starts_on_marker_page": {"marker_page": 3}}, [{"page_numbers": [2], "end_page": 2}],
    ),
    "test_evidence": (
        f"paper_id int, page_number int, test_number int, page_width int, page_height int, region {BOX}, children array<struct<paper_id:int,page_number:int,test_number:int,box:{BOX}>>",
        {"paper_id": 1, "page_number": 2, "test_number": 3, **PAGE, "region": (0, 0, 50, 50), "children": [(1, 2, 3, (0, 0, 9, 9))]},
        {"region_inside_page": {"region": (0, 0, 500, 50)}, "children_of_test": {"children": [(1, 2, 4, (0, 0, 9, 9))]}, "children_inside_region": {"children": [(1, 2, 3, (45, 0, 9, 9))]}}, [{"children": []}],
    ),
}


def broken(spark, name, schema, rows):
    columns = [c.split()[0] for c in schema.replace(f"{BOX}", "box").replace("struct<paper_id:int,page_number:int,test_number:int,box:box>", "children").split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)
    return df, N.violations(df, getattr(N, name)())


@pytest.mark.parametrize("name", CASES)
def test_each_rule_broken_once(spark, name):
    schema, good, bad, others = CASES[name]
    entity = getattr(N, name)()
    assert set(bad) == set(entity.rules)
    ident = entity.key[0]
    rows = [good | change for change in ({}, *others, *bad.values())]
    if ident != "paper_id":
        rows = [r if r[ident] != good[ident] else r | {ident: f"{good[ident]}-{k:02d}"} for k, r in enumerate(rows)]
    else:
        rows = [r | ({"paper_id": k, "children": [(k, *c[1:]) for c in r["children"]]} if "children" in r else {"paper_id": k}) for k, r in enumerate(rows)]
    df, found = broken(spark, name, schema, rows)
    got = {r[ident]: r["rule"] for r in found.collect()}
    assert got == {r[ident]: rule for r, rule in zip(rows[1 + len(others) :], bad, strict=True)} and found.count() == len(bad)
    assert N.valid(df, entity).count() == 1 + len(others)
    if entity.unique:
        _, twice = broken(spark, name, schema, [rows[0], rows[0]])
        assert {r["rule"] for r in twice.collect()} == set(entity.unique)


def test_rules_between_rows(spark):
    sample = f"position int, sample_id string, page_width int, page_height int, region {BOX}, context_tags array<string>, discovery_reason string, source_path string"
    rows = [(k, s, 100, 200, (0, 0, 9, 9), ["t"], "why-1", "/p") for k, s in enumerate(["a", "c", "b", "d"])] + [(9, "e", 100, 200, None, ["t", "t"], "?", "p")]
    got = {(r.sample_id, r["rule"]) for r in N.violations(spark.createDataFrame(rows, sample), N.expansion_sample()).collect()}
    assert got == {("b", "sorted_ids"), *(("e", r) for r in ("region_inside_page", "distinct_tags", "reason", "absolute_path"))}
    marker = "paper_id int, page_number int, test_number int, position int, y int, page_count int"
    rows = [(1, 1, 1, 0, 10, 2), (1, 1, 2, 1, 5, 2), (1, 3, 3, 2, 1, 2), (2, 1, 4, 0, 9, 1), (2, 1, 4, 1, 9, 1)]
    got = sorted((r.paper_id, r.test_number, r["rule"]) for r in N.violations(spark.createDataFrame(rows, marker), N.expected_marker()).collect())
    assert got == [(1, 2, "document_order"), (1, 3, "page_exists"), (2, 4, "unique_marker")]
    page = f"paper_id int, page_number int, page_count int, page_width int, page_height int, boxes array<{BOX}>, region_pages array<int>"
    rows = [(1, 1, 2, 100, 200, [(0, 0, 100, 200)], [1]), (1, 2, 2, 100, 200, [(1, 0, 100, 200)], [1]), (2, 1, 2, 100, 200, [], []), (3, 2, 1, 100, 200, [], [])]
    got = {(r.paper_id, r.page_number, r["rule"]) for r in N.violations(spark.createDataFrame(rows, page), N.page_evidence()).collect()}
    assert got == {(1, 2, "inside_page"), (1, 2, "regions_of_page"), (2, None, "pages_from_1_to_n"), (3, None, "pages_from_1_to_n")}
    tests = CASES["detected_test"]
    rows = [tests[1] | {"position": p, "test_number": n, "marker_number": n, "label": f"Test {n:02d}"} for p, n in enumerate((3, 5, 4))]
    assert [(r.test_number, r["rule"]) for r in broken(spark, "detected_test", tests[0], rows)[1].collect()] == [(4, "increasing_tests")]


def test_every_entity_is_covered(spark):
    elsewhere = {"expansion_sample", "expected_marker", "page_evidence"}
    assert {e.__name__ for e in N.ENTITIES} == set(CASES) | elsewhere
