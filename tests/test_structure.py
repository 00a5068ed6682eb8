"""Heading detection, sequence choice and region cutting on small pages."""

import itertools
import random

from pyspark.sql import functions as F

from scriptorium.operators.sequences import increasing_chain, lcs_length
from scriptorium.plans import evidence as E
from scriptorium.plans import structure as R

WORD = (
    "paper_id string, page_number int, word_index int, text string, confidence double, x int, y int, width int, height int, "
    "block_number int, paragraph_number int, line_number int, word_number int"
)


def page_words(lines):
    """lines: (text, x, y[, confidence]) -> word rows of one page."""
    rows, index = [], 0
    for number, (text, x, y, *rest) in enumerate(lines, 1):
        for position, token in enumerate(text.split(" "), 1):
            rows.append(("p", 1, index, token, rest[0] if rest else 0.9, x + (position - 1) * 100, y, 80, 40, 1, 1, number, position))
            index += 1
    return rows


def detect(spark, lines):
    pages = spark.createDataFrame([("p", 1, 1000, 1400)], "paper_id string, page_number int, width int, height int")
    words = spark.createDataFrame(page_words(lines), WORD)
    return {r.marker_y: r for r in R.detect_markers(pages, words).collect()}


def test_heading_variants(spark):
    texts = ["Test 01", "TEST 02", "Test03", "Test O4", "Test Ol", "lest 05", "TesT 06", "§ Test 07", "Test - 04", "hello 03", "Test none", "Best1"]
    got = detect(spark, [(t, 100, 50 + 100 * i) for i, t in enumerate(texts)])
    numbers = {i: got[50 + 100 * i].test_number for i in range(len(texts)) if 50 + 100 * i in got}
    assert numbers == {0: 1, 1: 2, 2: 3, 3: 4, 4: 1, 5: 5, 6: 6, 7: 7, 8: 4, 11: 1}
    strategies = [got[50 + 100 * i].strategy for i in range(7)]
    assert strategies == ["exact_tokens", "exact_tokens", "compact_token", "ocr_confusion", "ocr_confusion", "ocr_confusion", "exact_tokens"]
    assert got[50].source_word_indices == [0, 1]


def test_confidence_values(spark):
    got = detect(spark, [("Test 01", 100, 100), ("Test O4", 100, 200), ("lest 05", 100, 300), ("Test 02 is in this sentence", 100, 500), ("Test 03", 100, 1320)])
    values = {y: round(r.confidence, 6) for y, r in got.items()}
    assert values == {100: 0.98, 200: 0.94, 300: 0.8925, 500: round(0.6072083333, 6), 1320: 0.49775}


def chain_of(spark, items, expected, threshold=0.6):
    rows = [("p", i, n, c) for i, (n, c) in enumerate(items)]
    df = spark.createDataFrame(rows, "paper_id string, candidate_no int, test_number int, confidence double")
    return sorted(r.candidate_no for r in increasing_chain(df, expected, threshold).collect())


def test_sequence_golden(spark):
    assert chain_of(spark, [(1, 0.9), (3, 0.8), (2, 0.95), (3, 0.95), (4, 0.9)], range(1, 5)) == [0, 2, 3, 4]
    assert chain_of(spark, [(1, 0.9), (88, 0.99)], [1, 2, 3]) == [0]


def test_sequence_equals_exhaustive_search(spark):
    rng = random.Random(5)
    for _ in range(4):
        items = [(rng.randint(1, 6), rng.choice([0.7, 0.8, 0.9])) for _ in range(9)]

        def score(chain, items=items):
            total = items[chain[0]][1] + (0.1 if items[chain[0]][0] == 1 else 0)
            for a, b in itertools.pairwise(chain):
                gap = items[b][0] - items[a][0]
                total = total + items[b][1] + 0.25 * {1: 1.0, 2: 0.7}.get(gap, 0.4)
            return total

        best = max(
            score(c) for k in range(1, 7) for c in itertools.combinations(range(9), k)
            if all(items[a][0] < items[b][0] for a, b in itertools.pairwise(c))
        )
        assert abs(score(chain_of(spark, items, range(1, 7))) - best) < 1e-9


def test_segments_across_pages_and_violation(spark):
    pages = spark.createDataFrame([("p", n, 1000, 1400) for n in (1, 2, 3)] + [("q", 1, 1000, 1400), ("q", 2, 1000, 1400)], "paper_id string, page_number int, width int, height int")
    markers = spark.createDataFrame(
        [("p", 1, 0, 1, 100), ("p", 1, 1, 2, 900), ("p", 3, 2, 3, 200), ("q", 1, 0, 1, 10), ("q", 2, 1, 2, 0)],
        "paper_id string, page_number int, candidate_no int, test_number int, marker_y int",
    )
    regions, flat = R.segment_regions(pages, markers)
    got = sorted((r.test_number, r.page_number, r.region.y, r.region.height) for r in regions.collect())
    assert got == [(1, 1, 100, 800), (2, 1, 900, 500), (2, 2, 0, 1400), (2, 3, 0, 200), (3, 3, 200, 1200)]
    assert [(r.paper_id, r.test_number) for r in flat.collect()] == [("q", 1)]


def test_layout_text(spark):
    words = spark.createDataFrame(page_words([("one two", 10, 10), ("three", 10, 60)]), WORD)
    assert R.layout_text(words).first().layout_text == "one two\nthree"
    loose = words.withColumn("block_number", F.lit(None).cast("int")).withColumn("line_number", F.lit(None).cast("int"))
    assert R.layout_text(loose).first().layout_text == "one two\n\nthree"


def test_common_subsequence(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 3, 4, 2]), ([], [1]), ([5], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(lcs_length(F.col("a"), F.col("b"))).collect()] == [3, 0, 0]


def test_answers_are_numbered_as_opened(spark):
    key = "paper_id int, page_number int, test_number int"
    box = "struct<x:int,y:int,width:int,height:int>"
    regions = spark.createDataFrame([(1, 1, 1, (0, 0, 1000, 1000))], f"{key}, region {box}")
    lines = spark.createDataFrame([], f"{key}, line_box {box}")
    boxes = [(100, 40, 20, 5), (300, 40, 20, 5), (60, 41, 240, 5)]  # the third joins the second, and reaches left of the first
    evidence = spark.createDataFrame([(1, 1, 1, i, "student_candidate", b) for i, b in enumerate(boxes)], f"{key}, evidence_no int, evidence_type string, box {box}")
    found = {r.answer_no: (r.box.x, list(r.source_indices)) for r in E.answer_regions(regions, lines, evidence).collect()}
    assert found == {0: (82, [0]), 1: (42, [1, 2])}
