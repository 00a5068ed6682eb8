"""Results must belong to their pages before papers are cut into sections."""

from scriptorium.operators.joins import match_results
from scriptorium.plans import structure as R

PAGE = "paper_id string, page_number int"
WORDS = f"{PAGE}, word_index int, text string, confidence double, x int, y int, width int, height int, block_number int, paragraph_number int, line_number int, word_number int"


def tables(spark, sources):
    """Papers a to d of two pages, a heading on each; ``sources`` of their results."""
    papers = "abcd"
    pages = spark.createDataFrame([(p, n, 1000, 1400, f"{p}/{n}") for p in papers for n in (1, 2)], f"{PAGE}, width int, height int, source_path string")
    words = [(p, n, i, t, 0.9, 100 + 90 * i, 200, 80, 25, 1, 1, 1, i + 1) for p in papers for n in (1, 2) for i, t in enumerate(("Test", str(n)))]
    return pages, spark.createDataFrame(words, WORDS), spark.createDataFrame(sources, f"{PAGE}, source_path string")


def test_each_status(spark):
    pages, _, results = tables(spark, [("a", 1, "a/1"), ("a", 2, "elsewhere"), ("b", 1, None), ("b", 3, "b/3")])
    got = {(r.paper_id, r.page_number): r.status for r in match_results(pages, results, ["paper_id", "page_number"], "source_path").collect()}
    assert got == {
        ("a", 1): "ok", ("a", 2): "source_mismatch", ("b", 1): "ok", ("b", 2): "missing_result", ("b", 3): "unexpected_result",
        **{(p, n): "missing_result" for p in "cd" for n in (1, 2)},
    }
    assert match_results(pages.limit(0), results.limit(0), ["paper_id", "page_number"], "source_path").count() == 0


def test_papers_with_foreign_results_are_left_out(spark):
    good = [(p, n, f"{p}/{n}") for p in "ad" for n in (1, 2)]
    pages, words, results = tables(spark, [*good, ("b", 1, "b/1"), ("b", 2, "a/2"), ("c", 1, "c/1")])
    s = R.exam_structure(pages, words, expected=(1, 2, 3), results=results)
    assert {(r.paper_id, r.page_number, r.status) for r in s["mismatches"].collect()} == {("b", 2, "source_mismatch"), ("c", 2, "missing_result")}
    assert {r.paper_id for r in s["markers"].collect()} == {"a", "d"}
    rollup = {(r.paper_id, r.page_number): r for r in s["rollup"].collect()}
    assert set(rollup) == {(p, n) for p in "ad" for n in (1, 2)}
    first = rollup["a", 1]
    assert [m.test_number for m in first.markers] == [1] and [(r.test_number, r.region.y, r.region.height) for r in first.regions] == [(1, 200, 1200)]
    assert [(r.test_number, r.region.y, r.region.height) for r in rollup["a", 2].regions] == [(1, 0, 200), (2, 200, 1200)]


def test_rollup_keeps_pages_without_children(spark):
    pages, words, _ = tables(spark, [("a", 1, "a/1")])
    s = R.exam_structure(pages, words.where("paper_id = 'a' and page_number = 1"), expected=(1,))
    rows = {(r.paper_id, r.page_number): (len(r.candidates), len(r.markers), len(r.regions)) for r in s["rollup"].collect()}
    assert rows["a", 1] == (1, 1, 1) and rows["a", 2] == (0, 0, 1) and rows["d", 2] == (0, 0, 0) and len(rows) == 8
    assert "mismatches" not in s
