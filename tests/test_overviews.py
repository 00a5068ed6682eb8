"""Overviews of datasets and manifests against values counted by hand."""

import pytest
from pyspark.sql import functions as F

from scriptorium.plans import overviews as O
from scriptorium.sources.inventory import parse_key_values

FILES = "pages int, size_bytes long, encrypted boolean, text string"
IMAGES = "width int, height int, encoding string"
SAMPLES = "dataset_id string, paper_alias string, page_number int, test_number int, categories array<string>, signals array<string>"


def test_dataset_summary(spark):
    files = spark.createDataFrame([(2, 10, False, "x"), (5, 20, True, " \n "), (2, 30, None, None), (9, 40, False, "")], FILES)
    images = spark.createDataFrame([(100, 7, "jpeg"), (200, 9, "ccitt"), (301, 8, None)], IMAGES)
    r = O.dataset_summary(files, images).first().asDict()
    assert r == {
        "files": 4, "total_pages": 18, "total_bytes": 100, "min_pages": 2, "max_pages": 9, "median_pages": 3.5, "textless": 3, "encrypted": 1,
        "images": 3, "jpeg_images": 1, "min_width": 100, "max_width": 301, "median_width": 200.0, "min_height": 7, "max_height": 9, "median_height": 8.0,
    }
    assert {(d.page_count, d.files) for d in O.page_count_distribution(files).collect()} == {(2, 2), (5, 1), (9, 1)}
    with pytest.raises(Exception, match="no files were given"):
        O.dataset_summary(files.limit(0), images).collect()
    with pytest.raises(Exception, match="no images were found"):
        O.dataset_summary(files, images.limit(0)).collect()


def test_manifest_counts(spark):
    rows = [
        ("d", "a", 1, 4, ["x"], ["s", "t"]), ("d", "a", 1, None, ["x", "y"], ["s"]), ("d", "a", 2, 5, ["y"], []), ("d", "b", 1, None, None, ["t"]), ("e", "a", 1, 1, [], None),
    ]
    got = {(r.dataset_id, r.metric, r.value): r.n for r in O.manifest_counts(spark.createDataFrame(rows, SAMPLES)).collect()}
    assert got == {
        ("d", "samples", ""): 4, ("d", "numbered", ""): 2, ("d", "distinct_papers", ""): 2, ("d", "distinct_pages", ""): 3, ("d", "paper", "a"): 3, ("d", "paper", "b"): 1,
        ("d", "category", "x"): 2, ("d", "category", "y"): 2, ("d", "signal", "s"): 2, ("d", "signal", "t"): 2,
        ("e", "samples", ""): 1, ("e", "numbered", ""): 1, ("e", "distinct_papers", ""): 1, ("e", "distinct_pages", ""): 1, ("e", "paper", "a"): 1,
    }
    assert O.manifest_counts(spark.createDataFrame([], SAMPLES)).count() == 0


def test_page_picks(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 11, 100)], "n int").select("n", O.page_picks(F.col("n")).alias("p"))
    expected = {n: sorted({max(0, min(n - 1, round((n - 1) * f))) for f in (0.15, 0.40, 0.65, 0.88)}) for n in (1, 2, 3, 11, 100)}
    assert {r.n: r.p for r in df.collect()} == expected


def test_key_values_split_at_the_first_colon(spark):
    lines = spark.createDataFrame([("Title:   a: b",), (" Pages :3 ",), ("none",), ("Tagged:",)], "line string")
    assert [(r.key, r.value) for r in parse_key_values(lines).collect()] == [("Title", "a: b"), ("Pages", "3"), ("Tagged", "")]
