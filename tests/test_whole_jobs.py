"""Queries whose views keep every row must still have their whole result."""

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import compare, connect


def whole(spark, name):
    df = entry.queries()[name](spark, SF)
    assert compare(df, connect(SF), entry.oracle_sql()[name]) == []
    return df.collect()


def test_numbers_of_unreadable_headings_are_missing(spark):
    documents = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    found = {(d // 8, 2 * (d % 8) + k) for d in documents for k in (1, 2) if (d + k) % 11}
    expected = {(p, n) for p in {d // 8 for d in documents} for n in range(1, 17)} - found
    assert expected and {(r.paper_id, r.test_number) for r in whole(spark, "u1_missing_numbers")} == expected


def test_samples_with_all_boxes_off_the_page_are_predicted_empty(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    on_page = {r.l_orderkey for r in lines.where("l_partkey % 700 % 5 <> 0").collect()}
    samples = {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    off_page = {r.l_orderkey for r in lines.collect()} & samples - on_page
    row = whole(spark, "a17_empty_samples")[0]
    assert off_page and row.predicted_empty_samples == len(samples - on_page)
