"""Rows dealt by page stay there, and words of no promising line do not reach a shuffle."""

import re

from pyspark.sql import functions as F

from scriptorium.catalog.fixtures import Fixtures
from scriptorium.operators.joins import possible_members
from scriptorium.plans import sampling as P
from scriptorium.plans import structure as R
from tests.conftest import SF


def test_filter_loses_no_member_and_most_others_go(spark):
    rows = spark.range(20000).select((F.col("id") % 50).alias("a"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("b"), "id")
    members = rows.where("id % 100 = 3").select("a", "b")
    for bits, most in ((64, 20000), (1 << 20, 400)):
        left = possible_members(rows, members, ["a", "b"], bits)
        assert left.columns == rows.columns and left.where("id % 100 = 3 and b is not null").count() == members.where("b is not null").count()
        assert left.join(members, ["a", "b"], "left_semi").count() == rows.join(members, ["a", "b"], "left_semi").count()
        assert left.where("b is not null").count() <= most


def test_components_are_dealt_by_page_only(spark):
    fx = Fixtures(spark, SF)
    pages, words = fx.pages(), fx.words()
    out = P.discover_mark_risk(pages, words, R.detect_markers(pages, words), fx.components())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"hashpartitioning\([^)]*component_no", plan)
    assert not re.findall(r"hashpartitioning\(_doc", plan)
