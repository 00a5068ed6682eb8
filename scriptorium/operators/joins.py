"""Spatial joins built on plain equi-joins over grid cells.

Spark has no range-join node. Exploding boxes over the cells they touch turns a
spatial predicate into an equi-join whose key spreads a crowded page over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import boxes as B


def _span(low: Column, high: Column, cell: int) -> Column:
    return F.sequence(F.floor(low / cell).cast("int"), F.floor(high / cell).cast("int"))


def in_cells(df: DataFrame, box: str | Column, cell: int) -> DataFrame:
    """One row per (row, touched cell); empty boxes touch no cell."""
    b = B.col(box)
    return (
        df.where((b["width"] > 0) & (b["height"] > 0))
        .withColumn("_cx", F.explode(_span(b["x"], B.right(b) - 1, cell)))
        .withColumn("_cy", F.explode(_span(b["y"], B.bottom(b) - 1, cell)))
    )


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_box: str,
    right_box: str,
    cell: int = 256,
) -> DataFrame:
    """Every pair of boxes with a common pixel, exactly once.

    Both sides are exploded over cells; a pair is reported only in the cell that holds the
    top-left corner of its intersection, so no distinct is needed afterwards. Apart from
    ``keys`` the two sides must not share column names.
    """
    a, b = F.col(left_box), F.col(right_box)
    joined = in_cells(left, left_box, cell).join(in_cells(right, right_box, cell), [*keys, "_cx", "_cy"])
    here = (F.floor(F.greatest(a["x"], b["x"]) / cell) == F.col("_cx")) & (
        F.floor(F.greatest(a["y"], b["y"]) / cell) == F.col("_cy")
    )
    return joined.where(B.intersects(a, b) & here).drop("_cx", "_cy")


#: Bits of the filter of ``possible_members``; it has a row per 64 of them.
FILTER_BITS = 1 << 25


def possible_members(rows: DataFrame, members: DataFrame, keys: Sequence[str], bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not in ``members``; no other row is lost.

    Each member sets the bit its hash points at. The bits go to every task and never take more
    than ``bits / 64`` rows, however many members there are. A semi-join decides afterwards; its
    shuffle then holds the rows it keeps and the few that share a bit with a member.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    bit = F.expr("shiftleft(1L, cast(_place & 63 as int))")
    slot = F.shiftright("_place", 6).alias("_slot")
    set_bits = members.select(place.alias("_place")).groupBy(slot).agg(F.bit_or(bit).alias("_bits"))
    return (
        rows.withColumn("_place", place).withColumn("_slot", slot)
        .join(F.broadcast(set_bits), "_slot")
        .where(F.col("_bits").bitwiseAND(bit) != 0)
        .select(*rows.columns)
    )


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    low: Column,
    high: Column,
    position: Column,
    cell: int = 128,
    how: str = "inner",
) -> DataFrame:
    """Rows whose right-hand ``position`` lies in the left-hand ``[low, high]``.

    Left rows are exploded over the cells of their band; a right row sits in one cell, so
    each pair meets once. With ``how="left_semi"`` the right side decides membership only.
    """
    spread = left.withColumn("_lo", low.cast("double")).withColumn("_hi", high.cast("double"))
    spread = spread.withColumn("_cell", F.explode(_span(F.col("_lo"), F.col("_hi"), cell)))
    placed = right.withColumn("_pos", position.cast("double")).withColumn(
        "_cell", F.floor(F.col("_pos") / cell).cast("int")
    )
    same = [spread[k] == placed[k] for k in [*keys, "_cell"]]
    condition = same[0]
    for term in same[1:]:
        condition = condition & term
    condition = condition & placed["_pos"].between(spread["_lo"], spread["_hi"])
    joined = spread.join(placed, condition, how)
    for key in [*keys, "_cell"]:
        joined = joined.drop(placed[key])
    return joined.drop("_lo", "_hi", "_pos", "_cell")


def preceding_marker(
    rows: DataFrame,
    markers: DataFrame,
    keys: Sequence[str],
    y: Column,
    output: str = "nearest_test",
) -> DataFrame:
    """As-of join: number of the lowest marker at or above ``y`` on the same page.

    Markers are reduced to one per pixel row first (the left-most wins), so the array a page
    carries is bounded by its height in pixels. The join then has one row per page on its
    right side: no row is multiplied and a crowded page is split freely on the left.
    ``markers`` has columns ``keys``, marker_x, marker_y, test_number.
    """
    per_row = markers.groupBy(*keys, "marker_y").agg(
        F.min(F.struct("marker_x", "test_number")).alias("first")
    )
    per_page = per_row.groupBy(*keys).agg(
        F.collect_list(F.struct("marker_y", F.col("first.test_number").alias("n"))).alias("_markers")
    )
    return (
        rows.join(per_page, list(keys), "left")
        .withColumn("_y", y)
        .withColumn(
            output,
            F.array_max(F.filter("_markers", lambda m: m["marker_y"] <= F.col("_y")))["n"].cast("int"),
        )
        .drop("_markers", "_y")
    )


def status_compare(
    before: DataFrame, after: DataFrame, keys: Sequence[str], digest: str, output: str = "status"
) -> DataFrame:
    """Full-outer comparison of two inventories by content digest."""
    a = before.select(*keys, F.col(digest).alias("digest_before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(digest).alias("digest_after"), F.lit(True).alias("_b"))
    return (
        a.join(b, list(keys), "full_outer")
        .withColumn(
            output,
            F.when(F.col("_a").isNull(), "added")
            .when(F.col("_b").isNull(), "removed")
            .when(F.col("digest_before").eqNullSafe(F.col("digest_after")), "same")
            .otherwise("changed"),
        )
        .drop("_a", "_b")
    )


def match_results(pages: DataFrame, results: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """(keys, status) of every page and every result: ok, missing_result, unexpected_result or source_mismatch.

    A page has one result, read from the page's own file. An unknown source on either side does
    not contradict the other; a repeated key gives a row per combination.
    """
    keys = list(keys)
    a = pages.select(*keys, F.col(source).alias("_of_page"), F.lit(True).alias("_page"))
    b = results.select(*keys, F.col(source).alias("_of_result"), F.lit(True).alias("_result"))
    status = (
        F.when(F.col("_page").isNull(), "unexpected_result")
        .when(F.col("_result").isNull(), "missing_result")
        .when(F.col("_of_page") != F.col("_of_result"), "source_mismatch")
        .otherwise("ok")
    )
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Identifiers present on one side only, labelled missing or unexpected."""
    missing = expected.select(key).join(actual.select(key), key, "left_anti")
    extra = actual.select(key).join(expected.select(key), key, "left_anti")
    return missing.withColumn("problem", F.lit("missing")).unionByName(
        extra.withColumn("problem", F.lit("unexpected"))
    )
