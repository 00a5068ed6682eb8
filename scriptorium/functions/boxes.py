"""Integer pixel-box algebra as pure column expressions.

A box is a struct ``(x, y, width, height)``; right and bottom edges are exclusive.
Areas are computed as longs because a page can exceed 2^31 pixels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def box(x, y, width, height) -> Column:
    def as_int(value):
        return (F.lit(value) if isinstance(value, int) else col(value)).cast("int")

    return F.struct(
        as_int(x).alias("x"),
        as_int(y).alias("y"),
        as_int(width).alias("width"),
        as_int(height).alias("height"),
    )


def from_edges(left, top, right, bottom) -> Column:
    return box(left, top, right - left, bottom - top)


def right(b) -> Column:
    return col(b)["x"] + col(b)["width"]


def bottom(b) -> Column:
    return col(b)["y"] + col(b)["height"]


def area(b) -> Column:
    return col(b)["width"].cast("long") * col(b)["height"].cast("long")


def centre_x(b) -> Column:
    return col(b)["x"] + col(b)["width"] / F.lit(2.0)


def centre_y(b) -> Column:
    return col(b)["y"] + col(b)["height"] / F.lit(2.0)


def _overlap(a, b) -> tuple[Column, Column, Column, Column]:
    a, b = col(a), col(b)
    return (
        F.greatest(a["x"], b["x"]),
        F.greatest(a["y"], b["y"]),
        F.least(right(a), right(b)),
        F.least(bottom(a), bottom(b)),
    )


def intersection_area(a, b) -> Column:
    left, top, r, btm = _overlap(a, b)
    return F.greatest(F.lit(0), r - left).cast("long") * F.greatest(F.lit(0), btm - top).cast("long")


def intersects(a, b) -> Column:
    left, top, r, btm = _overlap(a, b)
    return (r > left) & (btm > top)


def intersection_box(a, b) -> Column:
    left, top, r, btm = _overlap(a, b)
    return F.when((r > left) & (btm > top), from_edges(left, top, r, btm))


def union_box(a, b) -> Column:
    a, b = col(a), col(b)
    return from_edges(
        F.least(a["x"], b["x"]),
        F.least(a["y"], b["y"]),
        F.greatest(right(a), right(b)),
        F.greatest(bottom(a), bottom(b)),
    )


def iou(a, b) -> Column:
    inter = intersection_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter.cast("double") / union.cast("double")).otherwise(F.lit(0.0))


def overlap_of_smaller(a, b) -> Column:
    """Intersection area divided by the area of the smaller box."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection_area(a, b).cast("double") / smaller.cast("double"))


def contains(outer, inner) -> Column:
    outer, inner = col(outer), col(inner)
    return (
        (inner["x"] >= outer["x"])
        & (inner["y"] >= outer["y"])
        & (right(inner) <= right(outer))
        & (bottom(inner) <= bottom(outer))
    )


def expand(b, limit, padding: int) -> Column:
    b, limit = col(b), col(limit)
    return from_edges(
        F.greatest(limit["x"], b["x"] - padding),
        F.greatest(limit["y"], b["y"] - padding),
        F.least(right(limit), right(b) + padding),
        F.least(bottom(limit), bottom(b) + padding),
    )


def _centred(b, page_width, page_height, target_width, target_height) -> Column:
    """Centre the box in the target size, then push the crop back onto the page.

    The slack is halved with floor, which differs from truncation for a box that is
    larger than its target.
    """
    b = col(b)
    x = F.greatest(F.lit(0), b["x"] - F.floor((target_width - b["width"]) / 2).cast("int"))
    y = F.greatest(F.lit(0), b["y"] - F.floor((target_height - b["height"]) / 2).cast("int"))
    return box(
        F.least(x, page_width - target_width),
        F.least(y, page_height - target_height),
        target_width,
        target_height,
    )


def context_crop(b, page_width, page_height) -> Column:
    """Crop of at least 700x360 with 240x220 of slack."""
    b = col(b)
    width = F.least(page_width, F.greatest(F.lit(700), b["width"] + 240))
    height = F.least(page_height, F.greatest(F.lit(360), b["height"] + 220))
    return _centred(b, page_width, page_height, width, height)


def bounded_crop(b, page_width, page_height) -> Column:
    """Crop of 620..940 x 380..720 with 420x320 of slack."""
    b = col(b)
    width = F.least(page_width, F.greatest(F.lit(620), F.least(F.lit(940), b["width"] + 420)))
    height = F.least(page_height, F.greatest(F.lit(380), F.least(F.lit(720), b["height"] + 320)))
    return _centred(b, page_width, page_height, width, height)


def centre_distance(a, b) -> Column:
    return F.hypot(centre_x(a) - centre_x(b), centre_y(a) - centre_y(b))


def vertical_distance(a, b) -> Column:
    return F.abs(centre_y(a) - centre_y(b))


def touches_margin(b, page_width) -> Column:
    """1.0 when the box starts in the left 8 % or ends in the right 8 % of the page."""
    return ((col(b)["x"] <= page_width * F.lit(0.08)) | (right(b) >= page_width * F.lit(0.92))).cast("double")


def margin_proximity(b, page_width) -> Column:
    centre = centre_x(b)
    edge = F.least(centre, page_width - centre)
    return unit(1.0 - edge / (page_width * F.lit(0.5)))


def unit(value) -> Column:
    """Clamp to [0, 1]; NULL stays NULL although greatest/least would skip it."""
    value = col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def crop_relative(b, crop) -> Column:
    b, crop = col(b), col(crop)
    return box(b["x"] - crop["x"], b["y"] - crop["y"], b["width"], b["height"])
