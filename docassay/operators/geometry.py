"""Boxes: normalisation, parts of a box by character positions, validity and placement on a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page size that stands in for a missing one, in points.
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
#: Smallest edge of a drawn mark, in points.
LEAST_MARK = 20.0
_SIDES = ("x0", "y0", "x1", "y1")


def normalized(box: Column) -> Column:
    """A box with coordinates at least 0 and page sizes; null becomes the empty box of a default page."""
    side = lambda s: F.greatest(F.lit(0.0), F.coalesce(box[s], F.lit(0.0))).alias(s)
    size = lambda s, d: F.when(box[s] > 0, box[s]).otherwise(F.lit(d)).alias(s)
    return F.struct(F.coalesce(F.greatest(F.lit(0), box["page_index"]), F.lit(0)).alias("page_index"), *[side(s) for s in _SIDES], size("page_width", PAGE_WIDTH), size("page_height", PAGE_HEIGHT))


def part(box: Column, length: Column, start: Column, end: Column) -> Column:
    """The part of a line's box between two character positions, by linear interpolation; one decimal."""
    width = (box["x1"] - box["x0"]) / F.greatest(length, F.lit(1))
    return F.struct(
        box["page_index"].alias("page_index"), F.bround(box["x0"] + width * start, 1).alias("x0"), box["y0"].alias("y0"),
        F.bround(box["x0"] + width * end, 1).alias("x1"), box["y1"].alias("y1"), box["page_width"].alias("page_width"), box["page_height"].alias("page_height"),
    )


def valid(box: Column) -> Column:
    """True for a box that lies on its page with whole coordinates in order."""
    i = {s: F.floor(box[s]) for s in _SIDES}
    return (i["x0"] >= 0) & (i["x0"] <= i["x1"]) & (i["x1"] <= F.floor(box["page_width"])) & (i["y0"] >= 0) & (i["y0"] <= i["y1"]) & (i["y1"] <= F.floor(box["page_height"]))


def placed(box: Column, media_width: Column, media_height: Column, pages: Column) -> Column:
    """The mark of a box in the media box of a page: scaled, with y upwards, clamped, of a least size."""
    sx, sy = media_width / box["page_width"], media_height / box["page_height"]
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    x0, x1 = clamp(box["x0"] * sx, media_width), clamp(box["x1"] * sx, media_width)
    y0, y1 = clamp(media_height - box["y1"] * sy, media_height), clamp(media_height - box["y0"] * sy, media_height)
    return F.struct(
        F.greatest(F.lit(0), F.least(box["page_index"], pages - 1)).alias("page_index"), x0.alias("x0"), y0.alias("y0"),
        F.greatest(x1, x0 + LEAST_MARK).alias("x1"), F.greatest(y1, y0 + LEAST_MARK).alias("y1"),
    )
