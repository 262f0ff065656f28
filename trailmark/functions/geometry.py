"""Box arithmetic. Boxes are structs ``(x1, y1, x2, y2)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.text import col

CORNERS = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def box_error(b: Column | str) -> Column:
    """Why a relative box is unusable, or null."""
    b = col(b)
    inside = F.lit(True)
    for name in CORNERS:
        inside = inside & b[name].between(0.0, 1.0)
    # fixed values: both messages
    return F.when(~F.coalesce(inside, F.lit(False)), F.lit("bbox_2d values must be between 0 and 1")).when(
        (b["x1"] >= b["x2"]) | (b["y1"] >= b["y2"]),
        F.lit("invalid bbox_2d: left >= right or top >= bottom"),
    )


def normalize_box(b: Column | str, width: Column | str, height: Column | str) -> Column:
    """Pixel box to shares of the image size, 4 decimals."""
    b, w, h = col(b), col(width), col(height)
    return box(F.round(b["x1"] / w, 4), F.round(b["y1"] / h, 4), F.round(b["x2"] / w, 4), F.round(b["y2"] / h, 4))


def pixel_box(b: Column | str, width: Column | str, height: Column | str) -> Column:
    """Relative box to whole pixels, cut down."""
    b, w, h = col(b), col(width), col(height)
    return box(
        (b["x1"] * w).cast("int"), (b["y1"] * h).cast("int"),
        (b["x2"] * w).cast("int"), (b["y2"] * h).cast("int"),
    )


def expand_box(b: Column | str, width: Column | str, height: Column | str, margin: float = 0.5) -> Column:
    """Grow a pixel box about its centre and clamp it to the image.

    A margin up to 1 is a share of the side, above 1 it is pixels.
    """
    b = col(b)

    def side(lo: Column, hi: Column, limit: Column) -> tuple[Column, Column]:
        span = hi - lo
        grown = span * (1 + margin) if margin <= 1.0 else span + margin
        centre = lo + span / 2
        low = F.greatest(F.lit(0.0), centre - grown / 2)
        high = F.least(limit.cast("double"), centre + grown / 2)
        return low.cast("int"), high.cast("int")

    x1, x2 = side(b["x1"], b["x2"], col(width))
    y1, y2 = side(b["y1"], b["y2"], col(height))
    return box(x1, y1, x2, y2)


def enlarge_box(b: Column | str, width: Column | str, height: Column | str, factor: float = 1.5) -> Column:
    """Grow a whole-pixel box by ``factor``, clamped to the image."""
    b = col(b)
    dx = ((factor - 1) * (b["x2"] - b["x1"]) / 2).cast("int")
    dy = ((factor - 1) * (b["y2"] - b["y1"]) / 2).cast("int")
    return box(
        F.greatest(F.lit(0), b["x1"] - dx), F.greatest(F.lit(0), b["y1"] - dy),
        F.least(col(width), b["x2"] + dx), F.least(col(height), b["y2"] + dy),
    )
