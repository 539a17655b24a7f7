"""Rectangle arithmetic on ``struct<page,x1,y1,x2,y2>`` parts given as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def box_normalize(b: Column | str, width: Column | str, height: Column | str) -> Column:
    """Absolute to page-relative coordinates."""
    b, w, h = col(b), col(width), col(height)
    return _box(b["x1"] / w, b["y1"] / h, b["x2"] / w, b["y2"] / h)


def box_denormalize(b: Column | str, width: Column | str, height: Column | str) -> Column:
    b, w, h = col(b), col(width), col(height)
    return _box(b["x1"] * w, b["y1"] * h, b["x2"] * w, b["y2"] * h)


def box_order(b: Column | str) -> Column:
    """Corners in ascending order."""
    b = col(b)
    return _box(
        F.least(b["x1"], b["x2"]), F.least(b["y1"], b["y2"]), F.greatest(b["x1"], b["x2"]), F.greatest(b["y1"], b["y2"])
    )


def box_pad(b: Column | str, pad_x, pad_y, width: Column | str, height: Column | str) -> Column:
    """Padding clamped to the page."""
    b, w, h = col(b), col(width), col(height)
    px, py = (F.lit(p) if not isinstance(p, Column) else p for p in (pad_x, pad_y))
    zero = F.lit(0.0)
    return _box(
        F.greatest(zero, b["x1"] - px),
        F.greatest(zero, b["y1"] - py),
        F.least(w.cast("double"), b["x2"] + px),
        F.least(h.cast("double"), b["y2"] + py),
    )


def box_valid(b: Column | str) -> Column:
    b = col(b)
    return (b["x1"] < b["x2"]) & (b["y1"] < b["y2"])
