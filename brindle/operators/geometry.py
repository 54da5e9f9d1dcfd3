"""Boxes as column expressions: x and y of the top left corner, width and height; half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names: tuple[str, str, str, str] = ("x", "y", "width", "height")) -> Box:
    return tuple(F.col(prefix + n) for n in names)  # type: ignore[return-value]


def overlap(a: Box, b: Box) -> Column:
    """Shared area; 0 where the boxes are apart or only touch."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    shared = overlap(a, b)
    union = a[2] * a[3] + b[2] * b[3] - shared
    return F.coalesce(F.try_divide(shared.cast("double"), union.cast("double")), F.lit(0.0))


def displacement(a: Box, b: Box) -> tuple[Column, Column]:
    return a[0] - b[0], a[1] - b[1]


def centre(b: Box) -> tuple[Column, Column]:
    return b[0] + b[2] / 2, b[1] + b[3] / 2


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...]) -> Column:
    """Both as (x0, y0, x1, y1); shared edges count as inside."""
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def box_union(df: DataFrame, key: str, b: Box | None = None) -> DataFrame:
    """Smallest box (x0, y0, x1, y1) around all boxes of each key; rows without a key are dropped."""
    b = b or box()
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(b[0]).alias("x0"), F.min(b[1]).alias("y0"), F.max(b[0] + b[2]).alias("x1"), F.max(b[1] + b[3]).alias("y1")
    )


def band(y: Column, height: Column, above: int = 100, below: int = 250) -> tuple[Column, Column]:
    """Rows of the image to search, around an anchor at y."""
    return F.greatest(y - above, F.lit(0)), F.least(y + below, height)


def band_fits(top: Column, bottom: Column, crop_height: Column) -> Column:
    return bottom - top >= crop_height


def padded(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, pad: int = 5) -> tuple[Column, ...]:
    """A box grown by pad on each side, within the canvas; the maxima are inclusive."""
    return F.greatest(x0 - pad, F.lit(0)), F.greatest(y0 - pad, F.lit(0)), F.least(x1 + pad, width - 1), F.least(y1 + pad, height - 1)


def features(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    """The geometric part of the whole-body feature vector, from a box with inclusive maxima."""
    w, h = x1 - x0, y1 - y0
    return {
        "aspect_ratio": F.try_divide(w.cast("double"), h.cast("double")),
        "center_x_offset": x0 + w / 2 - width / 2,
        "top_margin_frac": F.try_divide(y0.cast("double"), height.cast("double")),
        "bottom_margin_frac": F.try_divide((height - y1).cast("double"), height.cast("double")),
        "width_frac": F.try_divide(w.cast("double"), width.cast("double")),
        "height_frac": F.try_divide(h.cast("double"), height.cast("double")),
    }


def ratios(h: Column, w: Column, whole_h: Column, whole_w: Column) -> dict[str, Column]:
    """Sizes relative to the whole; null where a side of the whole is 0."""
    h, w, whole_h, whole_w = (c.cast("double") for c in (h, w, whole_h, whole_w))
    return {
        "height_ratio": F.try_divide(h, whole_h),
        "width_ratio": F.try_divide(w, whole_w),
        "area_ratio": F.try_divide(h * w, whole_h * whole_w),
    }
