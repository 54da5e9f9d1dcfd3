"""Masks as boolean arrays, and what follows from them directly."""

from __future__ import annotations

import numpy as np


def background(img: np.ndarray, threshold: float = 2) -> np.ndarray:
    """True above the threshold."""
    return img > threshold


def percentile(img: np.ndarray, q: float) -> np.ndarray:
    """True above the raster's own percentile, so a constant raster has an empty mask."""
    return img > np.percentile(img, q)


def coverage(mask: np.ndarray) -> float:
    return float(mask.mean())


def centroid(mask: np.ndarray) -> tuple[float, float] | None:
    """Mean x and y of the mask's pixels; None for an empty one."""
    ys, xs = np.nonzero(mask)
    return (float(xs.mean()), float(ys.mean())) if len(xs) else None


def bounds(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1) of the mask's pixels, maxima inclusive; None for an empty one."""
    ys, xs = np.nonzero(mask)
    return (int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())) if len(xs) else None


def gray(bgr: np.ndarray) -> np.ndarray:
    """One channel from blue, green, red (and alpha) by the ITU-R 601 weights; a raster of one channel stays."""
    if bgr.ndim == 2 or bgr.shape[2] == 1:
        return bgr.reshape(bgr.shape[:2])
    return np.round(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299).astype(np.uint8)


def outlined(img: np.ndarray, boxes: list[tuple[int, int, int, int]], alpha: float = 1.0, colour: tuple[int, int, int] = (0, 255, 255)) -> np.ndarray:
    """The raster in three channels with a line of one pixel from (x, y) to (x + width, y + height) around each box, blended once where boxes cross.

    What lies outside the raster isn't drawn.
    """
    tall, wide = img.shape
    ys, xs = np.mgrid[:tall, :wide]
    on = np.zeros(img.shape, bool)
    for x, y, w, h in boxes:
        level, upright = np.isin(ys, (y, y + h)), np.isin(xs, (x, x + w))
        on |= (level & (xs >= x) & (xs <= x + w)) | (upright & (ys >= y) & (ys <= y + h))
    out = np.repeat(img[..., None], 3, axis=2).astype(float)
    out[on] = (1 - alpha) * out[on] + alpha * np.asarray(colour, float)
    return out.astype(np.uint8)
