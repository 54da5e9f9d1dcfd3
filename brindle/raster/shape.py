"""Connected components, closing, distances, warping and the perceptual hash."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from brindle.raster import mask as masks


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 in row-major order of first pixels, 8-connected; 0 is background.

    Runs of each row are joined to overlapping runs of the row above with a union of labels.
    """
    mask = np.asarray(mask, bool)
    h, w = mask.shape
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    for r in range(1, h):
        i, j = int(first[r - 1]), int(first[r])
        while i < first[r] and j < first[r + 1]:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:  # a diagonal touches too
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), np.int32)
    number: dict[int, int] = {}
    for k in range(len(rows)):
        out[rows[k], starts[k] : ends[k]] = number.setdefault(find(k), len(number) + 1)
    return out


def areas(labels: np.ndarray) -> np.ndarray:
    """Pixels of each label; index 0 is the background."""
    return np.bincount(labels.ravel())


def largest(labels: np.ndarray) -> int:
    """The label with most pixels, the first of several; 0 if there is none."""
    n = areas(labels)
    return 1 + int(np.argmax(n[1:])) if len(n) > 1 else 0


def at_least(labels: np.ndarray, area: int) -> np.ndarray:
    keep = areas(labels) >= area
    keep[0] = False
    return keep[labels]


def _slide(a: np.ndarray, k: int, op, fill) -> np.ndarray:
    before, after = k // 2, k - 1 - k // 2
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before, after)
        a = op(np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=fill), k, axis), axis=-1)
    return a


def closed(mask: np.ndarray, k: int) -> np.ndarray:
    """Dilation, then erosion, by a k by k square; nothing outside the raster counts."""
    return _slide(_slide(np.asarray(mask, bool), k, np.max, False), k, np.min, True)


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of every pixel to the nearest mask pixel; inf if there is none."""
    mask = np.asarray(mask, bool)
    h, w = mask.shape
    up = np.full((h, w), np.inf)
    run = np.full(w, np.inf)
    for y in range(h):
        run = np.where(mask[y], 0, run + 1)
        up[y] = run
    run = np.full(w, np.inf)
    for y in range(h - 1, -1, -1):
        run = np.where(mask[y], 0, run + 1)
        up[y] = np.minimum(up[y], run)
    gap = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    out = np.empty((h, w))
    for y in range(h):
        out[y] = np.sqrt((up[y][None, :] ** 2 + gap).min(1))
    return out


def near_main(labels: np.ndarray, most: float, distance: np.ndarray | None = None) -> np.ndarray:
    """The largest component and those that come within `most` of it."""
    main = largest(labels)
    if not main:
        return np.zeros(labels.shape, bool)
    d = distance_to(labels == main) if distance is None else distance
    least = np.full(labels.max() + 1, np.inf)
    np.minimum.at(least, labels.ravel(), d.ravel())
    keep = least <= most
    keep[main], keep[0] = True, False
    return keep[labels]


def warped(img: np.ndarray, angle: float, scale: float, nearest: bool = False) -> np.ndarray:
    """Turned counter-clockwise by degrees and scaled about the centre (w / 2, h / 2); outside is 0."""
    h, w = img.shape
    a, b = scale * np.cos(np.radians(angle)), scale * np.sin(np.radians(angle))
    cx, cy = w / 2, h / 2
    forward = np.array([[a, b, (1 - a) * cx - b * cy], [-b, a, b * cx + (1 - a) * cy], [0, 0, 1]])
    inv = np.linalg.inv(forward)
    y, x = np.mgrid[0:h, 0:w]
    sx, sy = inv[0, 0] * x + inv[0, 1] * y + inv[0, 2], inv[1, 0] * x + inv[1, 1] * y + inv[1, 2]
    padded = np.pad(np.asarray(img, float), 1)

    def at(iy: np.ndarray, ix: np.ndarray) -> np.ndarray:
        return padded[np.clip(iy + 1, 0, h + 1), np.clip(ix + 1, 0, w + 1)]

    if nearest:
        out = at(np.round(sy).astype(int), np.round(sx).astype(int))
    else:
        y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
        fy, fx = sy - y0, sx - x0
        out = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
        out = np.round(out) if np.issubdtype(img.dtype, np.integer) else out
    return out.astype(img.dtype)


@lru_cache(8)
def _resizer(n: int, m: int) -> np.ndarray:
    """Rows of weights that take n samples to m with a triangle as wide as the scale."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m
    weight = np.maximum(0, 1 - np.abs((np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale))
    return weight / weight.sum(1, keepdims=True)


@lru_cache(2)
def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def perceptual_hash(img: np.ndarray, side: int = 8, factor: int = 4) -> int:
    """Bits of the lowest side by side cosine coefficients that exceed their median, row by row, the first the highest; unsigned."""
    n = side * factor
    small = _resizer(img.shape[0], n) @ np.asarray(img, float) @ _resizer(img.shape[1], n).T
    c = _cosines(n)
    low = (c @ small @ c.T)[:side, :side]
    bits = low > np.median(low)
    return int("".join("1" if b else "0" for b in bits.ravel()), 2)


def main_aspect(mask: np.ndarray) -> float:
    """Height over width of the largest component; 0 without one."""
    labels = components(mask)
    box = masks.bounds(labels == largest(labels)) if labels.any() else None
    return (box[3] - box[1] + 1) / (box[2] - box[0] + 1) if box else 0.0


def body_box(img: np.ndarray, pad: int = 5, threshold: float = 2) -> dict:
    """The box of all that is above the threshold, padded within the canvas, its coverage and the aspect of the largest component; a blank canvas falls back to all of it.

    Sizes are differences of the box's corners, which are inclusive.
    """
    mask = masks.background(img, threshold)
    lit = masks.bounds(mask)
    rows, columns = img.shape[:2]
    x0, y0, x1, y1 = lit or (0, 0, columns - 1, rows - 1)
    x, y = max(x0 - pad, 0), max(y0 - pad, 0)
    size = {"x": x, "y": y, "width": min(x1 + pad, columns - 1) - x, "height": min(y1 + pad, rows - 1) - y}
    return size | {"coverage": masks.coverage(mask), "fallback": lit is None, "largest_cc_aspect_ratio": main_aspect(mask)}
