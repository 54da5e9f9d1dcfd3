"""Locating a crop in an image by (masked) zero-mean normalised cross-correlation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Products of deviations below this part of the possible energy are rounding, not signal.
TINY = 1e-9


@dataclass
class Field:
    """An image ready for many searches: its transforms are made once for each size and reused by every crop."""

    image: np.ndarray

    def __post_init__(self) -> None:
        self.image = np.asarray(self.image, float)
        self._made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, tuple[int, int]]] = {}

    def transforms(self, rows: slice) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        part = self.image[rows]
        key = (rows.start or 0, part.shape[0])
        if key not in self._made:
            shape = tuple(_fast(n) for n in part.shape)
            self._made[key] = (np.fft.rfft2(part, shape), np.fft.rfft2(part * part, shape), shape)
        return self._made[key]


def _fast(n: int) -> int:
    """The next size of small prime factors."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def surface(field: Field, crop: np.ndarray, mask: np.ndarray | None = None, rows: slice = slice(None)) -> np.ndarray:
    """Scores for every position; -inf where the window or the crop has no variance under the mask."""
    crop = np.asarray(crop, float)
    m = np.ones(crop.shape) if mask is None else np.asarray(mask, float)
    part = field.image[rows]
    h, w = crop.shape
    out_shape = (part.shape[0] - h + 1, part.shape[1] - w + 1)
    if min(out_shape) <= 0:
        raise ValueError("the crop is larger than the image")
    n = m.sum()
    if n == 0:
        return np.full(out_shape, -np.inf)
    fi, fi2, shape = field.transforms(rows)
    t = m * (crop - (crop * m).sum() / n)
    fm, ft = np.conj(np.fft.rfft2(np.stack([m, t]), shape))
    # t sums to zero under the mask, so the window's mean drops out of the cross term
    s1, s2, cross = np.fft.irfft2(np.stack([fi * fm, fi2 * fm, fi * ft]), shape)[:, : out_shape[0], : out_shape[1]]
    spread = s2 - s1 * s1 / n
    energy = (t * t).sum()
    least = TINY * max(1.0, float((part * part).max()) * n)
    ok = (spread > least) & (energy > TINY)
    out = np.full(out_shape, -np.inf)
    out[ok] = cross[ok] / np.sqrt(spread[ok] * energy)
    return out


def peak(scores: np.ndarray) -> tuple[int, int, float]:
    """(x, y, score) of the first maximum in row-major order; ties within rounding count as ties."""
    k = int(np.argmax(np.round(scores, 9)))
    y, x = divmod(k, scores.shape[1])
    return x, y, float(scores[y, x])


def rival(scores: np.ndarray, x: int, y: int, w: int, h: int) -> float:
    """The best score outside the peak's own footprint, from the four strips around it; NaN if none of them has a finite one."""
    above, under = scores[: max(0, y - h // 2)], scores[y + h // 2 + 1 :]
    beside = scores[max(0, y - h // 2) : y + h // 2 + 1]
    strips = (above, under, beside[:, : max(0, x - w // 2)], beside[:, x + w // 2 + 1 :])
    best = max((float(s.max()) for s in strips if s.size), default=-np.inf)
    return best if np.isfinite(best) else float("nan")


def locate(field: Field, crop: np.ndarray, mask: np.ndarray | None = None, top: int = 0, bottom: int | None = None) -> dict:
    """Position, score and margin over the rival, with a status: ok, or blank where nothing could be scored."""
    scores = surface(field, crop, mask, slice(top, bottom))
    x, y, score = peak(scores)
    h, w = crop.shape
    blank = not np.isfinite(score)
    margin = float("nan") if blank else score - rival(scores, x, y, w, h)
    return {"x": x, "y": y + top, "width": w, "height": h, "match_score": score, "peak_margin": margin, "status": "blank" if blank else "ok"}
