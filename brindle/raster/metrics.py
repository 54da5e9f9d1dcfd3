"""Six measures of how alike a crop and a window are."""

from __future__ import annotations

import numpy as np

NAMES = ("near_exact_fraction", "mae", "rmse", "ssim", "pearson_corr", "hist_intersection")


def _box_sums(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over all k x k windows of each raster of a stack."""
    c = np.zeros((len(a), a.shape[1] + 1, a.shape[2] + 1))
    c[:, 1:, 1:] = a.cumsum(1).cumsum(2)
    return c[:, k:, k:] - c[:, :-k, k:] - c[:, k:, :-k] + c[:, :-k, :-k]


def ssim(a: np.ndarray, b: np.ndarray, size: int = 7) -> float:
    """Mean structural similarity over full windows, with sample covariance and the usual constants 0.01 and 0.03.

    The range is that of both rasters together, 1 if that is 0. Rasters smaller than a window use the largest odd one that fits.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    reach = max(a.max(), b.max()) - min(a.min(), b.min()) or 1.0
    size = min(size, *a.shape)
    size -= 1 - size % 2
    n = size * size
    ma, mb, maa, mbb, mab = _box_sums(np.stack([a, b, a * a, b * b, a * b]), size) / n
    norm = n / max(1, n - 1)
    va, vb, cov = norm * (maa - ma * ma), norm * (mbb - mb * mb), norm * (mab - ma * mb)
    c1, c2 = (0.01 * reach) ** 2, (0.03 * reach) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation from the moments. A constant side gives 1 if both are identical, else 0."""
    x, y = np.ravel(a).astype(float), np.ravel(b).astype(float)
    x, y = x - x.mean(), y - y.mean()
    power = np.dot(x, x) * np.dot(y, y)
    if power <= 0:
        return 1.0 if np.array_equal(np.ravel(a), np.ravel(b)) else 0.0
    return float(np.clip(np.dot(x, y) / np.sqrt(power), -1, 1))


def histogram_overlap(a: np.ndarray, b: np.ndarray, bins: int = 256) -> float:
    """The part of a's pixels whose bin b fills too; bins share the range of both."""
    both = np.concatenate([np.ravel(a), np.ravel(b)]).astype(float)
    low, reach = both.min(), np.ptp(both) or 1.0
    bin_ = np.minimum(((both - low) * (bins / reach)).astype(int), bins - 1)
    counts = [np.bincount(part, minlength=bins) for part in np.split(bin_, [np.size(a)])]
    return float(np.min(counts, axis=0).sum()) / np.size(a)


def differences(gap: np.ndarray, tolerance: int) -> dict[str, float]:
    """Share of pixels within the tolerance, mean and root mean square difference."""
    return dict(zip(NAMES, (float(np.count_nonzero(gap <= tolerance)) / gap.size, float(gap.sum()) / gap.size, float(np.linalg.norm(gap)) / gap.size**0.5)))


def compare(crop: np.ndarray, window: np.ndarray, mask: np.ndarray | None = None, tolerance: int = 2) -> dict[str, float]:
    """All six; with a mask five of them over its pixels, and SSIM over both rasters with the rest zeroed. An empty mask gives NaN."""
    pair = np.stack([crop, window]).astype(float)  # refuses rasters of different shapes
    lit = pair.reshape(2, -1) if mask is None else pair[:, np.asarray(mask, bool)]
    if not lit.shape[1]:
        return {name: float("nan") for name in NAMES}
    if mask is not None:
        pair = pair * np.asarray(mask, bool)
    out = differences(np.abs(lit[0] - lit[1]), tolerance)
    return out | {"ssim": ssim(*pair), "pearson_corr": pearson(*lit), "hist_intersection": histogram_overlap(*lit)}
