"""Kernel queries against slow direct versions, row by row."""

import numpy as np
import pytest

from brindle.plans import catalog
from brindle.plans.kernels import CUT
from tests.test_raster import slow_components, slow_metrics, slow_surface

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def images(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    out = {}
    for r in rows:
        a = np.zeros((32, 32), np.uint8)
        for y in range(32):
            for x in range(32):
                a[y, x] = min(255, max(0, int((r.embedding[y // 4 * 8 + x // 4] + 1) * 100 + 0.5)))
        out[r.vec_id] = (a, r.label)
    return out


def rows_of(spark, name, *keys):
    rows = catalog.QUERIES[name](spark, SF).collect()
    out = {tuple(r[k] for k in keys): r for r in rows}
    assert len(out) == len(rows)
    return out


def test_pixel_stats_and_centroids(spark, images):
    stats, centres = rows_of(spark, "raster_pixel_stats", "id"), rows_of(spark, "raster_centroids", "id")
    assert len(stats) == len(images)
    for i, (a, _) in images.items():
        r, v = stats[i,], sorted(a.ravel().tolist())
        assert (r.area, r.pixel_min, r.pixel_max, r.pixel_median) == (1024, v[0], v[-1], (v[511] + v[512]) / 2)
        mean = sum(v) / 1024
        assert r.pixel_mean == pytest.approx(mean) and r.pixel_std == pytest.approx((sum((x - mean) ** 2 for x in v) / 1024) ** 0.5)
        lit = [(x, y) for y in range(32) for x in range(32) if a[y, x] > 110]
        assert ((i,) in centres) == bool(lit)
        if lit:
            assert (centres[i,].centroid_x, centres[i,].centroid_y) == pytest.approx(tuple(np.mean(lit, 0)))


def test_crops_are_located_as_by_direct_search(spark, images):
    got = rows_of(spark, "locate_crops", "id")
    assert len(got) == len(images)
    for i in sorted(images)[::12]:
        a = images[i][0]
        crop = a[CUT]
        mask = crop > 90
        r = got[i,]
        if not mask.any():
            assert r.status == "blank"
            continue
        s = slow_surface(a.astype(float), crop.astype(float), mask.astype(float))
        if not np.isfinite(s.max()):
            assert r.status == "blank"
            continue
        assert r.match_score == pytest.approx(s.max(), abs=1e-6) and s[r.y, r.x] == pytest.approx(s.max(), abs=1e-6)
        window = a[r.y : r.y + 16, r.x : r.x + 16]
        want = slow_metrics(crop, window)
        assert [r.near_exact_fraction, r.mae, r.rmse, r.ssim, r.pearson_corr, r.hist_intersection] == pytest.approx(want, abs=1e-6)


def test_sweep_masks(spark, images):
    got = rows_of(spark, "mask_threshold_sweep", "id", "setting", "value")
    assert len(got) == 4 * len(images)
    for (i, setting, value), r in got.items():
        crop = images[i][0][CUT]
        bar = value if setting == "threshold" else np.percentile(crop, value)
        assert r.background_fraction == pytest.approx(sum(int(v) <= bar for v in crop.ravel()) / 256)


def test_turned_crops_score_no_less_than_unturned(spark, images):
    got = rows_of(spark, "rotation_scale_best", "id")
    for i in sorted(images)[::40]:
        a = images[i][0]
        crop = a[CUT]
        s = slow_surface(a.astype(float), crop.astype(float), (crop > 2).astype(float))
        assert got[i,].match_score >= s.max() - 1e-6 and got[i,].angle in (-5, 0, 5)


def slow_hash(a):
    """32 x 32 rasters need no resizing: cosine sums by definition, the lowest 8 x 8 against their median."""
    n = np.arange(32)
    c = np.array([[np.cos(np.pi * k * (2 * m + 1) / 64) for m in n] for k in range(8)])
    low = np.array([[sum(c[u] * (a @ c[v])) for v in range(8)] for u in range(8)])
    bits = (low > np.median(low)).ravel()
    h = int("".join("01"[int(b)] for b in bits), 2)
    return h - (1 << 64) if h >> 63 else h


def test_hashes_and_near_duplicates(spark, images):
    got = rows_of(spark, "perceptual_hashes", "id", "label")
    want = {(i, label): slow_hash(a.astype(float)) for i, (a, label) in images.items()}
    same = sum((got[k].phash ^ h) & (2**64 - 1) == 0 for k, h in want.items())
    assert set(got) == set(want) and same >= 0.99 * len(want)  # a coefficient may equal the median but for rounding
    bright = {k: slow_hash(np.minimum(255, images[k[0]][0].astype(float) + 3)) for k in want}
    pairs = {(r.l_id, r.r_id) for r in catalog.QUERIES["perceptual_near_duplicates"](spark, SF).collect()}
    slow = {(i, j) for (i, x), h in want.items() for (j, y), g in bright.items() if x == y and ((h ^ g) & (2**64 - 1)).bit_count() <= 4}
    assert len(pairs ^ slow) <= 0.02 * len(slow) + 2


def test_cleaned_boxes(spark, images):
    got = rows_of(spark, "mask_cleanup_sweep", "id", "step", "value")
    for i in sorted(images)[::25]:
        labels = slow_components(images[i][0] > 2)
        sizes = {k: int((labels == k).sum()) for k in range(1, labels.max() + 1)}
        for least in (20, 100):
            keep = np.isin(labels, [k for k, n in sizes.items() if n >= least])
            r = got.get((i, "area", float(least)))
            assert (r is not None) == bool(keep.any())
            if r:
                ys, xs = np.nonzero(keep)
                assert (r.x0, r.y0, r.x1, r.y1) == (xs.min(), ys.min(), xs.max(), ys.max()) and r.kept == pytest.approx(keep.mean())


def test_whole_bodies(spark, images):
    got = rows_of(spark, "whole_body_boxes", "id", "view")
    assert len(got) == len(images)
    for i, (a, label) in images.items():
        r = got[i, "ANT" if label < 5 else "POST"]
        lit = [(x, y) for y in range(32) for x in range(32) if a[y, x] > 110]
        assert r.fallback == (not lit) and r.source == ("b" if label == 9 else "a")
        box = (0, 0, 31, 31)
        if lit:
            (x0, y0), (x1, y1) = np.min(lit, 0), np.max(lit, 0)
            box = (max(0, x0 - 5), max(0, y0 - 5), min(31, x1 + 5), min(31, y1 + 5))
        assert (r.x, r.y, r.width, r.height) == (box[0], box[1], box[2] - box[0], box[3] - box[1])
        assert r.coverage == pytest.approx(len(lit) / 1024) and r.has_region_crops == (label in (0, 3, 6))
