import numpy as np
import pytest

from brindle.raster import mask, metrics, ncc, shape


def slow_metrics(a, b, tolerance=2):
    """The six measures pixel by pixel, from their definitions."""
    n = a.size
    x, y = [float(v) for v in a.ravel()], [float(v) for v in b.ravel()]
    gaps = [abs(p - q) for p, q in zip(x, y)]
    mx, my = sum(x) / n, sum(y) / n
    sxy = sum((p - mx) * (q - my) for p, q in zip(x, y))
    sx, sy = sum((p - mx) ** 2 for p in x), sum((q - my) ** 2 for q in y)
    low, high = min(x + y), max(x + y)
    edges = np.linspace(low, high if high > low else low + 1, 257)
    hx, hy = np.histogram(x, edges)[0], np.histogram(y, edges)[0]
    windows = []
    reach = high - low or 1
    for r in range(a.shape[0] - 6):
        for c in range(a.shape[1] - 6):
            p, q = a[r : r + 7, c : c + 7].astype(float).ravel(), b[r : r + 7, c : c + 7].astype(float).ravel()
            cov = np.cov(p, q)
            c1, c2 = (0.01 * reach) ** 2, (0.03 * reach) ** 2
            top = (2 * p.mean() * q.mean() + c1) * (2 * cov[0, 1] + c2)
            windows.append(top / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    pearson = sxy / (sx * sy) ** 0.5 if sx * sy else float(x == y)
    return [sum(g <= tolerance for g in gaps) / n, sum(gaps) / n, (sum(g * g for g in gaps) / n) ** 0.5, float(np.mean(windows)), pearson, float(np.minimum(hx, hy).sum() / n)]


def pairs():
    rng = np.random.default_rng(11)
    ramp = np.add.outer(np.arange(17), 3 * np.arange(23)).astype(np.uint8)
    yield ramp, ramp
    yield ramp, rng.permutation(ramp.ravel()).reshape(ramp.shape)
    yield ramp, np.full_like(ramp, 9)
    yield np.full_like(ramp, 4), np.full_like(ramp, 4)
    yield rng.poisson(30, (12, 9)), rng.poisson(31, (12, 9))


@pytest.mark.parametrize("k", range(5))
def test_metrics_match_their_definitions(k):
    a, b = list(pairs())[k]
    assert list(metrics.compare(a, b).values()) == pytest.approx(slow_metrics(a, b), abs=1e-9)


def test_metrics_under_a_mask_see_its_pixels_alone():
    rng = np.random.default_rng(12)
    a = rng.integers(1, 255, (18, 14))
    keep = np.tri(18, 14, 3, bool)
    b = np.where(keep, a + rng.integers(-1, 2, a.shape), 255 - a)
    got = metrics.compare(a, b, keep)
    lit = slow_metrics(np.resize(a[keep], (7, keep.sum() // 7)), np.resize(b[keep], (7, keep.sum() // 7)))
    whole = slow_metrics(np.where(keep, a, 0), np.where(keep, b, 0))
    assert got["near_exact_fraction"] == 1 and got["ssim"] == pytest.approx(whole[3]) and got["mae"] == pytest.approx(np.abs(a - b)[keep].mean())
    assert got["pearson_corr"] == pytest.approx(lit[4], abs=0.02) and got["hist_intersection"] == pytest.approx(lit[5], abs=0.05)
    assert all(np.isnan(v) for v in metrics.compare(a, b, np.zeros_like(keep)).values())
    with pytest.raises(ValueError):
        metrics.compare(a, b[1:])


def test_the_rival_lies_outside_the_footprint():
    rng = np.random.default_rng(13)
    for _ in range(50):
        s = rng.random((9, 11))
        x, y, w, h = rng.integers(11), rng.integers(9), rng.integers(1, 12), rng.integers(1, 10)
        outside = [s[r, c] for r in range(9) for c in range(11) if abs(r - y) > h // 2 or abs(c - x) > w // 2]
        got = ncc.rival(s, int(x), int(y), int(w), int(h))
        assert got == max(outside) if outside else np.isnan(got)


def slow_surface(image, crop, m):
    h, w = crop.shape
    out = np.full((image.shape[0] - h + 1, image.shape[1] - w + 1), -np.inf)
    n = m.sum()
    t = m * (crop - (crop * m).sum() / n)
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            win = image[y : y + h, x : x + w]
            i = m * (win - (win * m).sum() / n)
            d = (t * t).sum() * (i * i).sum()
            if d > 1e-9:
                out[y, x] = (t * i).sum() / np.sqrt(d)
    return out


def test_surface_matches_the_definition():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 255, (30, 24)).astype(float)
    crop = rng.integers(0, 255, (7, 6)).astype(float)
    for m in (np.ones(crop.shape), (crop > 100).astype(float)):
        got = ncc.surface(ncc.Field(image), crop, m)
        assert np.allclose(got, slow_surface(image, crop, m), atol=1e-9)


def test_planted_crops_are_found():
    rng = np.random.default_rng(3)
    image = rng.poisson(20, (256, 128))
    field = ncc.Field(image)
    for y, x in ((0, 0), (100, 57), (216, 98)):
        m = ncc.locate(field, image[y : y + 40, x : x + 30])
        assert (m["x"], m["y"]) == (x, y) and m["match_score"] > 0.999 and m["peak_margin"] > 0.3
    band = ncc.locate(field, image[100:140, 57:87], None, 80, 200)
    assert (band["x"], band["y"]) == (57, 100)
    wedge = image[100:140, 57:87].copy()
    wedge[:15] = 0
    assert ncc.locate(field, wedge, mask.background(wedge))["match_score"] > 0.999


def test_blanks_and_ties():
    image = np.zeros((20, 20))
    image[2:5, 2:5] = image[12:15, 12:15] = np.arange(9).reshape(3, 3)
    m = ncc.locate(ncc.Field(image), np.arange(9).reshape(3, 3))
    assert (m["x"], m["y"]) == (2, 2) and abs(m["peak_margin"]) < 1e-9
    for crop, im in ((np.zeros((3, 3)), image), (np.arange(9).reshape(3, 3), np.zeros((9, 9)))):
        blank = ncc.locate(ncc.Field(im), crop, mask.background(crop))
        assert blank["status"] == "blank" and np.isnan(blank["peak_margin"])
    assert not mask.percentile(np.full((4, 4), 7), 50).any()


def slow_components(m):
    out = np.zeros(m.shape, int)
    n = 0
    for y, x in zip(*np.nonzero(m)):
        if not out[y, x]:
            n += 1
            stack = [(y, x)]
            out[y, x] = n
            while stack:
                a, b = stack.pop()
                for c in range(max(0, a - 1), min(m.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(m.shape[1], b + 2)):
                        if m[c, d] and not out[c, d]:
                            out[c, d] = n
                            stack.append((c, d))
    return out


def test_components_distance_and_closing():
    rng = np.random.default_rng(4)
    for p in (0.1, 0.4, 0.6, 0.9):
        m = rng.random((23, 31)) < p
        labels = shape.components(m)
        assert (labels == slow_components(m)).all()
        ys, xs = np.nonzero(m)
        gy, gx = np.mgrid[0:23, 0:31]
        want = np.sqrt(((gy[..., None] - ys) ** 2 + (gx[..., None] - xs) ** 2).min(-1))
        assert np.allclose(shape.distance_to(m), want)
        assert (shape.closed(m, 3) | ~m).all()
    assert shape.components(np.zeros((3, 3), bool)).max() == 0 and np.isinf(shape.distance_to(np.zeros((3, 3), bool))).all()
    gap = np.zeros((9, 9), bool)
    gap[4, [2, 4]] = True
    assert shape.closed(gap, 3)[4, 3] and not shape.closed(gap, 1)[4, 3]


def test_filters_keep_the_blob():
    img = np.zeros((60, 60), np.uint8)
    img[20:40, 25:35] = 50
    img[2, 2] = img[41, 36] = 90
    labels = shape.components(mask.background(img))
    assert shape.at_least(labels, 5).sum() == 200 and shape.near_main(labels, 3).sum() == 201
    box = shape.body_box(img)
    assert (box["x"], box["y"], box["width"], box["height"], box["largest_cc_aspect_ratio"], box["fallback"]) == (0, 0, 41, 46, 2.0, False)
    blank = shape.body_box(np.zeros((10, 8), np.uint8))
    assert blank["fallback"] and (blank["width"], blank["height"], blank["largest_cc_aspect_ratio"]) == (7, 9, 0)


def test_warp_and_hash():
    rng = np.random.default_rng(5)
    img = rng.integers(0, 255, (32, 32)).astype(np.uint8)
    assert (shape.warped(img, 0, 1) == img).all()
    grown = shape.warped(np.pad(np.full((8, 8), 200, np.uint8), 12), 0, 1.5, nearest=True)
    assert (grown > 0).sum() > 100
    smooth = np.add.outer(np.arange(64), np.arange(64) ** 1.3).astype(np.uint8)
    h = shape.perceptual_hash(smooth)
    assert (h ^ shape.perceptual_hash(np.clip(smooth.astype(int) + 2, 0, 255).astype(np.uint8))).bit_count() <= 10
    assert shape.perceptual_hash(img).bit_count() == 32


def test_a_sweep_measures_a_place_once_over_all_pixels(monkeypatch):
    from brindle.plans import workflows as W

    calls = []
    compare = metrics.compare
    monkeypatch.setattr(metrics, "compare", lambda *a: calls.append(len(a)) or compare(*a))
    image = np.random.default_rng(3).integers(0, 255, (32, 32)).astype(np.uint8)
    crop, seen = image[8:24, 12:28], {}
    found = [W._scored(ncc.Field(image), crop, crop > v, "c", 1, seen=seen) for v in (80, 100)]
    assert sorted(calls) == [2, 3, 3] and found[0]["ssim"] == found[1]["ssim"] == 1


def test_window_sums_of_a_stack_are_those_of_each_raster():
    a = np.random.default_rng(4).integers(0, 255, (5, 12, 9)).astype(float)
    slow = [[[x[i : i + 7, j : j + 7].sum() for j in range(3)] for i in range(6)] for x in a]
    assert np.array_equal(metrics._box_sums(a, 7), slow)
