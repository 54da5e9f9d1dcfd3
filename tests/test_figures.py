"""Figures: decoded pixels against bins, boxes against five numbers, sheets pixel by pixel, files once written."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import profile
from brindle.plans import catalog, figures, workflows
from brindle.plans.kernels import CUT, picture
from brindle.raster import png

SF = "/root/testdata/sf0.001"


def test_pixels_are_bins(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(x), float(y), bool(f)) for x, y, f in zip(rng.normal(size=500), rng.normal(size=500), rng.random(500) < 0.02)] + [("a/b c", 1.0, 2.0, None), ("a/b c", 1.0, 5.0, True)]
    rows += [("a", None, 1.0, True), ("a", float("nan"), 1.0, True), ("a", 1.0, float("inf"), True), (None, 0.0, 0.0, True)]
    df = spark.createDataFrame(rows, "p string, x double, y double, f boolean")
    bins = figures.pixel_bins(df, "p", F.col("x"), F.col("y"), F.col("f"), 40, 30)
    got = {(r.panel, r.px, r.py): (r.n, r.flagged) for r in bins.collect()}
    want = {}
    for name in ("a", "a/b c"):
        fine = [r for r in rows if r[0] == name and r[1] is not None and np.isfinite(r[1]) and np.isfinite(r[2])]
        ends = [(min(r[k] for r in fine), max(r[k] for r in fine)) for k in (1, 2)]
        for r in fine:
            at = tuple(size // 2 if lo == hi else min(size - 1, int((v - lo) / (hi - lo) * size)) for v, (lo, hi), size in zip(r[1:3], ends, (40, 30)))
            n, f = want.get((name, *at), (0, 0))
            want[(name, *at)] = (n + 1, f + bool(r[3]))
    assert got == want
    for r in figures.scatters(bins, 40, 30).collect():
        a = png.decoded(bytes(r.content))
        assert a.shape == (30, 40, 3)
        for py in range(30):
            for px in range(40):
                n, f = want.get((r.panel, px, py), (0, 0))
                assert (tuple(a[py, px]) == figures.MARK) == (f > 0) and (tuple(a[py, px]) == figures.PAPER) == (n == 0)


def test_boxes(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in {"a": range(100), "b": [5] * 4, "c": [*range(50), 1000]}.items() for v in vs] + [("d", None)], "g string, v double")
    five = profile.five_numbers(df, "g", "v").withColumn("panel", F.lit("height"))
    a = png.decoded(bytes(figures.box_plots(five, "panel", "g", 100).first().content))
    assert a.shape == (100, 3 * figures.STEP, 3)
    numbers = {r.g: r for r in five.collect()}
    level = lambda v: min(99, int((99 - v) / 99 * 100))
    for k, g in enumerate("abc"):
        column = a[:, figures.STEP * k + 6]
        marked = np.flatnonzero((column == figures.MARK).all(1))
        assert marked.tolist() == [level(numbers[g].median)]
        lines = np.flatnonzero((column == figures.LINE).all(1)).tolist()
        assert set(lines) == {level(numbers[g].q1), level(numbers[g].q3)} - set(marked.tolist())
    many = spark.range(figures.BOXES + 1).select(F.lit("p").alias("p"), "id", *[F.lit(1.0).alias(c) for c in ("low", "q1", "median", "q3", "high")])
    with pytest.raises(Exception, match="boxes"):
        figures.box_plots(many, "p", "id").collect()


def test_files(spark, tmp_path):
    made = spark.createDataFrame([("a", b"1"), ("a/b_c", b"22"), ("é", b"3")], "panel string, content binary")
    for _ in range(2):
        done = {r.panel: (r.path, r.bytes) for r in figures.files(made, str(tmp_path / "f")).collect()}
        assert sorted(os.listdir(tmp_path / "f")) == ["a.png", "a_2f_b_5f_c.png", "é.png"]
        assert all(os.path.getsize(p) == n for p, n in done.values()) and done["a/b_c"][1] == 2


def test_sheets_pixel_by_pixel(spark):
    got = {r.panel: png.decoded(bytes(r.content)) for r in catalog.QUERIES["sample_sheets"](spark, SF).collect()}
    rows = {r.vec_id: picture(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = profile.sampled_ids(spark.createDataFrame([(k,) for k in rows], "id long"), "id", 10, 0)
    at = {r.id: r for r in workflows.located(*__import__("brindle.plans.kernels", fromlist=["_pair"])._pair(spark, SF), threshold=90).where(F.col("id").isin(ids)).collect()}
    assert sorted(got) == [0, 1] and len(ids) == 10
    for k, i in enumerate(ids):
        sheet = got[k // 5]
        assert sheet.shape == (32, 5 * 32 + 4 * 4, 3)
        cell = sheet[:, k % 5 * 36 : k % 5 * 36 + 32]
        want = np.repeat(rows[i][..., None], 3, 2)
        if at[i].x is not None:
            x0, y0 = at[i].x, at[i].y
            for y in range(32):
                for x in range(32):
                    inside = x0 <= x <= x0 + 16 and y0 <= y <= y0 + 16
                    if inside and (x in (x0, x0 + 16) or y in (y0, y0 + 16)):
                        want[y, x] = (255, 255, 0)
        assert (cell == want).all()
        assert k % 5 == 4 or (sheet[:, k % 5 * 36 + 32 : k % 5 * 36 + 36] == 0).all()
    assert CUT[0].stop - CUT[0].start == 16


def test_places_without_images(spark):
    images = spark.createDataFrame([(1, 2, 3, bytes(range(6))), (2, 1, 1, b"\x07"), (9, 1, 1, b"\x01")], "id int, height int, width int, data binary")
    boxes = spark.createDataFrame([(1, None, None, None, None), (2, 0, 0, 0, 0)], "id int, x int, y int, width int, height int")
    places = spark.createDataFrame([(1, 0), (5, 1), (2, 2)], "id int, place int")
    sheet = png.decoded(bytes(figures.sheets(images, boxes, places, 2, 2, 1).first().content))
    assert sheet.shape == (5, 7, 3) and sheet[:2, :3, 0].ravel().tolist() == list(range(6)) and (sheet[:2, 4:] == 0).all() and sheet[3, 0].tolist() == [255, 255, 0]
