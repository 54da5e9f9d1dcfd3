import base64
import json

import numpy as np
from pyspark.sql import functions as F

from brindle import sources, streaming
from brindle.operators import dedup, enrich, forest, geometry, profile, robust
from brindle.plans import sinks, workflows
from brindle.raster import mask as masks

IMG = "view string, id int, height int, width int, data binary"
CROP = "component string, part string, view string, id int, height int, width int, data binary"


def rows(ids, seed=0):
    rng = np.random.default_rng(seed)
    whole, crops, at = [], [], {}
    for i in ids:
        img = rng.poisson(30, (300, 80)).clip(3, 255).astype(np.uint8)
        whole.append(("ANT", i, 300, 80, img.tobytes()))
        for part, y, x in (("vertbra", 120, 20), ("shoL", 90, 5), ("head", 3, 30)):
            crops.append((f"{part}ANT", part, "ANT", i, 30, 20, img[y : y + 30, x : x + 20].tobytes()))
            at[f"{part}ANT", i] = (x, y)
    return whole, crops, at


def test_crops_are_located(spark):
    whole, crops, at = rows(range(4))
    crops += [("headANT", "head", "ANT", 77, 30, 20, bytes(600)), ("kneeANT", "knee", "ANT", 0, 30, 20, bytes(600)), ("bigANT", "big", "ANT", 0, 301, 20, bytes(6020))]
    got = {(r.component, r.id): r for r in workflows.located(spark.createDataFrame(crops, CROP), spark.createDataFrame(whole, IMG)).collect()}
    assert ("headANT", 77) not in got and got["kneeANT", 0].status == "blank" and got["bigANT", 0].status == "too large"
    for k, (x, y) in at.items():
        assert (got[k].x, got[k].y, got[k].status, got[k].banded) == (x, y, "ok", k[0] == "shoLANT") and got[k].ssim > 0.999


def test_sweeps_and_turns(spark):
    whole, crops, at = rows([1])
    c, w = spark.createDataFrame(crops, CROP), spark.createDataFrame(whole, IMG)
    out = workflows.swept(c, w, thresholds=(2, 30), percentiles=(50,)).collect()
    assert len(out) == 9 and all((r.x, r.y) == at[r.component, r.id] for r in out)
    best = workflows.turned(c.limit(1), w, angles=(-5, 0, 5), scales=(0.9, 1.0)).first()
    assert (best.angle, best.scale) == (0, 1)


def test_verified_flags_and_notes(spark):
    whole, crops, at = rows([1, 2])
    boxes = spark.createDataFrame([(c, i, x, y, 20, 30) for (c, i), (x, y) in at.items()], "component string, id int, x int, y int, width int, height int")
    payload = spark.createDataFrame([("train", 5, 30, 20, crops[0][-1]), ("train", 6, 30, 20, bytes(600))], "split string, image_id int, height int, width int, data binary")
    flags = spark.createDataFrame([("vertbraANT", 1, "train", 5, 2), ("headANT", 1, "train", 5, 4), ("headANT", 1, "train", 6, 0)], "component string, id int, split string, image_id int, hamming_distance int")
    out = workflows.verified(flags, boxes, payload, spark.createDataFrame(whole, IMG))
    got = {r.component: r for r in out.collect()}
    assert len(got) == 2 and got["vertbraANT"].iou == 1 and got["headANT"].iou == 0
    notes = dedup.match_notes(out.where("iou >= 0.5"), ["component", "id"], "split", "image_id", "hamming_distance", "iou").collect()
    assert [n.note for n in notes] == ["train/5(2,iou=1.00)"]


def test_whole_bodies(spark):
    rng = np.random.default_rng(3)
    images = []
    for i in range(60):
        img = np.zeros((64, 32), np.uint8)
        img[10 : 50 + rng.integers(0, 4), 10 : 20 + rng.integers(0, 4)] = 90
        if i == 7:
            img[:] = 0
            img[30:34, 2:30] = 90
        images.append(("ANT", i, "a", 64, 32, img.tobytes()))
    schema = "view string, id int, source string, height int, width int, data binary"
    extra = spark.createDataFrame([("ANT", 3, "b", 64, 32, images[0][-1]), ("ANT", 500, "b", 64, 32, images[0][-1]), ("ANT", None, "b", 64, 32, images[0][-1])], schema)
    out = workflows.whole_bodies(spark.createDataFrame(images, schema), extra, spark.createDataFrame([(1, "a"), (500, "a")], "id int, source string"))
    got = {r.id: r for r in out.collect()}
    assert len(got) == 61 and got[500].source == "b" and got[1].has_region_crops and not got[500].has_region_crops
    assert got[7].outlier and got[7].likely_corrupt_image and not got[8].likely_corrupt_image


def test_forest_ranks_a_far_point_first():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(400, 3)), [[9, 9, 9]]])
    s = forest.scores(forest.fit(x), x)
    assert s.argmax() == 400 and (0 < s).all() and (s < 1).all()


def test_banded_join_is_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 40)
    hs = [int(b) ^ (1 << int(k)) ^ (1 << int(j)) if k < 63 and j < 63 else int(b) for b in base for k, j in rng.integers(0, 64, (5, 2))]
    df = spark.createDataFrame([(i, i % 3, h) for i, h in enumerate(hs)] + [(900, 0, -1), (901, 0, 0)], "id int, block int, h long")
    key = lambda d: sorted((r.l_id, r.r_id, r.distance) for r in d.collect())
    assert key(dedup.banded_hamming_join(df, df, "block", "h", 4)) == key(dedup.hamming_join(df, df, "block", "h", 4))


def test_boxes_and_robust_edges(spark):
    b = lambda *v: tuple(F.lit(x) for x in v)
    cases = {(0, 0, 4, 4): 1.0, (4, 0, 4, 4): 0.0, (9, 9, 1, 1): 0.0, (1, 1, 2, 2): 0.25, (0, 0, 0, 0): 0.0}
    row = spark.range(1).select(*[geometry.iou(b(0, 0, 4, 4), b(*k)).alias(str(i)) for i, k in enumerate(cases)], geometry.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)).alias("z")).first()
    assert list(row) == [*cases.values(), 0.0]
    flat = spark.createDataFrame([("g", 5.0)] * 4 + [("g", 50.0), (None, 1.0)], "g string, v double")
    out = robust.position_outliers(flat, "g", ["v"]).collect()
    assert len(out) == 5 and not any(r.outlier for r in out)
    text = spark.createDataFrame([("Left Knee joint",), ("knee and head",), ("none",), (None,)], "t string")
    assert [r.c for r in text.select(enrich.classify(F.col("t"), {"knee": "K", "head": "H"}).alias("c")).collect()] == ["K", None, None, None]
    bits = spark.createDataFrame([([1, 0, 1, 1],)], "b array<int>").select(dedup.bits_to_long("b")).first()[0]
    assert bits == 11


def jpeg(spark, path, height=6, width=5):
    jvm = spark.sparkContext._jvm
    img = jvm.java.awt.image.BufferedImage(width, height, 10)
    jvm.javax.imageio.ImageIO.write(img, "jpg", jvm.java.io.File(str(path)))


def test_sources_and_sinks(spark, tmp_path):
    top = tmp_path / "tree"
    for folder in ("headANT", "kneeLANT", "skip"):
        (top / folder).mkdir(parents=True)
        jpeg(spark, top / folder / "12.jpg")
    jpeg(spark, top / "headANT" / "972(1).jpg")
    (top / "headANT" / "headANT.txt").write_text("12.jpg\t1\n13.jpg\t0\n")
    got = {(r.component, r.stem, r.id) for r in sources.listing(spark, str(top), without=("skip",)).collect()}
    assert got == {("headANT", "12", 12), ("kneeLANT", "12", 12), ("headANT", "972(1)", None)}
    dims = {tuple(r) for r in sources.dimensions(spark, str(top / "kneeLANT")).collect()}
    assert dims == {("kneeLANT", 12, 6, 5)}
    img = sources.images(spark, str(top / "kneeLANT")).first()
    assert (img.height, img.width, img.id, img.component) == (6, 5, 12, "kneeLANT")
    assert {tuple(r) for r in sources.labels(spark, str(top)).collect()} == {("headANT", 12, 1), ("headANT", 13, 0)}
    (tmp_path / "i.tsv").write_text(f"7\t{base64.b64encode(b'hello').decode()}\n8\t***\n")
    assert [(r.image_id, r.content and bytes(r.content)) for r in sources.encoded_images(spark, str(tmp_path / "i.tsv"), "train").collect()] == [(7, b"hello"), (8, None)]
    (tmp_path / "t.jsonl").write_text(json.dumps({"text": "head", "image_ids": [1, 2, 2]}) + "\n")
    assert sources.captions(spark, str(tmp_path / "t.jsonl"), "test").count() == 2
    (tmp_path / "b.csv").write_text("a,b\n-inf,nan\n1.5,inf\n")
    t = sources.table(spark, str(tmp_path / "b.csv"), "a double, b double").collect()
    assert t[0].a == float("-inf") and t[0].b != t[0].b and t[1].b == float("inf")
    df = spark.createDataFrame([("head", 0.99954)], "component string, ssim double")
    sinks.csv(df, str(tmp_path / "out"))
    sinks.workbook({"summary": df}, str(tmp_path / "book.xlsx"))
    sinks.json_report(df, str(tmp_path / "j"))
    assert spark.read.parquet(sinks.versioned(df, str(tmp_path / "v"), 1)).count() == 1
    assert sinks.markdown(df, {"component": "%s", "ssim": "%.4f"}).endswith("| head | 0.9995 |")
    assert sources.layered({"a": df, "b": df}).groupBy("layer").count().count() == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, data in enumerate((b"x", b"y", b"x")):
        (tmp_path / "in" / f"{k}.jpg").write_bytes(data)
    q = streaming.image_stream(spark, str(tmp_path / "in")).select("md5").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select distinct md5 from seen").count() == 2


def test_bracketed_medians_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{n}", float(v)) for n in (1, 2, 3, 4, 1000, 5001) for v in rng.integers(0, max(2, n // 3), n)] + [("g1", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: r.m for r in df.where("g is not null").groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert {r.g: r.median for r in robust.bracketed_medians(df.where("g is not null"), "g", "v").collect()} == want
    key = lambda d: sorted((r.g, r.v or 0, r.z or 0, bool(r.outlier)) for r in d.collect())
    assert len(key(robust.position_outliers(df, "g", ["v"]))) == df.where("g is not null").count()


def test_band_between_two_anchors(spark):
    rng = np.random.default_rng(12)
    img = rng.integers(3, 255, (200, 80)).astype(np.uint8)
    img[5:35, 30:50] = img[90:120, 40:60]  # the shoulder's pixels stand above the head too
    cut = lambda y, x, h=30: (h, 20, img[y : y + h, x : x + 20].tobytes())
    crops = [("shoLANT", "shoL", "ANT", 1, *cut(5, 30)), ("pelvisANT", "pelvis", "ANT", 1, *cut(150, 10)), ("headANT", "head", "ANT", 1, *cut(45, 20)), ("shoRANT", "shoR", "ANT", 1, *cut(40, 50, 90))]
    c, w = spark.createDataFrame(crops, CROP), spark.createDataFrame([("ANT", 1, 200, 80, img.tobytes())], IMG)
    got = {r.component: (r.x, r.y, r.banded) for r in workflows.located(c, w, between=("head", "pelvis")).collect()}
    assert got == {"headANT": (20, 45, False), "pelvisANT": (10, 150, False), "shoLANT": (40, 90, True), "shoRANT": (50, 40, False)}


def test_metrics_both_ways(spark):
    rng = np.random.default_rng(13)
    img = rng.integers(100, 255, (60, 50)).astype(np.uint8)
    crop = img[20:40, 10:30].copy()
    crop[:5] = 0  # the mask leaves these rows out
    c = spark.createDataFrame([("kneeANT", "knee", "ANT", 1, 20, 20, crop.tobytes())], CROP)
    w = spark.createDataFrame([("ANT", 1, 60, 50, img.tobytes())], IMG)
    for r in (workflows.located(c, w).first(), workflows.swept(c, w, thresholds=(2,)).first()):
        assert (r.x, r.y) == (10, 20) and r.mae_masked_eval == 0 and abs(r.mae - img[20:25, 10:30].sum() / 400) < 1e-9
        assert r.near_exact_fraction == 0.75 and r.near_exact_fraction_masked_eval == 1


def test_samples_reports_and_outlines(spark, capsys):
    import random

    ids = [5, 9, -3, 70000, 70001, 131072, 131073, 12, 5]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id long")
    for seed in range(3):
        assert profile.sampled_ids(df, "id", 4, seed) == random.Random(seed).sample(sorted(set(ids)), 4)
    assert profile.sampled_ids(df.limit(0), "id", 4) == []
    # far apart, uneven and at both ends of the type: few blocks are counted, whatever the ids
    sparse = [-(1 << 63), (1 << 63) - 1, *(k * 10**13 - 7 for k in range(-300, 300)), *range(10**15, 10**15 + 500)]
    df = spark.createDataFrame([(i,) for i in sparse], "id long")
    for seed, n in ((0, 5), (1, 40), (2, 2000)):
        ids = sorted(set(sparse))
        assert profile.sampled_ids(df, "id", n, seed, width=3) == random.Random(seed).sample(ids, min(n, len(ids)))
    counts = dedup.duplicate_counts(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string"), "t")
    assert sinks.console(counts, "files") == capsys.readouterr().out.rstrip("\n")
    assert [tuple(r) for r in sinks.counted_lines(counts).collect()] == [("files", 3), ("unique", 2), ("groups", 1), ("grouped files", 2), ("largest group", 2)]
    img = np.full((6, 8), 100, np.uint8)
    out = masks.outlined(img, [(1, 1, 3, 2), (6, 4, 9, 9)], alpha=0.5)
    want = {(y, x) for x in range(1, 5) for y in (1, 3)} | {(2, 1), (2, 4), (4, 6), (4, 7), (5, 6)}
    assert {(int(y), int(x)) for y, x in zip(*np.nonzero((out != 100).any(axis=2)))} == want and tuple(out[1, 1]) == (50, 177, 177)


def test_stream_of_windows_and_first_seen(spark, tmp_path):
    (tmp_path / "e").mkdir()
    rows = [{"ts": f"2024-01-01T0{h}:10:00", "event_type": "a", "value": v, "md5": m} for h, v, m in ((1, 1.0, "x"), (1, 3.0, "x"), (2, 5.0, "y"), (9, 0.0, "z"))]
    (tmp_path / "e" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    made = spark.readStream.schema("ts timestamp, event_type string, value double, md5 string").json(str(tmp_path / "e"))
    for name, df in (("win", streaming.windowed_counts(made)), ("once", streaming.first_seen(made, time="ts"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.n, r["mean"]) for r in spark.table("win").collect()) == [(1, 5.0), (2, 2.0)]
    assert sorted(r.md5 for r in spark.table("once").collect()) == ["x", "y", "z"]
