"""Decoders against the JVM's, headers against files that try to mislead, payload tables end to end."""

import base64
import io
import os
import zlib

import numpy as np

from brindle import sources
from brindle.plans import catalog, workflows
from brindle.raster import jpeg, png
from brindle.sources import payload as files

SF = "/root/testdata/sf0.001"


def save(spark, path, pixels, quality=None, progressive=False):
    """Written by the JVM, as JPEG or PNG by the name."""
    jvm = spark.sparkContext._jvm
    height, width = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 10 if pixels.ndim == 2 else 1)
    flat = pixels.astype(int) if pixels.ndim == 2 else pixels[..., 0].astype(int) << 16 | pixels[..., 1].astype(int) << 8 | pixels[..., 2]
    numbers = spark.sparkContext._gateway.new_array(jvm.int, height * width)
    for k, v in enumerate(flat.ravel().tolist()):
        numbers[k] = v
    if pixels.ndim == 2:
        image.getRaster().setSamples(0, 0, width, height, 0, numbers)
    else:
        image.setRGB(0, 0, width, height, numbers, 0, width)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(str(path).rsplit(".", 1)[1]).next()
    how = writer.getDefaultWriteParam()
    if quality is not None:
        how.setCompressionMode(2)
        how.setCompressionQuality(quality)
    if progressive:
        how.setProgressiveMode(1)
    to = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(to)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    to.close()


def scene(height, width, seed=0):
    y, x = np.mgrid[:height, :width]
    noise = np.random.default_rng(seed).normal(0, 12, (height, width))
    return np.clip(128 + 90 * np.sin(y / 7) + 60 * np.cos(x / 5) + noise, 0, 255).astype(np.uint8)


def test_pixels_are_those_of_the_jvm(spark, tmp_path):
    for h, w in ((64, 48), (37, 53), (1, 1), (7, 3), (90, 100)):
        for q, progressive in ((None, False), (0.3, True), (0.98, False), (0.9, True)):
            save(spark, tmp_path / f"g{h}x{w}_{q}_{progressive}.jpg", scene(h, w), q, progressive)
        for progressive in (False, True):
            save(spark, tmp_path / f"c{h}x{w}_{progressive}.jpg", np.stack([scene(h, w, s) for s in range(3)], -1), None, progressive)
    want = {r.stem: r for r in sources.images(spark, str(tmp_path)).collect()}
    got = sources.decoded(sources.contents(spark, str(tmp_path))).collect()
    assert len(got) == len(want) == 30
    for r in got:
        w = want[r.stem]
        assert r.status == "ok" and (r.height, r.width, r.nChannels, r.mode) == (w.height, w.width, w.nChannels, w.mode), r.stem
        assert bytes(r.data) == bytes(w.data), r.stem
    for k, a in enumerate((scene(33, 40), np.stack([scene(21, 30, s) for s in range(3)], -1))):
        save(spark, tmp_path / f"p{k}.png", a)
        assert (png.decoded((tmp_path / f"p{k}.png").read_bytes()) == (a if a.ndim == 2 else a[..., ::-1])).all()


def test_png_filters_and_kinds():
    a = np.stack([scene(9, 11, s) for s in range(3)], -1)

    def filtered(kind, step):
        rows, raw = a.reshape(9, -1).astype(int), b""
        for y in range(9):
            left = np.r_[np.zeros(step, int), rows[y, :-step]]
            up = rows[y - 1] if y else np.zeros_like(left)
            corner = np.r_[np.zeros(step, int), up[:-step]]
            to = left + up - corner
            near = [min((p, q, r), key=lambda v: abs(t - v)) for p, q, r, t in zip(left, up, corner, to)]
            guess = (np.zeros_like(left), left, up, (left + up) // 2, np.array(near))[kind]
            raw += bytes([kind]) + ((rows[y] - guess) % 256).astype(np.uint8).tobytes()
        head = (11).to_bytes(4, "big") + (9).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
        return png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", zlib.compress(raw)) + png._chunk(b"IEND", b"")

    for kind in range(5):
        assert (png.decoded(filtered(kind, 3)) == a[..., ::-1]).all()
    for b in (a, a[..., 0], a[:1, :1]):
        assert (png.decoded(png.encoded(b)) == b).all()
    head = (4).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes([8, 3, 0, 0, 0])
    parts = png._chunk(b"IHDR", head) + png._chunk(b"PLTE", bytes([1, 2, 3, 9, 8, 7])) + png._chunk(b"IDAT", zlib.compress(bytes([0, 0, 1, 1, 0])))
    assert png.decoded(png.SIGNATURE + parts).tolist() == [[[3, 2, 1], [7, 8, 9], [7, 8, 9], [3, 2, 1]]]


def test_what_cannot_be_decoded_says_why(spark, tmp_path):
    save(spark, tmp_path / "a.jpg", scene(40, 30))
    good = (tmp_path / "a.jpg").read_bytes()
    at = good.index(b"\xff\xc0")
    lossless = good[:at] + b"\xff\xc3" + good[at + 2 :]
    broken = png.encoded(scene(20, 20))
    rows = {
        "good": good, "cut": good[: len(good) // 2], "head": good[:3], "scanless": good[: good.index(b"\xff\xda")], "text": b"hello", "none": None, "empty": b"", "lossless": lossless, "png": broken, "cut png": broken[:-60],
        "zeros": good[: good.index(b"\xff\xda") + 14] + bytes(2000),
    }
    df = spark.createDataFrame([(k, v, 7, "x") for k, v in rows.items()], "name string, content binary, height int, status string")
    got = {r.name: r for r in sources.decoded(df).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "good": "ok", "cut": "truncated", "head": "truncated", "scanless": "truncated", "text": "no jpeg", "none": "empty", "empty": "empty", "lossless": "unsupported", "png": "ok", "cut png": "truncated",
        "zeros": got["zeros"].status,
    }
    assert got["zeros"].status in ("ok", "truncated", "corrupt")
    assert all((r.data is None) == (r.status != "ok") and (r.height is None) == (r.status != "ok") for r in got.values())
    assert sources.decoded(df.limit(0)).count() == 0
    back = {r.name: r.content for r in sources.encoded(sources.decoded(df).select("name", "height", "width", "data")).collect()}
    assert back["cut"] is None and (png.decoded(bytes(back["good"])) == jpeg.decoded(good)).all()


def test_a_batch_is_handed_on_in_parts(spark):
    rows = [(k, png.encoded(np.full((300, 300), k, np.uint8))) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, content binary").coalesce(1)
    for together in (1, 200_000, 1 << 30):
        got = sources.decoded(df, together=together).collect()
        assert [(r.id, r.data[0], len(r.data)) for r in got] == [(k, k, 90000) for k in range(40)]


def test_headers_by_marker_segments(spark, tmp_path):
    """A thumbnail and a payload full of frame markers come before the frame header; only it counts, and little is read."""
    folder = tmp_path / "headANT"
    folder.mkdir()
    save(spark, tmp_path / "small.jpg", scene(16, 12))
    save(spark, folder / "1.jpg", scene(400, 300), 1.0)
    save(spark, folder / "2.jpg", scene(50, 70), None, True)
    thumbnail, big = (tmp_path / "small.jpg").read_bytes(), (folder / "1.jpg").read_bytes()
    segment = lambda body: b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body
    tricky = big[:2] + segment(b"Exif\0\0" + thumbnail) + segment(b"\xff\xc0\x00\x11\x08\x00\x05\x00\x05" * 3000) + b"\xff\xff" + big[2:]
    (folder / "3.jpg").write_bytes(tricky)
    (folder / "4.jpg").write_bytes(b"no image")
    (folder / "5.jpg").write_bytes(tricky[:200])
    got = {r.id: r for r in sources.headers(sources.listing(spark, str(tmp_path), without=())).where("component = 'headANT'").collect()}
    assert {i: (r.height, r.width, r.nChannels, r.status) for i, r in got.items()} == {
        1: (400, 300, 1, "ok"), 2: (50, 70, 1, "ok"), 3: (400, 300, 1, "ok"), 4: (None, None, None, "no jpeg"), 5: (None, None, None, "truncated"),
    }
    assert got[3].length > 60_000 and all(r.bytes_read <= 6 * files.BLOCK for r in got.values())
    assert jpeg.decoded(tricky).shape == (400, 300)
    assert {tuple(r) for r in sources.dimensions(spark, str(folder)).collect()} == {("headANT", 1, 400, 300), ("headANT", 2, 50, 70), ("headANT", 3, 400, 300)}
    plan = sources.listing(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan  # contents aren't read


def test_ranges():
    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    data = os.urandom(5000)
    read = files.Ranges(File(data), 100)
    for start, size in ((0, 2), (2, 4), (90, 20), (4990, 50), (6000, 4), (10, 300)):
        assert read(start, size) == data[start : start + size]
    assert read.bytes < 1000


def test_payload_table_to_verified_pairs(spark, tmp_path):
    """From files and a table of base64 payloads over pixels and hashes to boxes, with decoded pixels on either side."""
    rng = np.random.default_rng(5)
    (tmp_path / "kneeANT").mkdir()
    lines, whole, boxes = [], [], []
    for i in range(6):
        img = np.clip(rng.normal(120, 40, (96, 64)), 3, 255).astype(np.uint8)
        img[24:56, 8:40] = scene(32, 32, i) // 2 + 60
        save(spark, tmp_path / "kneeANT" / f"{i}.jpg", img[24:56, 8:40], 1.0)
        save(spark, tmp_path / f"other{i}.jpg", img[24:56, 8:40], 0.9)
        lines.append(f"{i + 50}\t{base64.b64encode((tmp_path / f'other{i}.jpg').read_bytes()).decode()}")
        whole.append(("ANT", i, 96, 64, img.tobytes()))
        boxes.append(("kneeANT", i, 8 if i else 20, 24, 32, 32))
    lines += ["90\t***", "91\t", f"92\t{base64.b64encode(b'text').decode()}"]
    (tmp_path / "train_imgs.tsv").write_text("\n".join(lines) + "\n")
    from pyspark.sql import functions as F

    payload = sources.decoded(sources.encoded_images(spark, str(tmp_path / "train_imgs.tsv"), "train"))
    assert {r.image_id: r.status for r in payload.where("status <> 'ok'").collect()} == {90: "empty", 91: "empty", 92: "no jpeg"}
    own = sources.images(spark, str(tmp_path / "kneeANT")).withColumn("region", F.lit("knee"))
    out = workflows.cross_collection(
        own.select("component", "id", "region", "height", "width", "data"), payload.withColumn("region", F.lit("knee")),
        spark.createDataFrame(boxes, "component string, id int, x int, y int, width int, height int"), spark.createDataFrame(whole, "view string, id int, height int, width int, data binary"),
    )
    got = {(r.id, r.image_id): r for r in out.collect()}
    assert all(got[i, i + 50].hamming_distance <= 4 and (got[i, i + 50].x, got[i, i + 50].y) == (8, 24) for i in range(6))
    assert [got[i, i + 50].iou == 1 for i in range(6)] == [False] + [True] * 5 and got[0, 50].dx == -12


def test_payload_queries(spark):
    """The payload query finds what the same crops give without files."""
    got = {(r.id, r.image_id): r for r in catalog.QUERIES["cross_collection_payloads"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    from brindle.plans.kernels import CUT, picture
    from brindle.raster import shape

    ours = {r.vec_id: shape.perceptual_hash(picture(r.embedding)[CUT]) for r in rows}
    theirs = {r.vec_id: shape.perceptual_hash(picture(r.embedding, 3)[CUT]) for r in rows}
    want = {(a, b): (ours[a] ^ theirs[b]).bit_count() for a in ours for b in theirs if a % 16 == b % 16 and (ours[a] ^ theirs[b]).bit_count() <= 4}
    assert {k: r.hamming_distance for k, r in got.items()} == want and len(want) > 200
    assert all(r.iou > 0.99 for (a, b), r in got.items() if a == b and r.match_score > 0.999999 and r.peak_margin > 0)
    assert all(r.split == ("test" if b % 3 == 0 else "train") for (_, b), r in got.items())
