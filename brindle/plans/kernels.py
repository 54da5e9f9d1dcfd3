"""Kernel queries on rasters made of the test tables; SQL can't express them, so the tests hold them against slow direct versions."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brindle import sources
from brindle.operators import forest
from brindle.plans import figures
from brindle.plans import workflows as W
from brindle.plans.registry import register, table

#: Enlargement of an embedding's 8 x 8 values each way, so that kernels have something to work on, and the part of it that is cut out as a crop.
SCALE = 4
CUT = (slice(8, 24), slice(12, 28))
RASTER = "height int, width int, data binary"


def picture(embedding: np.ndarray, brighter: int = 0) -> np.ndarray:
    """Values from -1 to 1 as 8 x 8 gray pixels, enlarged."""
    gray = np.floor((np.asarray(embedding, float) + 1) * 100 + 0.5) + brighter
    return np.kron(np.clip(gray, 0, 255).astype(np.uint8).reshape(8, 8), np.ones((SCALE, SCALE), np.uint8))


def _drawn(df, keep: str, brighter: int, cut: tuple[slice, slice] = (slice(None), slice(None))):
    """df's `keep` columns with the raster of its embedding, whole or cut: one array operation a row, nothing by character."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [picture(e, brighter)[cut] for e in b.pop("embedding")]
            b["height"], b["width"] = [a.shape[0] for a in made], [a.shape[1] for a in made]
            b["data"] = [a.tobytes() for a in made]
            yield b

    names = [k.split()[0] for k in keep.split(", ")]
    return df.select(*names, "embedding").mapInPandas(draw, f"{keep}, {RASTER}")


def _embeddings(spark, sf_dir):
    """Dealt to all cores, as a small table's one row group would be one task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "embeddings").repartition(parts, "vec_id").withColumn("id", F.col("vec_id").cast("int"))


def _rasters(spark, sf_dir, brighter=0):
    return _drawn(_embeddings(spark, sf_dir), "id int, label int", brighter)


def _pair(spark, sf_dir):
    named = _embeddings(spark, sf_dir).withColumns({"component": F.lit("vertbraANT"), "part": F.lit("vertbra"), "view": F.lit("ANT")})
    crops = _drawn(named, "component string, part string, view string, id int", 0, CUT)
    return crops, _drawn(named, "view string, id int", 0)


@register("locate_crops")
def locate_crops(spark, sf_dir):
    return W.located(*_pair(spark, sf_dir), threshold=90)


@register("mask_threshold_sweep")
def mask_threshold_sweep(spark, sf_dir):
    return W.swept(*_pair(spark, sf_dir), thresholds=(80.0, 100.0), percentiles=(50.0, 80.0))


@register("rotation_scale_best")
def rotation_scale_best(spark, sf_dir):
    return W.turned(*_pair(spark, sf_dir), angles=(-5.0, 0.0, 5.0), scales=(0.95, 1.0))


@register("perceptual_hashes")
def perceptual_hashes(spark, sf_dir):
    return W.hashed(_rasters(spark, sf_dir), ["id", "label"])


@register("perceptual_near_duplicates")
def perceptual_near_duplicates(spark, sf_dir):
    """Across two collections, the second a brighter copy of the first."""
    a, b = (W.hashed(_rasters(spark, sf_dir, k), ["id", "label"]) for k in (0, 3))
    return W.near_duplicates(a, b, "label", 4)


@register("raster_pixel_stats")
def raster_pixel_stats(spark, sf_dir):
    return W.pixel_stats(_rasters(spark, sf_dir), ["id"])


_PIXELS = "list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) * 100 + 0.5))))"


@register(
    "payload_stats",
    f"""WITH p AS (SELECT vec_id::INT AS id, {_PIXELS} AS v FROM embeddings)
    SELECT id, 32 AS height, 32 AS width, 'ok' AS status, 1024::BIGINT AS area, list_min(v)::INT AS pixel_min, list_max(v)::INT AS pixel_max, round(list_avg(v), 6) AS pixel_mean,
    round(list_median(v), 6) AS pixel_median, round(list_stddev_pop(v), 6) AS pixel_std FROM p""",
)
def payload_stats(spark, sf_dir):
    """Rasters written as image files in base64, as payload tables hold them, decoded again and measured."""
    lines = sources.encoded(_rasters(spark, sf_dir)).select("id", sources.base64_of().alias("b64"))
    back = sources.decoded(lines.select("id", F.try_to_binary("b64", F.lit("base64")).alias("content")))
    out = W.pixel_stats(back, ["id", "height", "width", "status"])
    return out.withColumns({c: F.round(c, 6) for c in ("pixel_mean", "pixel_median", "pixel_std")})


@register("cross_collection_payloads")
def cross_collection_payloads(spark, sf_dir):
    """Crops against a second collection of encoded payloads, slightly brighter: hashed by region, matched, and verified by location."""
    crops, whole = _pair(spark, sf_dir)
    region = F.col("id") % 16
    named = _embeddings(spark, sf_dir).withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("train"))
    files = sources.encoded(_drawn(named, "split string, id int", 3, CUT)).select("split", F.col("id").alias("image_id"), sources.base64_of().alias("b64"))
    other = sources.decoded(files.select("split", "image_id", (F.col("image_id") % 16).alias("region"), F.try_to_binary("b64", F.lit("base64")).alias("content")))
    boxes = crops.select("component", "id", F.lit(CUT[1].start).alias("x"), F.lit(CUT[0].start).alias("y"), "width", "height")
    return W.cross_collection(crops.withColumn("region", region), other, boxes, whole)


@register("raster_centroids")
def raster_centroids(spark, sf_dir):
    return W.centroids(_rasters(spark, sf_dir), ["id"], threshold=110)


@register("mask_cleanup_sweep")
def mask_cleanup_sweep(spark, sf_dir):
    return W.cleaned_boxes(_rasters(spark, sf_dir), ["id"], min_areas=(20, 100), kernels=(3, 5), distances=(2.0, 5.0))


@register("whole_body_boxes")
def whole_body_boxes(spark, sf_dir):
    """Two collections: the second holds all rasters, the first those of all labels but one; regions are known for three labels."""
    every = _rasters(spark, sf_dir).withColumns({"view": F.when(F.col("label") < 5, "ANT").otherwise("POST"), "source": F.lit("b")})
    first = every.where("label <> 9").withColumn("source", F.lit("a"))
    return W.whole_bodies(first.drop("label"), every.drop("label"), first.where(F.col("label").isin(0, 3, 6)).select("id", "source"), threshold=110)


@register("box_deliverable")
def box_deliverable(spark, sf_dir):
    """All boxes with label, diagnosis and notes; every third raster's crop also stands for the one after it, so there are duplicates."""
    crops, whole = _pair(spark, sf_dir)
    other = crops.where("id % 3 = 0").select("component", "part", "view", (F.col("id") + 1).alias("id"), "height", "width", "data")
    crops = crops.where("id % 3 <> 1").unionByName(other.join(crops.select("id"), "id", "left_semi"))
    marks = _embeddings(spark, sf_dir).where("label < 8").select(F.lit("vertbraANT").alias("component"), "id", (F.col("label") % 2).alias("label"))
    table_, _ = W.box_table(crops, whole, marks, cross_collection_payloads(spark, sf_dir), {0: "normal", 1: "abnormal"}, threshold=90)
    return table_


@register("sample_sheets")
def sample_sheets(spark, sf_dir):
    """Two sheets of a seeded sample of ten rasters with the boxes at which their crops were found."""
    return W.preview_sheets(*_pair(spark, sf_dir), n=10, rows=1, columns=5, threshold=90)


_EDGE = """(SELECT l_returnflag AS panel, l_quantity AS x, l_extendedprice AS y, l_discount >= 0.1 AS f, min(l_quantity) OVER w AS x0, max(l_quantity) OVER w AS x1,
  min(l_extendedprice) OVER w AS y0, max(l_extendedprice) OVER w AS y1 FROM lineitem WINDOW w AS (PARTITION BY l_returnflag))"""


@register(
    "figure_pixels",
    f"""SELECT panel, least(119, floor((x - x0) / (x1 - x0) * 120))::INT AS px, least(89, floor((y - y0) / (y1 - y0) * 90))::INT AS py, bool_or(f) AS marked
    FROM {_EDGE} GROUP BY ALL""",
)
def figure_pixels(spark, sf_dir):
    """Scatter figures of all line items as image files, read back: every pixel that isn't paper, and whether it is marked."""
    items = table(spark, sf_dir, "lineitem")
    bins = figures.pixel_bins(items, "l_returnflag", F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount") >= 0.1, 120, 90)
    drawn = sources.decoded(figures.scatters(bins, 120, 90))
    return W.coloured(drawn, ["panel"], figures.PAPER, figures.MARK)


@register("isolation_forest")
def isolation_forest(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    items = items.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return forest.anomalies(items, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
