"""Box arithmetic on integer boxes made of line items: one box a line, one reference a supplier and order."""

from pyspark.sql import functions as F

from brindle.operators import geometry as G
from brindle.operators import quantile
from brindle.plans.registry import register, table

_BOX = """(SELECT l_orderkey AS k, l_linenumber AS line, l_returnflag AS g, (l_partkey % 200)::INT AS x, (l_suppkey % 100)::INT AS y, (l_quantity + 5)::INT AS width, (l_linenumber * 7 + 3)::INT AS height FROM lineitem)"""


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("g"), (F.col("l_partkey") % 200).cast("int").alias("x"),
        (F.col("l_suppkey") % 100).cast("int").alias("y"), (F.col("l_quantity") + 5).cast("int").alias("width"), (F.col("l_linenumber") * 7 + 3).cast("int").alias("height"),
    )


_REF = "(SELECT o_orderkey AS k, (o_custkey % 200)::INT AS rx, (o_orderkey % 100)::INT AS ry, 40 AS rw, 30 AS rh FROM orders)"
_IOU = f"""WITH i AS (SELECT b.*, rx, ry, greatest(least(x + width, rx + rw) - greatest(x, rx), 0) * greatest(least(y + height, ry + rh) - greatest(y, ry), 0) AS s, rw, rh
  FROM {_BOX} b JOIN {_REF} r USING (k)), v AS (SELECT *, s / (width * height + rw * rh - s) AS iou FROM i) """


def _verified(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ref = o.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 200).cast("int").alias("rx"), (F.col("o_orderkey") % 100).cast("int").alias("ry"), F.lit(40).alias("rw"), F.lit(30).alias("rh"))
    both = _boxes(spark, sf_dir).join(ref, "k")
    a, b = G.box(), (F.col("rx"), F.col("ry"), F.col("rw"), F.col("rh"))
    dx, dy = G.displacement(a, b)
    return both.withColumns({"iou": G.iou(a, b), "dx": dx, "dy": dy})


@register("iou_verify", _IOU + "SELECT k, line, x, y, round(iou, 6) AS iou, x - rx AS dx, y - ry AS dy FROM v")
def iou_verify(spark, sf_dir):
    return _verified(spark, sf_dir).select("k", "line", "x", "y", F.round("iou", 6).alias("iou"), "dx", "dy")


@register("iou_by_group", _IOU + "SELECT g, count(*) AS n, round(avg((iou >= 0.1)::INT), 6) AS matched, round(avg((iou = 0)::INT), 6) AS apart, round(median(iou), 6) AS median_iou FROM v GROUP BY g")
def iou_by_group(spark, sf_dir):
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    found = _verified(spark, sf_dir)
    out = found.groupBy("g").agg(F.count("*").alias("n"), rate(F.col("iou") >= 0.1).alias("matched"), rate(F.col("iou") == 0).alias("apart"))
    return out.join(quantile.medians(found, ["g"], {"m": F.col("iou")}), "g", "left").select("g", "n", "matched", "apart", F.round("m", 6).alias("median_iou"))


@register(
    "box_union_containment",
    f"""WITH u AS (SELECT k, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM {_BOX} GROUP BY k),
    p AS (SELECT unnest([0, 5, 8, 60]) AS pad)
    SELECT pad, count(*) AS n, count(*) FILTER (100 - 30 - pad <= x0 AND 50 - 30 - pad <= y0 AND 100 + 60 + pad >= x1 AND 50 + 60 + pad >= y1) AS contained FROM u, p GROUP BY pad""",
)
def box_union_containment(spark, sf_dir):
    from brindle.operators.profile import sweep

    u = sweep(G.box_union(_boxes(spark, sf_dir), "k"), spark.createDataFrame([(0,), (5,), (8,), (60,)], "pad int"))
    pad = F.col("pad")
    inside = G.contains((70 - pad, 20 - pad, 160 + pad, 110 + pad), tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    return u.groupBy("pad").agg(F.count("*").alias("n"), F.count_if(inside).alias("contained"))


@register(
    "band_clamp",
    f"""WITH b AS (SELECT k, line, height, greatest(y * 10 - 100, 0) AS top, least(y * 10 + 250, 1024) AS bottom, greatest(x - 5, 0) AS px0, least(x + width + 5, 255) AS px1 FROM {_BOX})
    SELECT k, line, top, bottom, bottom - top >= height * 6 AS fits, px0, px1 FROM b""",
)
def band_clamp(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    top, bottom = G.band(F.col("y") * 10, F.lit(1024))
    x0, _, x1, _ = G.padded(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"), F.lit(256), F.lit(1024))
    return b.select("k", "line", top.alias("top"), bottom.alias("bottom"), G.band_fits(top, bottom, F.col("height") * 6).alias("fits"), x0.alias("px0"), x1.alias("px1"))


@register(
    "feature_vector",
    f"""SELECT k, line, round(width / height, 6) AS aspect_ratio, round(x + width / 2 - 128, 6) AS center_x_offset, round(y / 1024, 6) AS top_margin_frac,
    round((1024 - y - height) / 1024, 6) AS bottom_margin_frac, round(width / 256, 6) AS width_frac, round(height / 1024, 6) AS height_frac FROM {_BOX}""",
)
def feature_vector(spark, sf_dir):
    f = G.features(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"), F.lit(256), F.lit(1024))
    return _boxes(spark, sf_dir).select("k", "line", *[F.round(c, 6).alias(n) for n, c in f.items()])
