"""Robust outliers by group, raw and relative to a reference point."""

from pyspark.sql import functions as F

from brindle.operators import robust
from brindle.plans.registry import register, table
from brindle.sources.stores import cut

_DOCS = """
WITH m AS (SELECT lang, median(n_chars) AS med FROM documents WHERE lang IS NOT NULL GROUP BY lang),
d AS (SELECT doc_id, lang, n_chars, abs(n_chars - med) AS dist FROM documents JOIN m USING (lang)),
s AS (SELECT lang, median(dist) AS dmed FROM d GROUP BY lang),
a AS (SELECT d.lang, median(abs(dist - dmed)) AS mad FROM d JOIN s USING (lang) GROUP BY d.lang),
z AS (SELECT doc_id, d.lang, n_chars, CASE WHEN mad = 0 THEN 0.0 ELSE 0.6745 * (dist - dmed) / mad END AS z
      FROM d JOIN s USING (lang) JOIN a USING (lang))
"""


def _docs(spark, sf_dir):
    return robust.position_outliers(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", ["n_chars"])


@register("robust_outliers", _DOCS + "SELECT doc_id, lang, n_chars, round(z, 6) AS z, z > 3.5 AS outlier FROM z")
def robust_outliers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", "n_chars", F.round("z", 6).alias("z"), "outlier")


@register(
    "outlier_summary",
    _DOCS + "SELECT lang, count(*) AS n, count(*) FILTER (z > 3.5) AS outliers, round(count(*) FILTER (z > 3.5) / count(*), 6) AS outlier_fraction FROM z GROUP BY lang",
)
def outlier_summary(spark, sf_dir):
    out = robust.outlier_summary(_docs(spark, sf_dir), "lang")
    return out.withColumn("outlier_fraction", F.round("outlier_fraction", 6))


@register("outliers_only", _DOCS + "SELECT lang, doc_id, round(z, 6) AS z FROM z WHERE z > 3.5")
def outliers_only(spark, sf_dir):
    return robust.outliers_only(_docs(spark, sf_dir), "lang").select("lang", "doc_id", F.round("z", 6).alias("z"))


@register(
    "event_outliers",
    """
    WITH m AS (SELECT event_type, median(value) AS med FROM events WHERE event_type IS NOT NULL GROUP BY 1),
    d AS (SELECT event_id, event_type, abs(value - med) AS dist FROM events JOIN m USING (event_type)),
    s AS (SELECT event_type, median(dist) AS dmed FROM d GROUP BY 1),
    a AS (SELECT d.event_type, median(abs(dist - dmed)) AS mad FROM d JOIN s USING (event_type) GROUP BY 1)
    SELECT event_type, count(*) AS n, count(*) FILTER (mad > 0 AND 0.6745 * (dist - dmed) / mad > 3.5) AS outliers
    FROM d JOIN s USING (event_type) JOIN a USING (event_type) GROUP BY 1
    """,
)
def event_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return robust.outlier_summary(robust.position_outliers(events, "event_type", ["value"]), "event_type").drop("outlier_fraction")


_OFFSETS = """
WITH c AS (SELECT l_orderkey, avg(l_quantity) AS cq, avg(l_extendedprice) AS cp FROM lineitem GROUP BY 1),
o AS (SELECT l_returnflag AS g, round(l_quantity - cq, 9) AS offset_q, round(l_extendedprice - cp, 9) AS offset_p FROM lineitem JOIN c USING (l_orderkey)),
"""


def _offsets(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    centre = items.groupBy("l_orderkey").agg(F.avg("q").alias("cq"), F.avg("p").alias("cp"))
    out = robust.offsets(items, centre, ["l_orderkey"], {"q": "cq", "p": "cp"})
    # every median is a pass over the offsets, so the join is made once
    return cut(out.select("g", *[F.round(c, 9).alias(c) for c in ("offset_q", "offset_p")]))


@register(
    "typical_offset",
    _OFFSETS
    + """
    t AS (SELECT g, count(*) AS n, median(offset_q) AS typical_offset_q, median(offset_p) AS typical_offset_p FROM o GROUP BY g)
    SELECT t.g, n, round(typical_offset_q, 6) AS typical_offset_q, round(typical_offset_p, 6) AS typical_offset_p,
      round(median(abs(offset_q - typical_offset_q)), 6) AS offset_q_spread, round(median(abs(offset_p - typical_offset_p)), 6) AS offset_p_spread
    FROM o JOIN t USING (g) GROUP BY ALL
    """,
)
def typical_offset(spark, sf_dir):
    out = robust.typical_offset(_offsets(spark, sf_dir), "g", ["offset_q", "offset_p"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if "offset" in c})


@register(
    "centroid_outliers",
    _OFFSETS
    + """
    m AS (SELECT g, median(offset_q) AS mq, median(offset_p) AS mp FROM o GROUP BY g),
    d AS (SELECT g, sqrt(pow(offset_q - mq, 2) + pow(offset_p - mp, 2)) AS dist FROM o JOIN m USING (g)),
    s AS (SELECT g, median(dist) AS dmed FROM d GROUP BY g),
    a AS (SELECT d.g, median(abs(dist - dmed)) AS mad FROM d JOIN s USING (g) GROUP BY d.g)
    SELECT d.g, count(*) AS n, count(*) FILTER (mad > 0 AND 0.6745 * (dist - dmed) / mad > 2.0) AS outliers FROM d JOIN s USING (g) JOIN a USING (g) GROUP BY d.g
    """,
)
def centroid_outliers(spark, sf_dir):
    out = robust.position_outliers(_offsets(spark, sf_dir), "g", ["offset_q", "offset_p"], cut=2.0)
    return robust.outlier_summary(out, "g").drop("outlier_fraction")
