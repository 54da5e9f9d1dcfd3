"""Coverage, ratios, exact summaries, quality tables and parameter sweeps."""

from pyspark.sql import functions as F

from brindle.operators import geometry, profile
from brindle.plans.registry import register, table

TYPES = ["click", "error", "purchase", "signup", "view"]


def _types(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", "value")


@register("coverage_pivot", "SELECT user_id, " + ", ".join(f"max((event_type = '{t}')::INT) AS \"{t}\"" for t in TYPES) + " FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def coverage_pivot(spark, sf_dir):
    return profile.coverage(_types(spark, sf_dir), "user_id", "event_type", TYPES)


@register(
    "coverage_summary",
    f"""SELECT event_type, coalesce(c, 0) AS present, total, total - coalesce(c, 0) AS missing FROM (SELECT unnest({TYPES}) AS event_type)
    LEFT JOIN (SELECT event_type, count(DISTINCT user_id) AS c FROM events GROUP BY 1) USING (event_type), (SELECT count(DISTINCT user_id) AS total FROM events)""",
)
def coverage_summary(spark, sf_dir):
    return profile.coverage_summary(_types(spark, sf_dir), "user_id", "event_type", TYPES)


@register(
    "size_ratio_summary",
    """SELECT l_returnflag AS g, count(*) AS n, round(avg(l_extendedprice / o_totalprice), 6) AS height_ratio_mean, round(stddev_samp(l_extendedprice / o_totalprice), 6) AS height_ratio_std,
    round(avg(l_quantity / o_custkey), 6) AS width_ratio_mean, round(stddev_samp(l_quantity / o_custkey), 6) AS width_ratio_std
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice <> 0 AND o_custkey <> 0 GROUP BY 1""",
)
def size_ratio_summary(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("g"), "l_extendedprice", "l_quantity")
    both = items.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_custkey"), "l_orderkey", "left").dropna(subset=["o_totalprice", "o_custkey"])
    r = geometry.ratios(F.col("l_extendedprice"), F.col("l_quantity"), F.col("o_totalprice"), F.col("o_custkey"))
    both = both.select("g", r["height_ratio"].alias("height_ratio"), r["width_ratio"].alias("width_ratio")).dropna()
    out = profile.ratio_summary(both, "g", ["height_ratio", "width_ratio"])
    return out.withColumns({c: F.round(c, 6) for c in out.columns if "ratio" in c})


_SPOILT = "CASE WHEN event_id % 97 = 0 THEN '-inf'::DOUBLE WHEN event_id % 89 = 0 THEN 'nan'::DOUBLE ELSE value END"


def _spoilt(spark, sf_dir):
    bad = F.when(F.col("event_id") % 97 == 0, F.lit(float("-inf"))).when(F.col("event_id") % 89 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_type", bad.alias("score"), "value")


@register("quality_table", f"SELECT event_type, count(*) AS n, round(avg(CASE WHEN isfinite(s) THEN s END), 6) AS score, round(avg(value), 6) AS value FROM (SELECT *, {_SPOILT} AS s FROM events) GROUP BY 1")
def quality_table(spark, sf_dir):
    out = profile.grouped_means(_spoilt(spark, sf_dir), "event_type", ["score", "value"], scrub=True)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "value")})


@register("raw_means", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS quantity_mean, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1, 2")
def raw_means(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("quantity_mean"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@register(
    "five_number",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1)
    SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS high
    FROM events JOIN q USING (event_type) GROUP BY ALL""",
)
def five_number(spark, sf_dir):
    out = profile.five_numbers(_types(spark, sf_dir), "event_type", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@register(
    "describe_exact",
    """SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25,
    round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS max FROM lineitem""",
)
def describe_exact(spark, sf_dir):
    out = profile.described(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@register(
    "mode_by_group",
    """WITH c AS (SELECT l_returnflag, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, arg_min(v, (-n, v)) AS mode FROM c GROUP BY 1""",
)
def mode_by_group(spark, sf_dir):
    return profile.modes(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber")


@register(
    "param_sweep",
    """SELECT event_type, threshold, count(*) AS n, count(*) FILTER (value > threshold) AS above, round(avg(value) FILTER (value > threshold), 6) AS mean_above
    FROM events, (SELECT unnest([2.0, 10.0, 20.0, 30.0, 50.0])::DOUBLE AS threshold) GROUP BY 1, 2""",
)
def param_sweep(spark, sf_dir):
    grid = spark.createDataFrame([(float(t),) for t in (2, 10, 20, 30, 50)], "threshold double")
    over = F.col("value") > F.col("threshold")
    return profile.sweep(_types(spark, sf_dir), grid).groupBy("event_type", "threshold").agg(F.count("*").alias("n"), F.count_if(over).alias("above"), F.round(F.avg(F.when(over, F.col("value"))), 6).alias("mean_above"))


@register(
    "image_stats",
    """SELECT vec_id, round(list_min(e), 6) AS pixel_min, round(list_max(e), 6) AS pixel_max, round(list_avg(e), 6) AS pixel_mean, round(list_median(e), 6) AS pixel_median, round(list_stddev_pop(e), 6) AS pixel_std
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
)
def image_stats(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for n, c in profile.raster_stats("embedding").items()])
