"""Profiles of collections: coverage, exact summaries, quality tables, per-raster statistics."""

from __future__ import annotations

import bisect
import itertools
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import quantile
from brindle.sources.stores import cut


def finite(c: Column) -> Column:
    """Null for infinite and NaN values, so that means pass over them."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def coverage(df: DataFrame, key: str, part: str, parts: list[str]) -> DataFrame:
    """A row a key with 0 or 1 for each named part. The parts are given, so the pivot needs no pass to find them."""
    cols = [F.max((F.col(part) == p).cast("int")).alias(p) for p in parts]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*cols).na.fill(0, parts)


def coverage_summary(df: DataFrame, key: str, part: str, parts: list[str]) -> DataFrame:
    """(part, present, missing, total): keys that have each part, of all keys in any."""
    total = df.select(F.count_distinct(key).alias("total"))
    present = df.where(F.col(part).isin(parts)).groupBy(part).agg(F.count_distinct(key).alias("present"))
    every = df.sparkSession.createDataFrame([(p,) for p in parts], f"{part} string")
    out = every.join(present, part, "left").withColumn("present", F.coalesce("present", F.lit(0)))
    return out.withColumn("total", total.scalar()).withColumn("missing", F.col("total") - F.col("present"))


def grouped_means(df: DataFrame, group: str, columns: list[str], scrub: bool, suffix: str = "") -> DataFrame:
    """Count and mean of each column by group, with or without infinite values; rows without a group go."""
    cols = [F.avg(finite(F.col(c)) if scrub else F.col(c)).alias(c + suffix) for c in columns]
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), *cols)


def ratio_summary(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """n, mean and sample standard deviation of each column."""
    cols = [f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return df.groupBy(group).agg(F.count("*").alias("n"), *cols)


def five_numbers(df: DataFrame, group: str, column: str) -> DataFrame:
    """What a box plot without fliers shows: quartiles, and the outermost points within one and a half interquartile ranges."""
    df = df.where(F.col(group).isNotNull() & F.col(column).isNotNull())
    q = quantile.quantiles(df, [group], column, [0.25, 0.5, 0.75])
    q = cut(q.select(group, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3")))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(column)
    both = quantile.by_group(df, q, [group])
    inside = F.when((v >= F.col("q1") - reach) & (v <= F.col("q3") + reach), v)
    return both.groupBy(group, "q1", "median", "q3").agg(F.min(inside).alias("low"), F.max(inside).alias("high"))


def described(df: DataFrame, column: str) -> DataFrame:
    """Exact count, mean, sample deviation, minimum, quartiles and maximum."""
    out = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    out = out.withColumn("q", quantile.quantiles(df, [], column, [0.25, 0.5, 0.75]).select("q").scalar())
    return out.select("n", "mean", "std", "min", *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("q25", "q50", "q75"))], "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Every value with its count, null among them, the most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column).asc_nulls_last())


def modes(df: DataFrame, group: str, column: str) -> DataFrame:
    """The most frequent value by group, the smallest of several."""
    return df.groupBy(group).agg(F.mode(column, deterministic=True).alias("mode"))


def raster_stats(values: str) -> dict[str, Column]:
    """Minimum, maximum, mean, median and population deviation of an array, in the row: no explode and no shuffle."""
    v = F.transform(values, lambda x: x.cast("double"))
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    s = F.array_sort(v)
    mid = lambda k: F.get(s, k.cast("int"))
    median = (mid(F.floor((n - 1) / 2)) + mid(F.floor(n / 2))) / 2
    var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return {"pixel_min": F.array_min(v), "pixel_max": F.array_max(v), "pixel_mean": mean, "pixel_median": median, "pixel_std": F.sqrt(var)}


def sampled_ids(df: DataFrame, key: str, n: int, seed: int = 0, width: int = 16, split: int = 8) -> list:
    """The seeded sample that Python's random gives on the sorted distinct integer ids.

    random chooses places, which need the number of ids alone. Ids are counted by blocks of equal width; those that hold a chosen place are split
    into 2^split narrower ones and counted again, down to 2^width ids. So n * 2^split counts at most come to the driver at a time, however many ids there are and however far apart.
    """
    ids = cut(df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id")).distinct())
    total, low, high = ids.agg(F.count("*"), F.min("id"), F.max("id")).first()
    wanted = [(None, place) for place in random.Random(seed).sample(range(total), min(n, total))]
    if not wanted:
        return []
    shift = next(k for k in range(64) if (high >> k) - (low >> k) < 1 << split)
    wanted = _within(ids, wanted, None, shift)
    while shift > width:
        narrower = max(width, shift - split)
        wanted = _within(ids, wanted, shift, narrower)
        shift = narrower
    block = F.shiftright("id", shift)
    order = Window.partitionBy("b").orderBy("id")
    rows = ids.where(block.isin([b for b, _ in wanted])).select("id", block.alias("b")).withColumn("r", F.row_number().over(order) - 1)
    picks = df.sparkSession.createDataFrame(wanted, "b bigint, r int")
    found = {(x["b"], x["r"]): x["id"] for x in rows.join(F.broadcast(picks), ["b", "r"]).collect()}
    return [found[w] for w in wanted]


def _within(ids: DataFrame, wanted: list[tuple], wide: int | None, narrow: int) -> list[tuple]:
    """(block, place in it) for blocks of 2^narrow ids, from the same for blocks of 2^wide ids (None: one block of all ids)."""
    outer = F.lit(None).cast("bigint") if wide is None else F.shiftright("id", wide)
    some = ids if wide is None else ids.where(outer.isin([b for b, _ in wanted]))
    counts = some.groupBy(outer.alias("o"), F.shiftright("id", narrow).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
    inner = {o: list(g) for o, g in itertools.groupby(counts, lambda r: r["o"])}
    ends = {o: list(itertools.accumulate(r["n"] for r in g)) for o, g in inner.items()}
    out = []
    for o, place in wanted:
        k = bisect.bisect_right(ends[o], place)
        out.append((inner[o][k]["b"], place - (ends[o][k - 1] if k else 0)))
    return out


def sampled_row(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """(group, key): one row a group, the same for a seed: the key with the least hash. Each task keeps one row a group, and nothing is sorted."""
    at = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key))
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min_by(key, at).alias(key))


def sweep(df: DataFrame, params: DataFrame) -> DataFrame:
    """Every row with every parameter; params is a table of settings, a handful of rows."""
    return df.join(F.broadcast(params), how="cross")
