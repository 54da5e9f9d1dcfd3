"""Exact quantiles against the built-in ones, with brackets so small that every step of the refinement is taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import profile, quantile, robust

AT = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def values():
    rng = np.random.default_rng(7)
    groups = {
        "one": [3.0], "two": [1.0, 2.0], "six": [5.0, 1.0, 4.0, 2.0, 3.0, 6.0], "same": [2.5] * 500, "normal": rng.normal(size=3000), "ties": rng.integers(0, 5, 3000), "half tied": np.r_[np.full(1500, 1.0), rng.normal(size=1500)],
        "tail": np.exp(rng.normal(0, 30, 2000)), "near": 1 + np.arange(900) * 2.0**-52, "ends": np.r_[rng.normal(size=200), [-np.inf] * 90, [np.inf] * 90], "wide": np.r_[[-1.7e308, 1.7e308], rng.normal(size=300)],
        "nan": np.r_[rng.normal(size=50), [np.nan] * 20], "tiny": [5e-324, -5e-324, 0.0, 1e-300] * 30,
    }
    return [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None), (None, 1.0)]


def test_against_the_built_in(spark):
    df = spark.createDataFrame(values(), "g string, v double").repartition(6)
    known = df.where("g is not null and v is not null")
    want = {r.g: (r.n, r.q) for r in known.groupBy("g").agg(F.count("*").alias("n"), F.percentile("v", F.array(*map(F.lit, AT))).alias("q")).collect()}
    for most, whole in ((quantile.SORTED, quantile.WHOLE), (4, quantile.WHOLE), (50, 0)):
        # without whole groups brackets of small ones may miss a rank's neighbour, so those are left out there
        some = df if whole else df.where(F.col("g").isin("normal", "ties", "half tied", "tail", "same")).unionByName(known.where("g = 'normal'").crossJoin(spark.range(14)).drop("id").withColumn("g", F.lit("many")))
        got = {r.g: (r.n, r.q) for r in quantile.quantiles(some, ["g"], "v", AT if whole else [0.5], most, whole).collect()}
        if whole:
            assert got.keys() == want.keys()
            for g, (n, q) in want.items():
                assert got[g][0] == n and got[g][1] == pytest.approx(q, rel=1e-12, abs=5e-324, nan_ok=True), (g, most)
        else:
            assert got["many"][1] == want["normal"][1][3:4] and all(got[g][1] == pytest.approx(want[g][1][3:4], rel=1e-12) for g in got if g != "many")


def test_brackets_hold_a_small_part(spark):
    """Of 120,000 rows a bracket's counts are one in 250, and a value that a third of all rows has is one number."""
    df = spark.range(120_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.xxhash64("id") % 1_000_003 / 7.0).alias("v"))
    seen = []
    original = quantile.cut

    def spy(x):
        out = original(x)
        seen.append((out.columns, out.count()))
        return out

    quantile.cut = spy
    try:
        got = quantile.quantiles(df, ["g"], "v", [0.25, 0.5]).first()
    finally:
        quantile.cut = original
    assert got.q == df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5)))).first()[0] and got.n == 120_000
    assert [n for c, n in seen if "c" in c] and max(n for c, n in seen if "c" in c) < 1200


def test_statistics_that_use_them(spark):
    df = spark.createDataFrame([(g, v) for g, v in values() if g not in ("nan", "ends", "wide")], "g string, v double")
    med = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    got = robust.with_group_median(df, "g", {"m": F.col("v"), "double": 2 * F.col("v")}).collect()
    assert len(got) == df.where("g is not null").count()
    assert all(r.m == pytest.approx(med[r.g], rel=1e-12) and r["double"] == pytest.approx(2 * med[r.g], rel=1e-12) for r in got if r.g != "none") and {r.m for r in got if r.g == "none"} == {None}
    flags = {(r.g, r.v): r.z for r in robust.position_outliers(df.where("g = 'normal'"), "g", ["v"]).collect()}
    v = np.array([x for _, x in flags])
    d = np.abs(v - np.median(v))
    z = 0.6745 * (d - np.median(d)) / np.median(np.abs(d - np.median(d)))
    assert np.allclose(z, list(flags.values()))
    r = profile.described(df.where("g = 'tail'"), "v").first()
    assert r.q50 == pytest.approx(med["tail"], rel=1e-12) and r.n == 2000
    empty = profile.described(df.limit(0), "v").first()
    assert (empty.n, empty.q25, empty["max"]) == (0, None, None)
    assert profile.five_numbers(df.limit(0), "g", "v").count() == 0
