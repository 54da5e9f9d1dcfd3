"""Isolation forests: the same scores however rows are dealt, many groups, large groups in parts, copies, nulls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import forest


def test_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(forest, "PART", 700)  # several parts a group
    rng = np.random.default_rng(0)
    rows = [(k, "ab"[k % 2], *map(float, rng.normal(size=2))) for k in range(3000)] + [(5000, "a", 12.0, -12.0), (5001, "a", None, 1.0), (5002, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    found = []
    for parts in (1, 4, 32):
        out = forest.anomalies(df.repartition(parts, F.rand(parts)), "g", ["x", "y"], pool=400)
        found.append({r.id: (r.anomaly_score, r.outlier) for r in out.collect()})
        assert out.columns == [*df.columns, "anomaly_score", "outlier"] and len(found[-1]) == len(rows)
    assert found[0] == found[1] == found[2]
    got = found[0]
    assert got[5001] == got[5002] == (None, None)
    assert max((k for k in got if got[k][0] is not None), key=lambda k: got[k][0]) == 5000
    a = [v for k, v in got.items() if v[0] is not None and (k % 2 == 0)]
    assert sum(o for _, o in a) == pytest.approx(0.05 * len(a), abs=2)
    assert sorted(v[0] for v in a if v[1])[0] > sorted(v[0] for v in a if not v[1])[-1]


def test_many_groups(spark):
    df = spark.range(6000).select(F.pmod("id", F.lit(2000)).cast("int").alias("g"), "id", (F.xxhash64("id") % 100).cast("double").alias("x"))
    out = forest.anomalies(df, "g", ["x"]).groupBy("g").agg(F.count("anomaly_score").alias("n")).groupBy("n").count().collect()
    assert [(r.n, r["count"]) for r in out] == [(3, 2000)]


def test_copies_are_one_row_with_a_number(spark):
    df = spark.range(30_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.xxhash64("id") % 1000 / 1000.0).alias("x")).withColumn("k", F.xxhash64("x"))
    drawn = forest.drawn(df, "g", ["x"], ["k"], 30_000, 0)
    assert drawn.count() < 2100 and drawn.agg(F.sum("_times")).first()[0] == 30_000 and drawn.agg(F.max("_times")).first()[0] >= 10_000
    x = np.array([[0.0], [1.0], [50.0]])
    s = forest.scores(forest.fit(x, times=np.array([500, 490, 1])), x)
    assert s.argmax() == 2 and forest.anomalies(df.limit(0), "g", ["x"]).count() == 0
