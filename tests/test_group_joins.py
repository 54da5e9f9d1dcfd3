"""Joins of rows with a few groups' figures don't move the rows by group, whatever Spark takes the sizes to be."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from brindle.operators import forest, profile, robust


@pytest.fixture
def no_guesses(spark):
    """Broadcasts only where the code asks for them, as with tables that Spark takes to be large."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def rows(spark):
    return spark.range(2000).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("g"), (F.xxhash64("id") % 1000).cast("double").alias("x"))


@pytest.mark.parametrize("few", [1, 100])
def test_medians_reach_the_rows(spark, no_guesses, monkeypatch, few):
    monkeypatch.setattr(robust.quantile, "FEW", few)
    out = robust.position_outliers(rows(spark), "g", ["x"])
    assert ("SortMergeJoin" in plan(out)) == (few == 1)
    assert out.count() == 2000
    boxes = profile.five_numbers(rows(spark), "g", "x")
    assert ("SortMergeJoin" in plan(boxes)) == (few == 1) and boxes.count() == 2


def test_forests_reach_the_rows(spark, no_guesses):
    df = rows(spark)
    assert "SortMergeJoin" not in plan(forest.drawn(df, "g", ["x"], ["id"], 500, 0))
    out = forest.anomalies(df, "g", ["x"], pool=300)
    assert "SortMergeJoin" not in plan(out) and out.columns == [*df.columns, "anomaly_score", "outlier"] and out.count() == 2000
