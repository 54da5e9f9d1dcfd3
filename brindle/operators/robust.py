"""Robust per-group statistics: medians, MAD, robust z scores, typical offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import quantile

#: 0.6745 makes the MAD comparable with a standard deviation; 3.5 is the customary cut.
MAD_SCALE, Z_CUT = 0.6745, 3.5


def with_group_median(df: DataFrame, group: str, values: dict[str, Column]) -> DataFrame:
    """Adds one exact median per group and name; rows without a group are dropped, as grouping by null would keep them.

    Medians are selected in bounded memory (see quantile). They have one row a group and go to every task where there are few; no window or join gathers a group.
    """
    df = df.where(F.col(group).isNotNull())
    return quantile.by_group(df, quantile.medians(df, [group], values), [group], "left")


def bracketed_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median), exact, in memory that doesn't grow with a group."""
    return quantile.medians(df, [group], {"median": F.col(value)})


def robust_z(dist: str, med: str, mad: str) -> Column:
    """0 where the MAD is 0, so that a constant group has no outliers."""
    return F.when(F.col(mad) == 0, F.lit(0.0)).otherwise(F.lit(MAD_SCALE) * (F.col(dist) - F.col(med)) / F.col(mad))


def position_outliers(df: DataFrame, group: str, axes: list[str], cut: float = Z_CUT) -> DataFrame:
    """Distance of each row from its group's median point, its robust z, and a one-sided flag (z > cut)."""
    df = with_group_median(df, group, {f"_m_{a}": F.col(a) for a in axes})
    if len(axes) == 1:
        dist = F.abs(F.col(axes[0]) - F.col(f"_m_{axes[0]}"))
    else:
        dist = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(a) - F.col(f"_m_{a}"), 2) for a in axes]))
    df = df.withColumn("dist", dist).drop(*[f"_m_{a}" for a in axes])
    df = with_group_median(df, group, {"_dmed": F.col("dist")})
    df = with_group_median(df, group, {"_mad": F.abs(F.col("dist") - F.col("_dmed"))})
    return df.withColumn("z", robust_z("dist", "_dmed", "_mad")).withColumn("outlier", F.col("z") > cut).drop("_dmed", "_mad")


def outlier_summary(df: DataFrame, group: str, flag: str = "outlier") -> DataFrame:
    """(group, n, outliers, outlier_fraction)."""
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("outliers"))
    return out.withColumn("outlier_fraction", F.col("outliers") / F.col("n"))


def outliers_only(df: DataFrame, group: str) -> DataFrame:
    """Flagged rows, by group, the largest z first."""
    return df.where("outlier").orderBy(F.col(group).asc(), F.col("z").desc())


def offsets(df: DataFrame, reference: DataFrame, keys: list[str], axes: dict[str, str]) -> DataFrame:
    """Adds offset_<axis> = axis - reference axis; rows without a reference go."""
    both = df.join(reference, keys)
    return both.withColumns({f"offset_{a}": F.col(a) - F.col(r) for a, r in axes.items()})


def typical_offset(df: DataFrame, group: str, axes: list[str]) -> DataFrame:
    """Per group: n, the median of each axis and its spread (median absolute deviation)."""
    df = with_group_median(df, group, {f"typical_{a}": F.col(a) for a in axes})
    spread = quantile.medians(df, [group], {f"{a}_spread": F.abs(F.col(a) - F.col(f"typical_{a}")) for a in axes})
    keep = [F.first(f"typical_{a}").alias(f"typical_{a}") for a in axes]
    return df.groupBy(group).agg(F.count("*").alias("n"), *keep).join(spread, group, "left")
