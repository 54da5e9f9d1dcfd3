"""Exact quantiles of groups of any size in bounded memory: brackets, counts of ties, and counting refinement where a bracket is still large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.stores import cut

#: A bracket reaches this part of a group's rows to either side of the rank. Approximate percentiles err by a fifth of that at most.
MARGIN = 0.002
ACCURACY = round(5 / MARGIN)
#: Groups of fewer rows are their own bracket, as a bracket has to hold the rank's neighbour too.
WHOLE = round(20 / MARGIN)
#: Different values of a bracket that are put in order in one task; larger ones are counted into bins of their range and narrowed first.
SORTED = 100_000
BINS = 4096
#: A table of so many groups at most goes to every task.
FEW = 100_000


def by_group(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with groups, a table from cut() with one row a group, without moving the rows where there are few groups.

    Spark takes such a table to be as large as what it was made from, and so would shuffle the rows by group: a task would get all rows of the largest one.
    """
    return rows.join(F.broadcast(groups) if groups.count() <= FEW else groups, on, how)


def quantiles(df: DataFrame, group: list[str], value: str, at: list[float], most: int = SORTED, whole: int = WHOLE) -> DataFrame:
    """(group, n, q): of each group the number of values and an array of its quantiles, exact, interpolated between neighbours.

    Approximate percentiles bracket every rank. One pass then counts what lies below each bracket and how often each different value inside occurs, before anything is shuffled, so ties are numbers and
    about one row in 250 moves. A bracket of more than `most` different values is split into bins of equal width, whose counts tell in which one the rank lies, until it is small enough to be
    sorted; every split separates its least and greatest value, so that ends whatever the values are. No task holds more than `most` values of a group.
    Null values and rows with a null group take no part; NaN is above all numbers.
    """
    if not group:
        return quantiles(df.select(F.lit(0).alias("_all"), value), ["_all"], value, at, most, whole).drop("_all")
    known = reduce(lambda a, c: a & F.col(c).isNotNull(), group, F.col(value).isNotNull())
    rows = df.where(known).select(*group, F.col(value).cast("double").alias("_v"))
    ends = [x for p in at for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    edges = rows.groupBy(*group).agg(F.count("*").alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), ACCURACY).alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    edges = cut(edges)
    joined = by_group(rows, edges, group)
    small = F.col("n") < whole

    def entry(k: int) -> Column:
        low = F.col("_min") if at[k] <= MARGIN else F.when(small, F.col("_min")).otherwise(F.get("_e", F.lit(2 * k)))
        high = F.col("_max") if at[k] >= 1 - MARGIN else F.when(small, F.col("_max")).otherwise(F.get("_e", F.lit(2 * k + 1)))
        v = F.col("_v")
        return F.when(v < low, F.struct(F.lit(k).alias("k"), F.lit(None).cast("double").alias("v"))).when(v <= high, F.struct(F.lit(k).alias("k"), v.alias("v")))

    each = joined.select(*group, F.explode(F.array_compact(F.array(*map(entry, range(len(at)))))).alias("_x"))
    # a null value stands for all that lies below the bracket
    counts = cut(each.groupBy(*group, F.col("_x.k").alias("k"), F.col("_x.v").alias("v")).agg(F.count("*").alias("c")))
    # a quantile lies between two ranks, each found by itself: their values may be far apart
    wanted = [(k, side) for k in range(len(at)) for side in (0, 1)]
    place = lambda k: F.lit(float(at[k])) * (F.col("n") - 1)
    rank = lambda k, side: (F.ceil if side else F.floor)(place(k))
    ranks = edges.select(*group, F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), rank(k, side).alias("r")) for k, side in wanted])))
    counts = counts.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    keys = [*group, "k", "side"]
    while (counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > most:
        counts = cut(_narrowed(counts, ranks, keys))
    ordered = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("c").over(ordered), F.lit(0))).join(ranks, keys)
    found = placed.where((F.col("r") >= F.col("_before")) & (F.col("r") < F.col("_before") + F.col("c"))).join(edges.select(*group, "n"), group)
    value_at = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("v")))

    def between(k: int) -> Column:
        low, high = value_at(k, 0), value_at(k, 1)
        return F.when(low == high, low).otherwise(low + (high - low) * (F.max(place(k)) - F.max(F.floor(place(k)))))

    return found.groupBy(*group, "n").agg(F.array(*map(between, range(len(at)))).alias("q"))


def _narrowed(counts: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """The same counts with only those values left that share a bin with the wanted rank; what lies below them joins the null value."""
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    span = counts.groupBy(*keys).agg(F.min(F.when(finite, v)).alias("_lo"), F.max(F.when(finite, v)).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    # by halves where the width of a bracket is beyond a double
    part = F.when(hi - lo < float("inf"), F.try_divide(v - lo, hi - lo)).otherwise(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2))
    inside = F.when(lo == hi, F.lit(0)).otherwise(F.least(F.floor(part * BINS), F.lit(BINS - 1)))
    bin_ = F.when(v.isNull(), -2).when(F.isnan(v), BINS + 1).when(v == float("inf"), BINS).when(v == float("-inf"), -1).otherwise(inside)
    binned = counts.join(span, keys).withColumn("_bin", bin_.cast("int"))
    order = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*keys, "_bin").agg(F.sum("c").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0))).join(ranks, keys)
    wanted = bins.where((F.col("_before") <= F.col("r")) & (F.col("_before") + F.col("_c") > F.col("r"))).select(*keys, "_bin", "_before")
    left = binned.join(wanted.drop("_before"), [*keys, "_bin"], "left_semi").select(*keys, "v", "c")
    below = wanted.groupBy(*keys).agg(F.min("_before").alias("c")).where("c > 0").select(*keys, F.lit(None).cast("double").alias("v"), "c")
    return left.unionByName(below)


def medians(df: DataFrame, group: list[str], values: dict[str, Column]) -> DataFrame:
    """(group, a median by name) for each group; all of them in the same passes, once, however often the result is used. Groups without any value are absent."""
    each = df.select(*group, F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), c.cast("double").alias("_value")) for n, c in values.items()])))
    q = quantiles(each, [*group, "_name"], "_value", [0.5])
    return cut(q.groupBy(*group).agg(*[F.max(F.when(F.col("_name") == n, F.get("q", F.lit(0)))).alias(n) for n in values]))
