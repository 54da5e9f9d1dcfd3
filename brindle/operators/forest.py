"""Isolation forest: fitted on bounded samples, scored where the rows are."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brindle.operators import quantile
from brindle.sources.stores import cut

TREES, SAMPLE = 100, 256
#: Rows of a group that a task scores at a time.
PART = 100_000


def _mean_path(n: float) -> float:
    """Mean length of an unsuccessful search in a binary tree of n keys."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """All trees' nodes in one set of arrays: feature and cut, both followers (a leaf follows itself) and the path length where a row ends."""

    feature: np.ndarray
    cut: np.ndarray
    follow: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    depth: int
    norm: float


def fit(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 0, times: np.ndarray | None = None) -> Forest:
    """Trees on random samples of x, whose rows may stand for several equal ones each."""
    rng = np.random.default_rng(seed)
    often = times is not None and times.max() > 1
    n = min(sample, int(times.sum()) if often else len(x))
    picked = (lambda: rng.choice(len(x), n, p=times / times.sum())) if often else (lambda: rng.choice(len(x), n, replace=False))
    depth = max(1, math.ceil(math.log2(max(2, n))))
    nodes: list[list] = []  # feature, cut, below, above, length
    roots = []
    for _ in range(trees):
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, 0, 0.0])
        open_ = [(roots[-1], x[picked()], 0)]
        while open_:
            at, rows, level = open_.pop()
            wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and level < depth else []
            if not len(wide):
                nodes[at] = [0, 0.0, at, at, level + _mean_path(len(rows))]
                continue
            f = int(rng.choice(wide))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            on = rows[:, f] < cut
            nodes[at] = [f, cut, len(nodes), len(nodes) + 1, 0.0]
            open_ += [(len(nodes), rows[on], level + 1), (len(nodes) + 1, rows[~on], level + 1)]
            nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
    columns = list(zip(*nodes))
    follow = np.array(columns[2:4], np.int32).T.ravel()
    return Forest(np.array(columns[0], np.int32), np.array(columns[1]), follow, np.array(columns[4]), np.array(roots, np.int32), depth, _mean_path(n) or 1.0)


def scores(model: Forest, x: np.ndarray, together: int = 512) -> np.ndarray:
    """Between 0 and 1; the larger, the easier a row is to set apart. All trees are walked a level at a time for `together` rows."""
    out = np.empty(len(x))
    for a in range(0, len(x), together):
        part = x[a : a + together]
        at = np.repeat(model.roots[:, None], len(part), 1)
        row = np.arange(len(part))
        for _ in range(model.depth):
            at = model.follow[2 * at + (part[row, model.feature[at]] >= model.cut[at])]
        out[a : a + together] = 2 ** -(model.length[at].mean(0) / model.norm)
    return out


def drawn(rows: DataFrame, group: str, features: list[str], key: list[str], pool: int, seed: int) -> DataFrame:
    """About `pool` rows of each group, or all of a smaller one: those whose key hashes below pool / n. Which ones depends on the rows alone, not on how they are dealt.

    Equal rows become one with their number before they are shuffled.
    """
    sizes = cut(rows.groupBy(group).agg((F.lit(float(pool)) / F.count("*")).alias("_share")))
    at = F.xxhash64(F.lit(seed), *key)
    place = F.shiftrightunsigned(at, 11) / float(1 << 53)
    some = quantile.by_group(rows, sizes, [group]).withColumn("_place", place).where(F.col("_place") < F.col("_share"))
    return some.groupBy(group, *features, "_place").agg(F.count("*").alias("_times"))


def models(rows: DataFrame, group: str, features: list[str], key: list[str], pool: int, seed: int) -> DataFrame:
    """(group, n, model): a forest of each group, fitted by a task on its drawn rows in the order of their hashes, and the group's size."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_place", *features], kind="stable")
        made = fit(part[features].to_numpy(float), seed=seed, times=part["_times"].to_numpy())
        return pd.DataFrame({group: [part[group].iloc[0]], "model": [pickle.dumps(made)]})

    kind = rows.schema[group].dataType.simpleString()
    fitted = drawn(rows, group, features, key, pool, seed).groupBy(group).applyInPandas(one, f"`{group}` {kind}, model binary")
    return cut(fitted.join(rows.groupBy(group).agg(F.count("*").alias("n")), group))


def anomalies(df: DataFrame, group: str, features: list[str], contamination: float = 0.05, seed: int = 0, pool: int = 20_000, key: list[str] | None = None) -> DataFrame:
    """Adds anomaly_score and outlier (the top `contamination` of each group), one model a group.

    A model needs TREES samples of SAMPLE rows, so it is fitted on about `pool` rows of a group, drawn by a hash of the key columns (all columns by default; rows that are equal in them
    are drawn together), or on all of a smaller one. All rows are scored and the cut is the exact percentile over all of them. Models are fitted and kept by executors and meet
    their group's rows in parts of PART rows, so neither many groups nor a large one are too much for a task or the driver, and scores don't depend on the partitions.
    Rows with a null feature or group get null in both.
    """
    ok = F.lit(True)
    for f in [group, *features]:
        ok = ok & F.col(f).isNotNull()
    key = key or [c for c, kind in df.dtypes if not kind.startswith("map")]
    inputs = [f"_f{k}" for k in range(len(features))]
    known = df.where(ok).select(F.col(group).alias("_g"), *[F.col(f).cast("double").alias(c) for f, c in zip(features, inputs)], F.xxhash64(*key).alias("_key"))
    fitted = models(known, "_g", inputs, ["_key"], pool, seed)
    parts = (F.floor(F.col("n") / PART) + 1).cast("int")
    # a part for each PART rows of a group; its model goes along with every part
    sized = quantile.by_group(df.where(ok), fitted.select(F.col("_g").alias(group), parts.alias("_parts")), [group])
    rows = sized.select(*df.columns, "_parts").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")).drop("_parts")
    each = fitted.select("_g", "model", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))

    def score(keys: tuple, part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if len(part):
            made = pickle.loads(model["model"].iloc[0])
            part["anomaly_score"] = np.round(scores(made, part[features].to_numpy(float)), 12)
        else:
            part["anomaly_score"] = np.zeros(0)
        return part.drop(columns="_part")

    schema = StructType([*df.schema.fields, StructField("anomaly_score", DoubleType())])
    scored = cut(rows.groupBy(group, "_part").cogroup(each.groupBy("_g", "_part")).applyInPandas(score, schema))
    limit = cut(quantile.quantiles(scored, [group], "anomaly_score", [1 - contamination]).select(group, F.get("q", F.lit(0)).alias("_cut")))
    out = quantile.by_group(scored, limit, [group], "left").withColumn("outlier", F.col("anomaly_score") > F.col("_cut"))
    out = out.select(*df.columns, "anomaly_score", "outlier")
    rest = df.where(~F.coalesce(ok, F.lit(False))).withColumns({"anomaly_score": F.lit(None).cast("double"), "outlier": F.lit(None).cast("boolean")})
    return out.unionByName(rest)


def likely_corrupt(outlier: str = "outlier", ratio: str = "largest_cc_aspect_ratio", most: float = 1.5):
    return F.col(outlier) & (F.col(ratio) < most)
