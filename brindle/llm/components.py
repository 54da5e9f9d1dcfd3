"""Connected components of a table of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import saved

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links (a, b long) to (node, component): the smallest node reachable, for nodes that have a link.

    Large-star then small-star rounds until nothing changes; each is one minimum by key (summed up
    before the shuffle) and one equi-join. Every round is written to the shared folder. Self-links and repeated
    links are allowed; without any link the result is empty.
    """
    edges = saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    was = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = saved(large, "large")
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(floor.select("u", F.col("m").alias("v")))
        edges = saved(small.distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            ).groupBy("node").agg(F.min("component").alias("component"))
        was = now
    raise RuntimeError("components did not settle")
