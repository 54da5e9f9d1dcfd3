"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from numbers import Rational

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import documents, kept, ranked, written

#: Documents in a block; the longest period, in slots, after which a schedule repeats.
BLOCK, PERIOD = 16, 1 << 20
OTHER = "<other>"
#: One large source is held at a tenth, nineteen like ones share the rest; whatever else there is gets a hundredth.
TARGETS = {"src0": Fraction(1, 10), **{f"src{k}": Fraction(89, 1900) for k in range(1, 20)}, OTHER: Fraction(1, 100)}


def shares(weights: dict[str, Rational | float], period: int = PERIOD) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights; a float counts as the decimal number it prints as.

    Only where their sum would exceed the period, thus for weights without a common denominator up to it, are they rounded to parts of
    the period, one at least each.
    """
    exact = {n: Fraction(w) if isinstance(w, Rational) else Fraction(str(w)) for n, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be above 0")
    common = math.lcm(*(w.denominator for w in exact.values()))
    whole = _least({n: int(w * common) for n, w in exact.items()})
    total = sum(whole.values())
    return whole if total <= period else _least({n: max(1, round(Fraction(v * period, total))) for n, v in whole.items()})


def _least(whole: dict[str, int]) -> dict[str, int]:
    g = math.gcd(*whole.values())
    return {n: v // g for n, v in whole.items()}


def schedule(quota: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period, which has as many slots as the shares add up to, ascending.

    Block k (from 1) of a source with n of the period's P slots may run from floor((k - 1) P / n) and is due by ceil(k P / n). Of the
    released blocks the one due first runs. As the shares fill the period, every block meets its window, so
    after any number of slots each source is less than one block off its exact share; the next period is the same.
    """
    period = sum(quota.values())
    waiting = [(0, -(-period // n), name, 1) for name, n in sorted(quota.items())]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {name: [] for name in quota}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, due, name, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, name, k))
        due, name, k = heapq.heappop(ready)
        out[name].append(t)
        n = quota[name]
        if k < n:
            heapq.heappush(waiting, (k * period // n, -(-(k + 1) * period // n), name, k + 1))
    return out


@dataclass
class Stretch:
    """Blocks of one source from `first` on, at `base` plus their slots; a stretch ends when some source runs out."""

    first: int
    base: int
    slots: np.ndarray = field(repr=False)
    period: int

    def at(self, block: np.ndarray) -> np.ndarray:
        k = block - self.first
        n = len(self.slots)
        return self.base + k // n * self.period + self.slots[k % n]


def stretches(blocks: dict[str, int], weights: dict[str, Rational | float], period: int = PERIOD) -> dict[str, list[Stretch]]:
    """When each source's blocks run. Whenever one runs out the others share its weight, in exact proportion, so all blocks run.

    The work depends on the weights' denominators and on how many sources there are, not on the number of blocks.
    """
    whole = shares({n: weights[n] for n, b in blocks.items() if b > 0}, period) if any(b > 0 for b in blocks.values()) else {}
    left = {n: b for n, b in blocks.items() if b > 0}
    done = dict.fromkeys(left, 0)
    out: dict[str, list[Stretch]] = {n: [] for n in left}
    base = 0
    while left:
        now = _least({n: whole[n] for n in left})
        period = sum(now.values())
        slots = {n: np.array(s) for n, s in schedule(now).items()}
        for n in left:
            out[n].append(Stretch(done[n], base, slots[n], period))
        length = min((left[n] - 1) // len(s) * period + int(s[(left[n] - 1) % len(s)]) + 1 for n, s in slots.items())
        for n, s in slots.items():
            ran = length // period * len(s) + int(np.searchsorted(s, length % period))
            done[n] += ran
            left[n] -= ran
        left = {n: b for n, b in left.items() if b > 0}
        base += length
    return out


def mixed(
    docs: DataFrame, weights: dict[str, Rational | float] = TARGETS, block: int = BLOCK, period: int = PERIOD, id_col: str = "doc_id", source_col: str = "source", seed: int = 7
) -> DataFrame:
    """(id, source_group, block, slot, position): a place for every document such that, up to any slot of a stretch, each source has its exact target share
    less than one block off. A stretch ends when a source has run out; the others then go on in the same proportion.

    Sources without a weight, null among them, are one group, as many groups as there are weights at most. Within a source the order is by a hash of the id, ties
    by id. Positions are gapless from 0. Repeated rows get a place each. An empty table gives an empty result; without weights all sources are one group. Only one count a group reaches the driver.
    """
    weights = {OTHER: min(weights.values(), default=1), **weights}
    named = F.col(source_col).isin([n for n in weights if n != OTHER])
    rows = docs.select(F.col(id_col).alias("id"), F.when(named, F.col(source_col)).otherwise(F.lit(OTHER)).alias("source_group"))
    rows = ranked(rows.withColumn("_h", F.xxhash64(F.lit(seed), "id")), ["source_group"], ["_h", "id"], "mixranks").drop("_h")
    sizes = {r["source_group"]: r["n"] for r in rows.groupBy("source_group").agg(F.count("*").alias("n")).collect()}
    plan = stretches({n: -(-c // block) for n, c in sizes.items()}, weights, period)
    firsts = {n: np.array([s.first for s in parts]) for n, parts in plan.items()}
    # blocks that aren't full end their source; slots after them begin so many documents earlier
    short = sorted((int(_slot(plan[n], firsts[n], np.array([-(-c // block) - 1]))[0]), -c % block) for n, c in sizes.items())
    ends, missing = np.array([s for s, _ in short]), np.cumsum([0, *[m for _, m in short]])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b.pop("_rank").to_numpy(np.int64)
            blocks = rank // block
            slot = np.zeros(len(b), np.int64)
            for name, at in b.groupby("source_group", sort=False).indices.items():
                slot[at] = _slot(plan[name], firsts[name], blocks[at])
            b["block"], b["slot"] = blocks, slot
            b["position"] = slot * block - missing[np.searchsorted(ends, slot)] + rank % block
            yield b

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(place, f"id {kind}, source_group string, block long, slot long, position long")


def _slot(parts: list[Stretch], firsts: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    which = np.searchsorted(firsts, blocks, side="right") - 1
    out = np.zeros(len(blocks), np.int64)
    for k in np.unique(which):
        on = which == k
        out[on] = parts[k].at(blocks[on])
    return out


def in_mixed_order(docs: DataFrame, weights: dict[str, Rational | float] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs, all rows and columns, laid out by position: partitions are ranges of it and sorted, so files written from here read in the mixed order.

    Rows that share an id take the first of its positions.
    """
    spark, since = docs.sparkSession, written()
    place = mixed(docs, TARGETS if weights is None else weights, id_col=id_col, source_col=source_col).groupBy(F.col("id").alias("_id")).agg(F.min("position").alias("_position"))
    place = kept(place, "places", since)
    parts, n = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, docs.count())
    both = docs.join(place, docs[id_col].eqNullSafe(place["_id"]), "left")
    # positions run from 0 without a gap, so their ranges are known and the texts aren't sampled for them
    dealt = both.repartitionById(parts, F.least(F.lit(parts - 1), F.floor(F.col("_position") * parts / n)).cast("int"))
    return dealt.sortWithinPartitions("_position").select(*[docs[c] for c in docs.columns])


def stored_order(docs: DataFrame) -> Column | None:
    """A text that sorts rows as the files they are read from hold them, by file name and row; None where docs isn't a plain scan of Parquet files.

    A scan deals splits by size, so only this gives the order that in_mixed_order() wrote.
    """
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return None
    # numbers of tasks may outgrow the five digits that names pad them to
    name = F.col("_metadata.file_name")
    number = F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 10, "0")
    return F.concat_ws("/", number, name, F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))


def op5_pfair_mixing(spark, sf_dir) -> DataFrame:
    out = mixed(documents(spark, sf_dir).select("doc_id", "source"))
    return out.withColumnRenamed("id", "doc_id")
