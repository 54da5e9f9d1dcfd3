"""Hard negatives: angles to reference directions bound every inner product, only rows whose bounds reach a window are scored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import saved

#: Components are scaled by this and rounded down, so scores are integers.
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is between these hundredths of its positive's.
LOW, HIGH = 80, 100
#: Share of the squared cosines that the reference directions hold, on the first SAMPLE rows by a hash of the id. Any directions give the same result; these give narrow bounds.
SHARE, SAMPLE = 0.95, 2048
#: Anchors that are compared with all rows in one pass: what every task is sent, and the driver holds.
ANCHORS = 2048
#: Anchors and rows whose bounds are worked out together.
TILE = 512
#: Rounding of norms, angles and cosines stays far below this part of the product of the norms; one more unit is allowed for.
SLACK = 1e-6
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def scaled(rows: DataFrame, id_col: str, label: Column, vector: str) -> DataFrame:
    """(id, label, v): integer components; without rows that lack an id, a label or a vector, or hold a null or non-finite component. Rows that are repeated count once."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & sound)
    ints = F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("bigint"))
    return some.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), ints.alias("v")).distinct()


def leading(rows: DataFrame, n: int) -> DataFrame:
    """Of rows with the same label and vector the n with the smallest ids. They tie with the rest everywhere, so no list of n - 1 others holds any further one."""
    alike = Window.partitionBy("label", F.xxhash64("v"), "v").orderBy("id")
    return rows.withColumn("_r", F.row_number().over(alike)).where(F.col("_r") <= n).drop("_r")


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of int64, shorter ones filled up with 0."""
    size, flat = pc.list_value_length(vectors).to_numpy(), vectors.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def directions(v: np.ndarray, share: float = SHARE) -> np.ndarray:
    """Orthogonal unit vectors, those first along which the vectors' cosines are largest: as many as hold `share` of their squares."""
    x = v.astype(float)
    x = x[np.abs(x).max(1, initial=0) > 0]
    if not len(x):
        return np.zeros((0, v.shape[1]))
    _, size, axes = np.linalg.svd(x / np.linalg.norm(x, axis=1)[:, None], full_matrices=False)
    return axes[: 1 + int(np.searchsorted(np.cumsum(size**2), share * (size**2).sum()))]


def with_angles(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Adds norm, and angles: to each reference direction. A zero vector, whose scores are all 0, counts as upright to all."""
    width = references.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), width).astype(float)
            norm = np.linalg.norm(x, axis=1)
            angles = np.arccos(np.clip(x @ references.T / np.where(norm > 0, norm, 1)[:, None], -1, 1))
            ends = pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(references))
            out = [*b.columns, pa.array(norm), pa.ListArray.from_arrays(ends, pa.array(angles.ravel()))]
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names, "norm", "angles"])

    return rows.mapInArrow(work, "id bigint, label bigint, v array<bigint>, norm double, angles array<double>")


@dataclass
class Side:
    """Vectors with what is stored about them."""

    id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    norm: np.ndarray
    angles: np.ndarray

    @staticmethod
    def of(b: pa.RecordBatch, width: int, references: int) -> Side:
        angles = b.column("angles").flatten().to_numpy().reshape(len(b), references)
        return Side(b.column("id").to_numpy(), b.column("label").to_numpy(), matrix(b.column("v"), width), b.column("norm").to_numpy(), angles)

    def __getitem__(self, k: slice) -> Side:
        return Side(self.id[k], self.label[k], self.v[k], self.norm[k], self.angles[k])

    def __len__(self) -> int:
        return len(self.id)


def bounds(a: Side, x: Side) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that each inner product of a and x can be.

    With angles p and q to one direction, the angle between two vectors lies between |p - q| and p + q (or a full turn less that), so its cosine is
    cos p cos q - sin p sin q at least and cos p cos q + sin p sin q at most. What lies across the first direction is bounded by the next one in the same way, and so on: the products of cosines add
    up, and only the parts across all directions stay unknown, their lengths being the root of 1 less the squared cosines.
    """
    cos_a, cos_x = np.cos(a.angles), np.cos(x.angles)
    known = cos_a @ cos_x.T
    across = np.outer(*(np.sqrt(np.maximum(0, 1 - (c**2).sum(1))) for c in (cos_a, cos_x)))
    norms = np.outer(a.norm, x.norm)
    slack = SLACK * norms + 1
    low, high = (known - across) * norms - slack, (known + across) * norms + slack
    return np.clip(low, float(_LEAST), float(_MOST)), np.clip(high, float(_LEAST), float(_MOST))


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products row by row; one beyond a long counts as the nearest long."""
    most = int(np.abs(a.astype(float)).max(initial=0)) * int(np.abs(x.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 62:
        return np.einsum("ij,ij->i", a, x)
    return np.array([min(_MOST, max(_LEAST, sum(int(p) * int(q) for p, q in zip(r, s)))) for r, s in zip(a, x)], np.int64)


class Lists:
    """The first `top` rows of each list so far, by score downwards, then by id. A list may have a ceiling and a floor."""

    def __init__(self, lists: int, top: int):
        self.top, self.least = top, np.full(lists, _LEAST, np.int64)
        self.list, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, list_: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        on = score >= self.least[list_]
        list_, id_, score = np.append(self.list, list_[on]), np.append(self.id, id_[on]), np.append(self.score, score[on])
        order = np.lexsort((id_, ~score, list_))  # ~score goes down as score goes up, without overflow
        list_, id_, score = list_[order], id_[order], score[order]
        rank = np.arange(len(list_)) - np.searchsorted(list_, list_)
        keep, last = rank < self.top, rank == self.top - 1
        self.least[list_[last]] = score[last]
        self.list, self.id, self.score = list_[keep], id_[keep], score[keep]


def _tiles(a: Side, x: Side) -> Iterator[tuple[slice, slice, Side, Side]]:
    for i in range(0, len(a), TILE):
        for j in range(0, len(x), TILE):
            yield slice(i, i + TILE), slice(j, j + TILE), a[i : i + TILE], x[j : j + TILE]


def nearest_alike(found: Lists, anchors: Side, x: Side) -> int:
    """Adds x's rows to the list of each anchor with their label; gives the number of products worked out."""
    scored = 0
    for i, _, a, b in _tiles(anchors, x):
        on = (a.label[:, None] == b.label) & (a.id[:, None] != b.id)
        if not on.any():
            continue
        low, high = bounds(a, b)
        least = found.least[i].astype(float)
        if len(b) >= found.top:  # so many rows are sure to reach this
            sure = np.partition(np.where(on, low, -np.inf), len(b) - found.top, axis=1)[:, len(b) - found.top]
            least = np.maximum(least, sure)
        r, c = np.nonzero(on & (high >= least[:, None]))
        scored += len(r)
        found.add(i.start + r, b.id[c], products(a.v[r], b.v[c]))
    return scored


def windowed(found: Lists, anchors: Side, floor: np.ndarray, ceiling: np.ndarray, x: Side) -> int:
    """Adds x's rows of other labels to an anchor's windows (floor and ceiling have a row an anchor) that they fall into; gives the number of products worked out."""
    scored, windows = 0, floor.shape[1]
    for i, _, a, b in _tiles(anchors, x):
        open_ = floor[i] <= ceiling[i]
        least = np.maximum(floor[i], found.least.reshape(-1, windows)[i])
        least = np.where(open_, least.astype(float), np.inf).min(1, initial=np.inf)
        most = np.where(open_, ceiling[i].astype(float), -np.inf).max(1, initial=-np.inf)
        if not (least <= most).any():
            continue
        low, high = bounds(a, b)
        r, c = np.nonzero((a.label[:, None] != b.label) & (high >= least[:, None]) & (low <= most[:, None]))
        scored += len(r)
        score = products(a.v[r], b.v[c])
        for w in range(windows):
            on = (score >= floor[i.start + r, w]) & (score <= ceiling[i.start + r, w])
            found.add((i.start + r[on]) * windows + w, b.id[c[on]], score[on])
    return scored


def _blocks(anchors: DataFrame, width: int, references: int, most: int) -> Iterator[Side]:
    rows: list = []

    def block() -> Side:
        b = pa.RecordBatch.from_pylist([r.asDict() for r in rows], pa.schema({"id": pa.int64(), "label": pa.int64(), "v": pa.list_(pa.int64()), "norm": pa.float64(), "angles": pa.list_(pa.float64())}))
        return Side.of(b, width, references)

    for r in anchors.toLocalIterator():
        rows.append(r)
        if len(rows) == most:
            yield block()
            rows = []
    if rows:
        yield block()


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which is_anchor (over id) holds. Their positives are the first rows of the same label with another id; for each positive, its negatives are the
    first rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, then smaller ids.

    Of equal vectors with one label only as many rows are looked at as a list could hold. Blocks of anchors are compared with all others, each block in two passes: one for positives, one for
    the windows that these set. A task keeps the first rows of each list, so what is gathered grows with anchors and tasks alone.
    Ids and labels are integers. Rows with a null id, label, vector or component or a non-finite component take no part; a row that is repeated counts once; shorter vectors
    are filled up with zeros; a score beyond a long counts as the nearest long. No rows or no anchors: no result.
    """
    spark = rows.sparkSession
    sound = saved(scaled(rows, id_col, F.col("label") if label is None else label, vector), "vectors")
    sample = sound.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    width = max(1, sound.agg(F.max(F.size("v"))).first()[0] or 0)
    refs = directions(np.array([r["v"] + [0] * (width - len(r["v"])) for r in sample], np.int64).reshape(-1, width))
    index = saved(with_angles(leading(sound, max(positives + 1, negatives)), refs), "angles")
    anchors = saved(with_angles(sound.where(is_anchor), refs), "anchors")
    parts = []
    for a in _blocks(anchors, width, len(refs), block):

        def alike(batches: Iterator[pa.RecordBatch], a: Side = a) -> Iterator[pa.RecordBatch]:
            found = Lists(len(a), positives)
            for b in batches:
                nearest_alike(found, a, Side.of(b, width, len(refs)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.list, found.id, found.score)], names=["list", "id", "score"])

        order = Window.partitionBy("list").orderBy(F.desc("score"), "id")
        firsts = index.mapInArrow(alike, "list bigint, id bigint, score bigint").withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
        floor, ceiling, positive = np.ones((len(a), positives), np.int64), np.zeros((len(a), positives), np.int64), np.zeros((len(a), positives), np.int64)
        known = np.zeros((len(a), positives), np.int64)
        for r in firsts.collect():  # positives of one block
            at = r["list"], r["r"] - 1
            positive[at], known[at] = r["id"], r["score"]
            floor[at], ceiling[at] = max(_LEAST, min(_MOST, -(-low * r["score"] // 100))), max(_LEAST, min(_MOST, high * r["score"] // 100))

        def inside(batches: Iterator[pa.RecordBatch], a: Side = a, floor=floor, ceiling=ceiling, positive=positive, known=known) -> Iterator[pa.RecordBatch]:
            found = Lists(len(a) * positives, negatives)
            for b in batches:
                windowed(found, a, floor, ceiling, Side.of(b, width, len(refs)))
            out = [found.list, a.id[found.list // positives], positive.ravel()[found.list], known.ravel()[found.list], found.id, found.score]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["list", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

        order = Window.partitionBy("list").orderBy(F.desc("negative_score"), "negative_id")
        made = index.mapInArrow(inside, "list bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
        made = made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        parts.append(saved(made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
    if not parts:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, parts)


def op13_hard_negatives(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("id") % 100 == 0, label=moved)


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS k FROM e),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, sum(a.x * b.x)::BIGINT AS score
  FROM c a JOIN c b USING (k) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
p AS (SELECT a, b AS p, score AS ps FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT a, p, ps, b AS n, score AS ns, row_number() OVER (PARTITION BY a, p ORDER BY score DESC, b)::INT AS rank FROM p JOIN s USING (a) WHERE NOT alike AND 80 * ps <= 100 * score AND 100 * score <= 100 * ps)
SELECT a AS anchor_id, p AS positive_id, rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5
"""
