"""Hard negatives against SQL and against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import negatives
from tests.llm.sql import same

BEYOND = (1 << 63) - 1
SCHEMA = "vec_id bigint, label int, embedding array<float>, rank int, anchor_id string"


def plain(rows, positives=5, top=5):
    """All pairs, in Python's integers."""
    sound = {(i, l, tuple(math.floor(256 * x) for x in e)) for i, l, e in rows if None not in (i, l, e) and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for i, l, a in sound:
        if i % 10:
            continue
        score = lambda v: max(-BEYOND - 1, min(BEYOND, sum(p * q for p, q in zip(a, v))))  # noqa: B023, E731
        alike = sorted((-score(v), j) for j, m, v in sound if m == l and j != i)[:positives]
        others = sorted((-score(v), j) for j, m, v in sound if m != l)
        for s, p in alike:
            found = [(j, -n) for n, j in others if 80 * -s <= 100 * -n <= 100 * -s][:top]
            out += [(i, p, k + 1, j, -s, n) for k, (j, n) in enumerate(found)]
    return sorted(out)


def found(spark, rows, parts=4, **more):
    df = spark.createDataFrame([(i, l, e, 1, "x") for i, l, e in rows], SCHEMA)
    got = negatives.hard_negatives(df.repartition(parts), F.col("id") % 10 == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_query_matches_sql(spark):
    same(spark, "/root/testdata/sf0.01", "op13_hard_negatives")


def test_all_pairs(spark):
    rng = random.Random(5)
    near = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(k, rng.randrange(3), [x + rng.gauss(0, 0.3) for x in rng.choice(near)]) for k in range(300)]
    rows += [(1000 + k, k % 2, near[0]) for k in range(90)]  # more copies than places, with either label
    rows += rows[:5] + [(2000, 1, [0.0] * 6), (2010, 1, [0.0] * 6), (2001, 0, [0.0] * 6), (2020, 1, near[1][:3]), (2030, 1, [])]
    rows += [(None, 1, near[0]), (3000, None, near[0]), (3010, 1, None), (3020, 1, [None] * 6), (3030, 1, [float("nan")] * 6), (3040, 1, [float("inf")] * 6), (-10, 2, near[2])]
    want = plain(rows)
    assert len(want) > 500
    assert found(spark, rows) == want
    assert found(spark, rows, parts=1, block=7) == want


def test_scores_beyond_a_long(spark):
    rows = [(k, k % 2, [3e18 * (-1) ** (k // 4), 1.0, float(k)]) for k in range(40)]
    sat = lambda x: max(-BEYOND - 1, min(BEYOND, math.floor(256 * x)))
    want = plain([(i, l, [sat(x) / 256 for x in e]) for i, l, e in rows])
    assert {r[:4] for r in found(spark, rows)} == {r[:4] for r in want}


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(10, 1, [1.0])], [(10, 1, None)], [(10, 1, []), (20, 1, []), (30, 2, [])]])
def test_little(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_bounds_hold():
    """For vectors in, near and across the reference directions, with few and with all of them."""
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (200, 8))
    v[:50] = v[50] + rng.integers(-2, 3, (50, 8))
    v[60] = 0
    exact = v @ v.T
    for share in (0.3, 0.9, 1.0):
        refs = negatives.directions(v, share)
        norm = np.linalg.norm(v.astype(float), axis=1)
        angles = np.arccos(np.clip(v @ refs.T / np.where(norm > 0, norm, 1)[:, None], -1, 1))
        side = negatives.Side(np.arange(200), np.zeros(200), v, norm, angles)
        low, high = negatives.bounds(side, side)
        assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).max() < 10


def test_few_products_are_worked_out():
    """Only rows whose bounds reach a list are scored, and the lists are those of all pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (20, 64))
    v = np.floor(256 * (centres[rng.integers(0, 20, 3000)] + rng.normal(0, 0.3, (3000, 64)))).astype(np.int64)
    refs = negatives.directions(v)
    norm = np.linalg.norm(v.astype(float), axis=1)
    x = negatives.Side(np.arange(3000), rng.integers(0, 5, 3000), v, norm, np.arccos(np.clip(v @ refs.T / norm[:, None], -1, 1)))
    a = x[:40]
    lists = negatives.Lists(40, 5)
    scored = sum(negatives.nearest_alike(lists, a, x[k : k + 500]) for k in range(0, 3000, 500))
    assert scored < 0.05 * 40 * 3000
    for k in range(40):
        best = sorted((-int(v[k] @ v[j]), j) for j in range(3000) if j != k and x.label[j] == x.label[k])[:5]
        assert [(-s, j) for s, j in zip(lists.score[lists.list == k], lists.id[lists.list == k])] == best
