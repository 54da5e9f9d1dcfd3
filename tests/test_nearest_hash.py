"""Nearest hashes against all pairs, by pieces and by growing radius."""

import numpy as np
import pytest


from brindle.operators import dedup


def plain(left, right, other):
    out = {}
    for b, i, h in right:
        if None in (b, i, h) or not any(c == b and g is not None for c, _, g in left):
            continue
        found = [((h ^ g) & (2**64 - 1)).bit_count() for c, j, g in left if c == b and g is not None and (not other or j != i)]
        out[b, i] = min([d for d in [out.get((b, i)), *found] if d is not None], default=None)
    return out


def hashes(seed, n, start=0, far=(0, 1, 3, 6, 9, 13, 18)):
    """Clusters, with members at all distances from their centre."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-(2**63), 2**63, 12)
    rows = []
    for k in range(n):
        h = int(centres[rng.integers(0, 12)])
        for bit in rng.choice(64, rng.choice(far), replace=False):
            h ^= 1 << int(bit)
        h &= 2**64 - 1
        rows.append(("ab"[k % 2], start + k, h - 2**64 if h >> 63 else h))
    return rows


@pytest.mark.parametrize("chunk", [dedup.CHUNK, 40])
def test_against_all_pairs(spark, chunk):
    extra = [("a", 900, 5), ("a", 901, 5), ("c", 902, 7), (None, 903, 1), ("a", None, 1), ("a", 904, None), ("d", 905, -1)]
    left = hashes(0, 300) + extra
    right = hashes(0, 200) + hashes(9, 40, 500) + extra + [("z", 1, 1)]
    schema = "b string, i long, h long"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    for x, y, other in ((a, b, False), (a, a, True)):
        got = {(r.b, r.i): r.best for r in dedup.best_distance(x.repartition(5), y, "b", "h", "i", other, chunk).collect()}
        assert got == plain(left, right if y is b else left, other)


def test_few_pairs_are_looked_at(spark, monkeypatch):
    """In a block with a near partner for every row, lookups find far fewer candidates than there are pairs, and nothing is left for whole comparisons."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, 3000)
    twins = [int(h) ^ (1 << int(k)) for h, k in zip(base, rng.integers(0, 62, 3000))]
    df = spark.createDataFrame([(0, k, int(h)) for k, h in enumerate([*base, *twins])], "b int, i long, h long")
    left_over = []
    pieces = dedup._in_pieces
    monkeypatch.setattr(dedup, "_in_pieces", lambda rows, *more: left_over.append(rows.count()) or pieces(rows, *more))
    best = dedup.best_distance(df, df, "b", "h", "i", True, 1000)
    assert {r.best for r in best.collect()} == {1} and best.count() == 6000
    assert left_over[-1] == 0
    index = dedup._banded(df.select("b", "h", "i"), [0])
    candidates = index.alias("x").join(index.alias("y"), ["b", "_band", "_key"]).count()
    assert candidates < 0.01 * 6000 * 6000
    assert dedup.best_distance(df.limit(0), df, "b", "h", "i").count() == 0
