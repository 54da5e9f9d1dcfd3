import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from brindle.llm import mixing as M


def test_every_prefix_is_within_a_block_of_the_target():
    rng = random.Random(0)
    for _ in range(40):
        names = [f"s{k}" for k in range(rng.randrange(1, 25))]
        weights = {n: Fraction(rng.randrange(1, 40), rng.choice([1, 7, 100])) for n in names}
        total = sum(weights.values())
        slots = M.schedule(M.shares(weights))
        period = sum(map(len, slots.values()))
        assert sorted(t for s in slots.values() for t in s) == list(range(period))
        for n, s in slots.items():
            assert Fraction(len(s), period) == weights[n] / total
            ran = np.zeros(period + 1)
            ran[np.array(s) + 1] = 1
            assert np.abs(np.cumsum(ran) - float(weights[n] / total) * np.arange(period + 1)).max() < 1


def test_targets_hold_to_a_block_at_100_000_blocks():
    # no source runs out in 100,000 slots
    total = sum(M.TARGETS.values())
    assert total == 1
    plan = M.stretches(dict.fromkeys(M.TARGETS, 100_000), M.TARGETS)
    for n, parts in plan.items():
        at = M._slot(parts[:1], np.array([0]), np.arange(100_000))
        ran = np.zeros(100_001)
        ran[at[at < 100_000] + 1] = 1
        assert np.abs(np.cumsum(ran) - float(M.TARGETS[n]) * np.arange(100_001)).max() < 1, n


def test_shares_are_exact_or_rounded_as_documented():
    assert M.shares({"a": 0.1, "b": 0.25, "c": 0.65}) == {"a": 2, "b": 5, "c": 13}
    odd = M.shares({"a": 2**0.5, "b": 3**0.5, "c": 1e-9}, 1000)
    assert odd["c"] == 1 and abs(odd["a"] / odd["b"] - (2 / 3) ** 0.5) < 0.01


def slow(blocks, weights):
    """Slot by slot on exact fractions: of the released blocks the one due first runs; afresh whenever a source runs out."""
    left, done, out, t = {n: b for n, b in blocks.items() if b}, Counter(), {}, 0
    while left:
        total = sum(weights[n] for n in left)
        w = {n: weights[n] / total for n in left}
        ran, k = Counter(), 0
        while all(left.values()):
            ready = [(-(-(ran[n] + 1) // w[n]), n) for n in left if ran[n] // w[n] <= k]
            n = min(ready)[1]
            assert all(abs(ran[m] + (m == n) - w[m] * (k + 1)) < 1 for m in left)
            out[n, done[n]] = t
            ran[n] += 1
            done[n] += 1
            left[n] -= 1
            t, k = t + 1, k + 1
        left = {n: b for n, b in left.items() if b}
    return out


def test_stretches_match_slot_by_slot():
    rng = random.Random(1)
    for _ in range(40):
        names = [f"s{k}" for k in range(rng.randrange(1, 8))]
        weights = {n: Fraction(rng.randrange(1, 30), rng.choice([1, 3, 20])) for n in names}
        blocks = {n: rng.choice([0, 1, 3, 40, 333]) for n in names}
        plan = M.stretches(blocks, weights)
        want = slow(blocks, weights)
        got = {}
        for n, parts in plan.items():
            firsts = np.array([p.first for p in parts])
            for b, s in enumerate(M._slot(parts, firsts, np.arange(blocks[n]))):
                got[n, b] = int(s)
        assert got == want


def test_query_is_gapless_and_near_its_targets(spark):
    out = M.op5_pfair_mixing(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.position for r in out) == list(range(len(docs))) and {r.doc_id for r in out} == set(docs)
    blocks = defaultdict(list)
    for r in out:
        assert docs[r.doc_id] == r.source_group
        blocks[r.source_group, r.block].append((r.position, r.slot))
    for rows in blocks.values():
        rows.sort()
        assert len({s for _, s in rows}) == 1 and rows[-1][0] - rows[0][0] == len(rows) - 1 <= M.BLOCK - 1
    sizes = Counter(r.source_group for r in out)
    want = slow({n: -(-c // M.BLOCK) for n, c in sizes.items()}, {n: M.TARGETS[n] for n in sizes})
    assert {(n, b): rows[0][1] for (n, b), rows in blocks.items()} == want
    order = sorted(out, key=lambda r: r.position)
    assert [r.slot for r in order] == sorted(r.slot for r in out)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "src0", 1), (None, "new", 1)], "doc_id long, source string, position int")
    got = M.mixed(df).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3] and Counter(r.source_group for r in got) == {M.OTHER: 3, "src0": 1}
    assert M.in_mixed_order(df).count() == 4 and M.in_mixed_order(df).columns == df.columns
    assert M.mixed(df.limit(0)).count() == 0 and M.in_mixed_order(df.limit(0)).count() == 0
    assert Counter(r.source_group for r in M.mixed(df, {}).collect()) == {M.OTHER: 4}


def test_files_read_in_the_mixed_order(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    place = {r.id: r.position for r in M.mixed(docs).collect()}
    M.in_mixed_order(docs).write.parquet(str(tmp_path / "out"))
    import pyarrow.parquet as pq

    ids = []
    for f in sorted((tmp_path / "out").glob("*.parquet")):
        ids += pq.read_table(f)["doc_id"].to_pylist()
    assert [place[i] for i in ids] == sorted(place.values())
