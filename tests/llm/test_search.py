"""Ranked lexical search against SQL and a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import search
from tests.llm.sql import same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    N, L = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 75 + 25 * b.total() * N // L if L else 0
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            scores += [(-s, i)] if s > 0 else []
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def test_query_matches_sql(spark):
    same(spark, "/root/testdata/sf0.001", "op12_ranked_search")


def test_small_tables(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "Zürich", "A_b"]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([1, 5, 40])))) for k in range(120)]
    docs += [(200 + k, "the same copy of W1 w2, w2!") for k in range(90)]  # more copies than places
    docs += [(300, None), (301, ""), (302, " .,; "), (None, "w1 w2"), (303, "w3 w4"), (303, "w3 w4"), (-5, "w7 " * 70_000)]
    items = [(k, " ".join(rng.choices(words, k=8))) for k in range(12)] + [(50, "w1 W1 w2"), (51, None), (52, ""), (53, "nowhere"), (54, "w3-w4"), (54, "w3-w4"), (55, "a b É")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, item_id string, rank int")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, doc_id int")
    got = search.ranked_search(d.repartition(5), q)
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, list(dict.fromkeys(items)))


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "--")]])
def test_nothing_to_find(spark, docs):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert search.ranked_search(d, q).collect() == []
    assert search.ranked_search(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), q.limit(0)).collect() == []


def test_blocks_of_items(spark):
    items = spark.createDataFrame([(k, f"a{k} b c{k % 3}") for k in range(10)] + [(11, "x " * 9), (12, " ")], "i int, t string")
    for most, size in ((4, 100), (100, 5), (100, 1)):
        got = list(search.blocks(items, "i", "t", most, size))
        assert [n for q in got for n in q.names] == [*range(10), 11]
        assert all(len(q.names) <= most and (len(q.terms) <= size or len(q.names) == 1) for q in got)


def test_bounds_are_never_below_scores(monkeypatch):
    """Also where terms share coordinates, which a narrow sketch makes common."""
    monkeypatch.setattr(search, "WIDTH", 64)
    monkeypatch.setattr(search, "CELLS", 50)
    rng = random.Random(1)
    texts = [" ".join(rng.choices([f"t{k}" for k in range(300)], k=rng.choice([0, 3, 50]))) for _ in range(60)]
    items = [" ".join(rng.choices([f"t{k}" for k in range(320)], k=10)) for _ in range(9)]
    numbers, item, term, times = {}, [], [], []
    for k, x in enumerate(items):
        for t, c in Counter(x.encode().split()).items():
            item.append(k), term.append(numbers.setdefault(t, len(numbers))), times.append(c)
    df = Counter(t for x in texts for t in set(x.split()))
    N, L = sum(map(bool, texts)), sum(len(x.split()) for x in texts)
    weight = np.array([math.floor(1000 * math.log((2 * N + 2) / (2 * df[t.decode()] + 1))) for t in numbers], np.int64)
    scorer = search.Scorer(search.Queries(list(range(9)), list(numbers), *map(np.array, (item, term, times))), weight, N, L)
    rows, codes, tf, words = search.counted(pa.array(texts))
    n = np.bincount(rows, tf, len(texts)).astype(np.int64)
    known = np.array([numbers.get(w.encode(), -1) for w in words.to_pylist()])[codes]
    pairs = np.array([(a, b) for a in range(len(texts)) for b in range(9)])
    exact = scorer.score(rows, known, tf, n, pairs).reshape(len(texts), 9)
    want = {(i, d): s for i, _, d, s in plain(list(enumerate(texts)), list(enumerate(items)), 99)}
    assert {(i, d): exact[d, i] for d, i in zip(*np.nonzero(exact))} == want
    sketch = [{} for _ in texts]
    at = search.hashes(words) % np.uint64(64)
    for r, c, f in zip(rows, codes, tf):
        sketch[r][int(at[c])] = max(f, sketch[r].get(int(at[c]), 0))
    batch = pa.RecordBatch.from_pydict({
        "doc": pa.array(range(len(texts)), pa.int64()), "n": pa.array(n),
        "at": pa.array([np.array(sorted(s), "<u2").tobytes() for s in sketch], pa.binary()),
        "most": pa.array([np.array([s[k] for k in sorted(s)], "<u4").tobytes() for s in sketch], pa.binary()),
    })
    got = np.concatenate([b for _, b in scorer.bounds(batch)])
    assert (got >= exact).all() and (got > exact).any()
