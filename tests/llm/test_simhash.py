import random

import xxhash
from pyspark.sql import functions as F

from brindle.llm import simhash
from brindle.llm.common import ranked, with_unique


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and (fps[x] ^ fps[y]).bit_count() <= 3:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_documents_match_brute_force(spark):
    rng = random.Random(1)
    words = ["Aé", "b", "C", "dd", "E\x85f", "gg", "hh", "iI"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 30, 200]))) for _ in range(120)]
    texts += [None, "", " \n\t", "x", "x y", "X  Y"] + [texts[5]] * 10
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.id: (r.fp & (2**64 - 1), r.component) for r in simhash.near_components(docs).collect()}
    fps = {i: slow_fingerprint(t) for i, t, _ in rows}
    assert {i: x[0] for i, x in got.items()} == fps
    assert {i: x[1] for i, x in got.items()} == slow_components(fps)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_components(docs).count() == 0


def test_planted_links_and_large_cells(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(simhash, "CELL", 64)
    base = rng.getrandbits(64)
    fps = [base]
    for _ in range(400):
        f = rng.choice(fps[-50:])
        for _ in range(rng.choice([1, 2, 3, 4])):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps += [rng.getrandbits(64) for _ in range(300)]
    fps = list(dict.fromkeys(fps))
    signed = [(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)]
    classes = spark.createDataFrame(signed, "fp long, rep long")
    got = simhash.components(simhash.near_links(classes, len(fps)))
    want = slow_components(dict(enumerate(fps)))
    comp = {r.node: r.component for r in got.collect()}
    assert {i: comp.get(i, i) for i in want} == want


def test_every_grid_keeps_all_links():
    rng = random.Random(3)
    import numpy as np

    for n in (10, 10**5, 10**7, 10**10):
        masks = simhash.grid(n)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for _ in range(3):
                b ^= 1 << rng.randrange(64)
            x, y = simhash.embed(np.array([a, b], np.uint64))
            assert any(x & m == y & m for m in masks)
            assert (int(x) ^ int(y)).bit_count() <= (a ^ b).bit_count()


def test_ranked_and_hot_join(spark):
    rows = [(k % 3, k // 2) for k in range(60)] + [(0, 5)] * 100 + [(None, 1)]
    df = spark.createDataFrame(rows, "k long, v long")
    out = ranked(df, ["k"], ["v"], "t").collect()
    for k in (0, 1, 2, None):
        mine = sorted((r.v, r._rank) for r in out if r.k == k)
        assert sorted(r for _, r in mine) == list(range(len(mine)))
        assert [v for v, _ in sorted(mine, key=lambda x: x[1])] == sorted(v for v, _ in mine)
    small = df.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    assert with_unique(df.where("k is not null"), small, "k", "n", 3000).count() == 160


def slow_shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stage_finds_copies_of_similarity_four_fifths(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = random.Random(4)
    vocab = ["v%d" % k for k in range(3000)]
    texts = {}
    for i in range(120):
        base = rng.choices(vocab, k=rng.choice([1, 4, 60, 200, 200, 400]))
        for _ in range(rng.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(rng.randrange(0, 2 + len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts[len(texts)] = " ".join(words)
    for t in ("", " ", "a b"):
        texts[len(texts)] = t
    sets = {i: slow_shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close, missed_by_bits = [], 0
    for y in texts:
        for x in range(y):
            same = len(sets[x] & sets[y])
            if sets[x] == sets[y] or 5 * same >= 4 * (len(sets[x]) + len(sets[y]) - same) > 0:
                close.append((x, y))
                missed_by_bits += (simhash.fingerprint(texts[x]) ^ simhash.fingerprint(texts[y])).bit_count() > 3
                a, b = sorted((find(x), find(y)))
                root[b] = a
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: r.component for r in simhash.alike_components(docs).collect()}
    found = sum(got[x] == got[y] for x, y in close) / len(close)
    print(f"pairs of 0.8 or more: {len(close)}, joined {found:.4f}, over 3 bits apart {missed_by_bits / len(close):.4f}")
    assert missed_by_bits > len(close) / 3 and got == {i: find(i) for i in texts}
    assert {r.doc_id for r in simhash.without_near_copies(docs).collect()} == {i for i in texts if find(i) == i}
    assert simhash.without_near_copies(docs.limit(0)).count() == 0


def test_template_crowd_gives_no_pairs(spark, monkeypatch):
    """Texts of one template with words of their own, just below the bound: candidates stay in proportion, near copies among them are found."""
    rng = random.Random(8)
    template = ["t%d" % k for k in range(400)]

    def filled(i, own):
        return " ".join(template[:200] + [f"w{i}x{k}" for k in range(own)] + template[200:])

    texts = {i: filled(i, 46 + i % 4) for i in range(600)}
    for i in range(40):  # near copies of some: one word more at the end
        texts[1000 + i] = texts[i] + f" e{i}"
    for i in range(3):  # over the bound with each other by a passage that only they share
        texts[2000 + i] = filled(2000 + i, 12) + " " + " ".join(f"c{k}" for k in range(36))
    counted = []
    inner = simhash.across

    def seen(*args):
        out = inner(*args).cache()
        counted.append(out.count())
        return out

    monkeypatch.setattr(simhash, "across", seen)
    docs = spark.createDataFrame(sorted(texts.items(), key=lambda x: rng.random()), "doc_id long, text string")
    got = {r.id: r.component for r in simhash.alike_components(docs).collect()}
    sets = {i: slow_shingles(t) for i, t in texts.items()}
    for x, y in [(0, 1), (3, 599), (0, 2000), (2000, 2001), (2000, 2002), (5, 1005)]:
        same = len(sets[x] & sets[y])
        assert (9 * same >= 4 * (len(sets[x]) + len(sets[y]))) == (got[x] == got[y]), (x, y)
    assert got == {i: i - 1000 if 1000 <= i < 2000 else 2000 if i >= 2000 else i for i in texts}
    assert counted[0] <= len(texts)


def test_rare_shingles_name_their_holders(spark):
    sets = {1: [1, 2, 3, 4], -2: [2, 3, 4], 3: [3, 4, 9], 5: [4]}
    rows = simhash.rare_shingles(spark.createDataFrame(list(sets.items()), "h long, s array<long>")).collect()
    got = sorted((r.n, r.lo, r.mid if r.n == 3 else None, r.hi) for r in rows)
    assert got == sorted([(1, 1, None, 1), (1, 3, None, 3), (2, -2, None, 1), (3, -2, 1, 3)], key=lambda x: (x[0], x[1]))


def test_stage_links_fingerprints_and_sets(spark):
    """The pipeline's stage has both kinds of links: texts three bits apart at most whatever their sets, and sets of 0.8 whatever the bits, in one component where they meet."""
    import corpus_pipeline

    rng = random.Random(12)

    def far(a, b):
        x, y = slow_shingles(a), slow_shingles(b)
        return 9 * len(x & y) < 4 * (len(x) + len(y))

    def bits(a, b):
        return (slow_fingerprint(a) ^ slow_fingerprint(b)).bit_count()

    def changed(text, n):
        words = text.split()
        for k in rng.sample(range(len(words)), n):
            words[k] = f"x{rng.random()}"
        return " ".join(words)

    base = " ".join(f"w{k}" for k in range(300))
    by_bits = next(t for t in iter(lambda: changed(base, 8), None) if far(base, t) and bits(base, t) <= 3)
    by_set = next(t for t in iter(lambda: changed(by_bits, 4), None) if not far(by_bits, t) and bits(by_bits, t) > 3 and far(base, t) and bits(base, t) > 3)
    docs = spark.createDataFrame([(7, by_set), (3, base), (5, by_bits), (9, "another text of its own")], "doc_id long, text string")
    assert {r.id: r.component for r in simhash.copy_components(docs).collect()} == {3: 3, 5: 3, 7: 3, 9: 9}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {3, 9}
    assert simhash.copy_components(docs.limit(0)).count() == 0
