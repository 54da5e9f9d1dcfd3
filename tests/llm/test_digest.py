import hashlib
import random

from brindle.llm import digest as D


def slow(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        c = [D.canonical(x) for x in (t, e, nxt)]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), float(c[0] == c[1]), float(c[0] == c[2]), c[0])
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string").repartition(5)
    got = {r.id: r for r in D.fingerprints(docs).collect()}
    want = slow(rows)
    assert {i: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for i, r in got.items()} == {i: w[:4] for i, w in want.items()}
    for a in want:
        for b in want:
            assert (got[a].fingerprint == got[b].fingerprint) == (want[a][4] == want[b][4])
    return got


def texts():
    rng = random.Random(4)
    words = ["Straße", "STRASSE", "ﬁn", "fin", "é", "e\u0301", "x", " ", "\u00a0", "\n", "😀"]
    rows = [(3 * i, "".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(150)]
    return rows + [(1000, None), (1001, ""), (1002, "a" * 100_001), (1003, "A" * 100_001)]


def test_matches_brute_force(spark):
    check(spark, texts())


def test_folding_equals():
    assert D.canonical(" Straße\u00a0 ﬁn\n") == D.canonical("STRASSE fin")
    assert D.canonical("é") == D.canonical("E\u0301") != D.canonical("e")


def test_equal_buckets_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(D, "digest", lambda data: str(len(data) % 3))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "aaaa"), (5, "cc")], "doc_id long, text string")
    # workers import the module afresh, so the collision is made on the saved rows
    done = docs.selectExpr("doc_id as id", "cast(length(text) % 3 as string) as digest", "cast(text as binary) as canon")
    found = {(r.digest, bytes(r.canon).decode()): r.variant for r in D.collisions(done).collect()}
    assert found == {("1", "a"): 0, ("1", "aaaa"): 1, ("1", "b"): 2}


def test_one_row_and_none(spark):
    check(spark, [(7, "ab c")])
    assert D.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "q"), (2, None)], "doc_id long, text string")
    got = D.fingerprints(docs).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got if r.id == 1}) == 1
