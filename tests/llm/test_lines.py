import random
import re

from pyspark.sql import functions as F

from brindle.llm import lines as L


def sets_of(rows):
    out = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower()))
            out.append(((i, k), words))
    return sorted(out, key=lambda x: x[0])


def slow(rows):
    lost = {}
    all_ = [(at, w) for at, w in sets_of(rows) if len(w) >= 5]
    for b, (at, w) in enumerate(all_):
        if any(5 * len(w & v) >= 4 * len(w | v) for _, v in all_[:b]):
            lost.setdefault(at[0], []).append(at[1])
    return lost


def near(rng, line):
    words = line.split()
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        k = rng.randrange(max(1, len(words)))
        words[k : k + 1] = rng.choice([[], ["new%d" % rng.randrange(99)], [*words[k : k + 1], "x%d" % rng.randrange(9)]])
    rng.random() < 0.3 and rng.shuffle(words)
    return " ".join(words)


def made(seed, n=250):
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)] + ["the", "of", "and", "É", "Ä"] * 4
    lines = [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 6, 8, 12, 30, 60]))) for _ in range(150)]
    rows = []
    for i in range(n):
        text = "\n".join(near(rng, rng.choice(lines)) if rng.random() < 0.7 else "\t" + rng.choice(lines).upper() for _ in range(rng.randrange(5)))
        rows.append((i, text))
    return rows


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, line string").repartition(3)
    got = {r.doc: list(r.removed) for r in L.removed_lines(df).collect()}
    assert got == slow(rows)
    return df, got


def test_matches_brute_force(spark):
    df, got = check(spark, made(1))
    out = {r.doc_id: r for r in L.deduplicated(df).collect()}
    for i, t in made(1):
        want = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in got.get(i, []))
        assert out[i].text == want and out[i].line == "c"


def test_crowd_of_near_copies(spark):
    rng = random.Random(9)
    base = " ".join("b%d" % k for k in range(60))
    rows = [(i, near(rng, base)) for i in range(150)] + [(900 + i, base) for i in range(50)]
    check(spark, rows)


def test_thresholds_and_edges(spark):
    ten = "a b c d e f g h i j"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, ten), (5, "a b c d e f g h i"), (6, "a b c d e f g h x y"), (7, "a b c d"), (8, "a b c d"), (9, "j i h g f e d c b a a a"), (10, ten + "\n" + ten)]
    _, got = check(spark, rows)
    assert 7 not in got and 8 not in got and got[10] == [0, 1]
    assert L.removed_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "p q r s t"), (2, "p q r s t\nz")], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.text) for r in L.deduplicated(df).collect())
    assert out == [(0, "p q r s t"), (1, "a b c d e"), (1, "a b c d e"), (2, "z")]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = slow(docs)
    got = L.op7_line_dedup(spark, sf).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.removed for r in got if r.n_removed} == {i: ",".join(map(str, k)) for i, k in want.items()}


def test_query_matches_sql(spark):
    from tests.llm.sql import same

    same(spark, "/root/testdata/sf0.01", "op7_line_dedup")


def test_long_lines_of_few_words_go_where_they_repeat(spark):
    cjk, url, rep = "这是每个文档里都有的一整段中文声明没有空格", "https://example.com/" + "path/" * 9, "spam eggs " * 30
    rows = [(1, f"{cjk}\n{url}\n{rep}\nyes."), (2, f"one\n{cjk} \n{url.upper()}\n{rep}\nyes."), (3, f"{cjk}句\n{' ' * 60}"), (4, f"{' ' * 60}\neggs spam {rep}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in L.deduplicated(df).collect()}
    assert out == {**dict(rows), 2: "one\nyes."}
    assert L.removed_lines(df).count() == 0


def test_few_rows_take_their_words_along(spark, monkeypatch):
    """Of a crowd of long near copies one part of the words settles most lines; the rest needs no words again."""
    rng = random.Random(9)
    base = [f"c{k}" for k in range(70)]
    rows = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(70)] = f"own{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = []
    inner = L.with_words

    def seen(some, *args):
        counted.append(some.count())
        return inner(some, *args)

    monkeypatch.setattr(L, "with_words", seen)
    lost = {r.doc: r.removed for r in L.removed_lines(docs).collect()}
    assert lost == {i: [0] for i in range(1, 150)}
    # each line has 15 rarest words, 14 or 15 of them in the others' too
    assert sum(counted) < 150 * 14 / 2


def test_rows_pass_only_under_a_first_shared_word(spark):
    """Two lines of 18 words that match share 16, so their first shared word has at most two words before it on either side."""
    at = lambda n, pos: (n << 32) + pos
    rows = [(100 + pos, doc, 0, 0, at(18, pos), None) for pos in range(4) for doc in (1, 2)]
    df = spark.createDataFrame(rows, "tok long, doc long, line int, parity long, at long, wide array<long>")
    assert sorted({r.tok for r in L.involved(df).collect()}) == [100, 101, 102]


def test_words_are_cut_at_any_white_space(spark):
    texts = ["a b", "", " a  b ", "a\tb", "a\x0bb c", "a\fb", "a\rb", "a\u00a0b \u2003c", "a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.split_words(F.col("t")).alias("w"))
    for r in df.collect():
        assert [w for w in r.w if w] == re.findall(r"[^\x20\x09-\x0D]+", r.t), repr(r.t)


def test_lines_alone_in_their_class_are_written_once(spark, monkeypatch):
    """The prefixes of such lines are read where they were first written, and so are all lines' places."""
    rows = [(i, " ".join(f"v{i}x{k}" for k in range(9))) for i in range(60)] + [(100 + i, "one line that all these have") for i in range(3)]
    written, inner = {}, L.saved

    def seen(df, name):
        out = inner(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(L, "saved", seen)
    lost = {r.doc: r.removed for r in L.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert lost == {101: [0], 102: [0]}
    assert written["lines"] == 63 and written["firsts"] < 60 and "lineplaces" not in written


def test_filters_in_whole_numbers_lose_no_pair(spark):
    """Whatever two sizes and places: where sets can share what they need from a word on, and differ in as many words as they may, they pass."""
    rows = []
    for n1 in range(5, 60):
        for n2 in range(5, 60):
            o = -(-4 * (n1 + n2) // 9)
            d = n1 + n2 - 2 * o
            if o <= min(n1, n2):
                for p1, p2, apart, good in ((n1 - o, n2 - o, d, True), (n1 - o + 1, 0, d, False), (0, n2 - o + 1, d, False), (0, 0, d + 2, False)):
                    if apart < 64:
                        rows.append(((n1 << 32) + p1, 0, None, (n2 << 32) + p2, (1 << apart) - 1 if apart < 63 else -1 >> 1, None, good))
    side = "struct<at: long, parity: long, wide: array<long>>"
    df = spark.createDataFrame([((a, b, c), (d, e, f), g) for a, b, c, d, e, f, g in rows], f"l {side}, r {side}, good boolean")
    assert df.where(L.close("l", "r") != F.col("good")).isEmpty()


def test_ranks_stay_short_in_the_text_of_plans(spark):
    """The driver writes the constants of a plan out with each description of it, for the event log and for the status store."""
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    ranks = L.rarity(docs)
    made = L.described(L.occurrences(docs, ranks, "doc_id", "text"), L.LEAST)
    assert len(made._jdf.queryExecution().executedPlan().toString()) < 1 << 19


def test_keys_sort_by_rarity_and_hash(spark):
    docs = spark.createDataFrame([(1, "often often often often twice twice once often")], "doc_id long, text string")
    ranks = L.rarity(docs)
    words = spark.createDataFrame([("often",), ("twice",), ("once",)], "w string")
    rows = words.select("w", F.xxhash64("w").alias("h"), L.key(F.xxhash64("w"), ranks).alias("k")).collect()
    assert [r.w for r in sorted(rows, key=lambda r: r.k)] == ["once", "twice", "often"]
    assert all((r.h ^ r.k) & ((1 << 48) - 1) == 0 for r in rows)
