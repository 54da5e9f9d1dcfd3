import random
import re

import numpy as np

from brindle.llm import rules

DATA = "/root/testdata/sf0.01"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_match_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "a b c ", "\x85", "é", "|", "\t", "\x0b#"]) for _ in range(rng.randrange(40)))
        assert rules.text_counts(text)[:5] == slow(text), text
    assert rules.text_counts(None)[:5] == (0, 0, 0, 0, 0)
    assert rules.text_counts("x " * 200_000)[4] == 200_000


def test_learned_list_finds_a_planted_rule():
    rng = np.random.default_rng(0)
    x = {f: rng.random(3000) for f in rules.FEATURES}
    bad = (x["symbols_per_word"] > 0.8) | ((x["upper_share"] > 0.7) & (x["chars_per_word"] < 0.5))
    found = rules.learn(x, bad)
    said = np.zeros(3000, bool)
    for r in found:
        said |= r.holds(x)
    assert found and (said & ~bad).mean() < 0.01 and (said & bad).sum() / bad.sum() > 0.95
    assert rules.learn(x, np.zeros(3000, bool)) == [] and rules.learn({f: v[:0] for f, v in x.items()}, bad[:0]) == []


def test_noise_gives_no_rule():
    rng = np.random.default_rng(1)
    x = {f: rng.random(2000) for f in rules.FEATURES}
    assert rules.learn(x, rng.random(2000) < 0.3) == []


def test_query_counts_and_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out, learned = rules.judged(docs, labels.where("doc_id % 2 = 0"))
    assert learned
    got = {r.id: r for r in out.collect()}
    for r in docs.select("doc_id", "text").limit(60).collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == slow(r.text)
        assert g.kept <= (not g.base_failed)
    held = [r for r in labels.where("doc_id % 2 = 1").collect() if not got[r.doc_id].base_failed]
    wrong = sum((got[r.doc_id].kept) != (r.quality == 1) for r in held)
    clean = [r for r in held if r.quality == 1]
    assert wrong / len(held) < 0.08 and sum(not got[r.doc_id].kept for r in clean) / len(clean) < 0.02


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 0), (None, "a b", 1)], "doc_id long, text string, n_words int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out, learned = rules.judged(docs, none)
    assert learned == [] and out.count() == 4 and out.where("kept").count() == 0
    assert rules.judged(docs.limit(0), none)[0].count() == 0
