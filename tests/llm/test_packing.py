import math
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from brindle.llm import packing as P

PATH = public_tokenizers.path(P.VOCABULARY)


def holds(planned, histogram, capacity):
    got = Counter()
    for pattern, times in planned:
        assert 0 < sum(n * c for n, c in pattern.items()) <= capacity and times > 0
        for n, c in pattern.items():
            got[n] += c * times
    return got == Counter({n: c for n, c in histogram.items() if c})


@pytest.mark.parametrize("size,few", [(0, 50), (1, 50), (300, 50), (40_000, 500)])
def test_plans_hold_every_piece_and_are_near_the_bound(size, few):
    rng = np.random.default_rng(size)
    lengths = np.minimum(256, rng.lognormal(3.5, 1, size).astype(int) + 1)
    histogram = dict(Counter(lengths.tolist()))
    planned = P.plan(histogram, 256, 30, few)
    assert holds(planned, histogram, 256)
    if size > 1000:
        assert sum(t for _, t in planned) <= 1.01 * math.ceil(lengths.sum() / 256)


def test_awkward_lengths_stay_exact():
    for histogram in ({200: 10_001, 150: 7}, {129: 5000}, {256: 9, 1: 3000}, {100: 3001, 57: 2000}):
        assert holds(P.plan(histogram, 256, 10, 20), histogram, 256)
    pairs = P.plan({100: 30_000, 156: 30_000}, 256, 40, 20)
    assert sum(t for _, t in pairs) < 30_300


def test_ids_are_the_tokenizers():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(0)
    pieces = ["<|endoftext|>", "<|startoftext|>", "'s", "'", "Don't", "é", "É", "́", "İ", "Σ", "\x85", " ", "\x01", " ", " ", "\n", "abc", "Abc,", "...", "=", "̸", "12", "😀", "|>", "中"]
    ids = P.Ids(PATH)
    for _ in range(400):
        t = "".join(rng.choices(pieces, k=rng.randrange(12)))
        assert ids.of(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    assert ids.of(None) == b""


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    want = {}
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[r.doc_id, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    got = P.op2_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    bound = math.ceil(sum(r.length for r in got) / 2048)
    assert bound <= len(sequences) <= bound * 1.02 + 1


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "", 3), (None, "a b", 3), (4, "x " * 30, 3)], "doc_id long, text string, piece int")
    got = P.packed(docs, PATH, capacity=16).collect()
    assert sorted(r.length for r in got) == [1, 1, 1, 3, 15, 16]
    assert P.packed(docs.limit(0), PATH).count() == 0


def test_small_tables_are_planned_by_the_program_too(monkeypatch):
    calls = []
    program = P.configuration_lp
    monkeypatch.setattr(P, "configuration_lp", lambda *a: calls.append(a) or program(*a))
    planned = P.plan({100: 300, 156: 300}, 256)
    assert calls and holds(planned, {100: 300, 156: 300}, 256) and sum(t for _, t in planned) <= 303
    assert P.plan({}, 256) == []


_MANY_WORDS = """
import re
import pyarrow as pa
import public_tokenizers
from brindle.llm import packing as P

def anonymous():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

ids = P.Ids(public_tokenizers.path(P.VOCABULARY))
before = anonymous()
for k in range(0, 720_000, 40_000):
    ids.many(pa.array([" ".join(f"the{n:06d}" for n in range(k, k + 40_000))]))
print(anonymous() - before)
"""


def test_a_worker_stays_small_over_many_words():
    done = subprocess.run([sys.executable, "-c", _MANY_WORDS], capture_output=True, text=True, timeout=300, check=True)
    assert float(done.stdout) < 80


def test_texts_go_to_python_in_modest_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
        P.pieces(docs, PATH)
        assert spark.conf.get(key) == "1000"
        spark.conf.set(key, "50")
        P.pieces(docs, PATH)
        assert spark.conf.get(key) == "50"
    finally:
        spark.conf.set(key, was)


def test_a_task_leaves_no_words_behind(spark):
    def words(batches):
        for b in batches:
            pass
        yield pa.record_batch({"n": pa.array([sum(len(x.words) for x in P._encoders.values())])})

    docs = spark.createDataFrame([(k, f"w{k} x{k}") for k in range(50)], "doc_id long, text string").coalesce(1)
    assert P.pieces(docs, PATH).count() == 50
    assert docs.mapInArrow(words, "n long").first()[0] <= 1
