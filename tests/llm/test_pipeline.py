import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brindle.llm import mixing, packing, rules, simhash
from tests.llm.test_lines import slow as slow_lines
from tests.llm.test_rules import slow as slow_counts
from tests.llm.test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(str(top / name))
        docs = spark.read.parquet(str(top / name))
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_the_stages(staged, spark):
    docs, kept, cleaned, unique, mixed, packed = staged
    for df in staged[1:5]:
        assert df.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged, _ = rules.judged(docs, labels)
    assert set(texts(kept)) == {r.id for r in judged.where("kept").collect()}
    for i, t in list(texts(kept).items())[:40]:
        n, _, _, _, repeat = slow_counts(t)
        assert n >= 50 and 100 * repeat <= 50 * n
    lost = slow_lines(sorted(texts(kept).items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost.get(i, [])) for i, t in texts(kept).items()}
    assert texts(cleaned) == want and cleaned.where("n_chars <> length(text)").count() == 0
    comp = slow_components({i: slow_fingerprint(t) for i, t in want.items()})
    assert texts(unique) == {i: t for i, t in want.items() if comp[i] == i}
    assert texts(mixed) == texts(unique)
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {}
    for i, t in texts(mixed).items():
        full = [*tok.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(full), 2048):
            ids[i, k // 2048] = (k, len(full[k : k + 2048]), zlib.crc32(np.array(full[k : k + 2048], "<u4").tobytes()))
    rows = packed.collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == ids and len(rows) == len(ids)
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048


def test_run_gives_the_last_stage(staged, spark):
    out = corpus_pipeline.run(spark, SF)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(out.select(*cols).collect()) == sorted(staged[-1].select(*cols).collect())


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, id long"
    odd = spark.createDataFrame([(1, None, None, None, None, "c", 3), (1, None, None, None, None, "c", 3), (2, "", "en", "src0", 0, "c", 3), (None, "w " * 80, "en", "x", 160, "c", 3)], schema)
    for docs in (odd, odd.limit(0)):
        for _, f in corpus_pipeline.STAGES[:4]:
            out = f(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.pack(spark, docs, SF).count() == docs.count()


def test_targets_change_the_sequences(spark, tmp_path, monkeypatch):
    rows = [(i, "word " * (100 + i % 7 * 90), "en", "src%d" % (i % 10 == 0), 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    # only the last two stages: the others would drop such texts
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    found = []
    for share in (0.5, 0.05):
        monkeypatch.setattr(mixing, "TARGETS", {"src0": share, "src1": 1 - share})
        place = {r.id: r.position for r in mixing.mixed(docs, mixing.TARGETS).collect()}
        out = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.sequence_id, r.offset))
        first, size, by_length = {}, defaultdict(int), defaultdict(list)
        for r in out:
            assert r.offset == size[r.sequence_id]
            size[r.sequence_id] += r.length
            first[r.sequence_id] = min(first.get(r.sequence_id, 1 << 60), place[r.doc_id])
        assert sorted(size) == list(range(len(size))) and max(size.values()) <= 2048
        assert list(first.values()) == sorted(first.values())
        seen = np.array([r.doc_id % 10 == 0 for r in out])
        found.append((seen[:40].mean(), [(r.doc_id, r.sequence_id, r.offset) for r in out]))
    assert found[0][1] != found[1][1] and found[1][0] > 1.4 * found[0][0] > 0.3
