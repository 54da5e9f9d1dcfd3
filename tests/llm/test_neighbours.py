"""Nearest-neighbour quality: held-out accuracy, what may be an input, votes against all cosines, small tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import neighbours
from brindle.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = QUERIES["op11_quality_neighbours"](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    good = both.quality == 1
    assert len(both) > 900
    assert (both.predicted[good] == 1).mean() > 0.99 and (both.predicted[~good] == 0).mean() > 0.95


def test_inputs(spark):
    """Scores follow from texts and from labels that aren't held out, whatever the ids' order, other columns and partitions are."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    first = neighbours.judged(docs, labels, held).toPandas().set_index("id").score.sort_index()
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "score": F.lit(1), "good": F.lit(0)}).repartition(7, "source", "text")
    second = neighbours.judged(other, turned.union(turned), held).toPandas().set_index("id").score.sort_index()
    assert (first == second).all()
    assert first.nunique() > 5


@pytest.fixture
def small(spark):
    clean = "plain words follow each other here and there without any noise in them at all".split()
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.permutation(clean)[:9])) for k in range(40)] + [(100 + k, " ".join(f"{w.upper()}!!" for w in rng.permutation(clean)[:9])) for k in range(40)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "word " * 300_000), (204, "日本 語"), (None, "plain words"), (0, rows[0][1])]
    labels = [(k, 1) for k in range(20)] + [(100 + k, 0) for k in range(20)] + [(21, None), (None, 1), (999, 0), (5, 1), (5, 1)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_small_tables(small):
    rows, docs, labels = small
    got = neighbours.judged(docs.withColumn("id", F.lit("x")), labels).collect()
    assert len(got) == len(rows)
    by_id = {r["id"]: (r["score"], r["predicted"]) for r in got}
    assert all(by_id[k][1] == 1 for k in range(40)) and all(by_id[100 + k][1] == 0 for k in range(40))
    assert by_id[200] == by_id[201] == by_id[202] == (0.5, 0)
    assert by_id[None][1] == 1
    assert sorted(r["score"] for r in got if r["id"] == 0)[0] == by_id[0][0]
    assert neighbours.judged(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in neighbours.judged(docs, labels.limit(0)).collect()} == {0.5}
    one = neighbours.judged(docs, labels.where("doc_id = 3")).collect()
    assert {r["score"] for r in one} == {1.0}


def test_votes_against_all_cosines(small):
    rows, docs, labels = small
    voters = neighbours.fit(docs, labels)
    assert len(voters.good) == 40 and voters.good.sum() == 20
    texts = pa.array([t for _, t in rows])
    got = np.concatenate([voters.scores(x) for _, x in neighbours.counts(texts)])
    x = np.concatenate([x for _, x in neighbours.counts(texts)])
    for k, place in enumerate(voters.place(x)):
        near = sorted((-round(float(v @ place) * 1e5), n) for n, v in enumerate(voters.vectors))[: neighbours.VOTERS]
        votes = [(max(0, -c / 1e5) ** neighbours.POWER, voters.good[n]) for c, n in near]
        total = sum(w for w, _ in votes)
        want = sum(w * g for w, g in votes) / total if total > 1e-12 else 0.5
        assert abs(got[k] - want) < 2e-3


def test_counts_are_of_whole_texts():
    """Features of a text are those of its words however it is batched."""
    texts = [f"Word{k} word{k} THE!! a|b" * (k % 5) for k in range(600)]
    x = np.concatenate([x for _, x in neighbours.counts(pa.array(texts))])
    assert x.shape == (600, neighbours.FEATURES)
    alone = np.concatenate([next(neighbours.counts(pa.array([t])))[1] for t in texts[250:260]])
    assert (x[250:260] == alone).all()
    words = [len(t.split()) for t in texts]
    assert (x[:, : neighbours.WORDS].sum(1) == words).all() and (x.sum(1) == [2 * n + 2 * max(0, n - 1) for n in words]).all()
