"""Writers that check what they write: additive versions, counted tables, one nested document, and the table that joins all of a workflow."""

import json
import os

import pytest
from pyspark.sql import functions as F

from brindle import sources
from brindle.plans import catalog, kernels, sinks, workflows
from brindle.plans.sinks import RowsChanged

SF = "/root/testdata/sf0.001"


def test_versions_only_add_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") > 3, F.lit("x")).alias("s"), F.create_map(F.lit("a"), "id").alias("m"))
    sinks.versioned(base, path, 1)
    old = spark.read.parquet(f"{path}/version=1")
    out = sinks.versioned(old.repartition(5).withColumn("note", F.lit(None).cast("string")), path, 2, before=1)
    assert spark.read.parquet(out).columns == ["id", "k", "s", "m", "note"] and spark.read.parquet(out).count() == 100
    faults = {
        "lost": (old.where("id <> 5"), "lost or doubled"), "doubled": (old.union(old.where("id = 5")), "lost or doubled"), "swapped": (old.where("id <> 5").union(old.where("id = 6")), "changed"),
        "changed": (old.withColumn("s", F.when(F.col("id") == 9, "y").otherwise(F.col("s"))), "changed"), "nulled": (old.withColumn("s", F.when(F.col("id") != 9, F.col("s"))), "changed"), "dropped": (old.drop("k"), "gone"),
    }
    for df, said in faults.values():
        with pytest.raises(RowsChanged, match=said):
            sinks.versioned(df, path, 3, before=1)
        assert sorted(os.listdir(path)) == ["version=1", "version=2"]
    with pytest.raises(Exception):  # noqa: B017  a version that is there already stays
        sinks.versioned(old.withColumn("n", F.lit(1)), path, 2, before=1)
    assert spark.read.parquet(out).columns[-1] == "note"
    empty = old.limit(0)
    sinks.versioned(empty, str(tmp_path / "e"), 1)
    sinks.versioned(empty.withColumn("n", F.lit(1)), str(tmp_path / "e"), 2, before=1)


def test_csv_counts_what_it_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (None, "c", 1.5)], "id int, `a b` string, x double")
    assert sinks.csv(df, str(tmp_path / "c")) == {"rows": 3, "nulls id": 1, "nulls a b": 1, "nulls x": 2}
    assert sources.table(spark, str(tmp_path / "c"), "id int, `a b` string, x double").count() == 3


def test_one_nested_document(spark, tmp_path):
    path = str(tmp_path / "report.json")
    groups = spark.range(5000).select(F.concat(F.lit('k"\n'), F.lpad(F.col("id").cast("string"), 5, "0")).alias("md5"), F.array(F.concat(F.lit("a/é"), "id"), F.lit("b")).alias("locations")).repartition(7)
    rows = spark.createDataFrame([(2, "x", None), (1, 'q"\n', 0.5)], "id int, s string, v double")
    sections = {"dup_groups": (groups, "md5"), "none": (groups.limit(0), "md5"), "rows": rows, "empty": rows.limit(0), "by id": (rows, "id"), "threshold": 4, "note": 'a "b"', "nothing": None}
    for _ in range(2):
        sinks.nested_report(sections, path, {"rows": ["s"]})
    assert os.listdir(tmp_path) == ["report.json"]
    got = json.loads((tmp_path / "report.json").read_text())
    assert list(got) == list(sections)
    assert list(got["dup_groups"]) == [f'k"\n{k:05}' for k in range(5000)] and got["dup_groups"]['k"\n00042'] == ["a/é42", "b"]
    assert got["rows"] == [{"id": 1, "s": 'q"\n', "v": 0.5}, {"id": 2, "s": "x"}] and got["by id"] == {"1": {"s": 'q"\n', "v": 0.5}, "2": {"s": "x"}}
    assert (got["none"], got["empty"], got["threshold"], got["note"], got["nothing"]) == ({}, [], 4, 'a "b"', None)
    back = sources.report(spark, path, "dup_groups map<string, array<string>>, threshold int").first()
    assert len(back.dup_groups) == 5000 and back.threshold == 4


def test_box_table(spark):
    got = {r.id: r for r in catalog.QUERIES["box_deliverable"](spark, SF).collect()}
    found = {r.id: r for r in catalog.QUERIES["locate_crops"](spark, SF).collect()}
    matches = catalog.QUERIES["cross_collection_payloads"](spark, SF).collect()
    marks = {r.vec_id: r.label for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert got.keys() == found.keys()
    for i, r in got.items():
        if i % 3 != 1:
            assert all(r[c] == found[i][c] or r[c] != r[c] for c in ("x", "y", "match_score", "status", "ssim", "mae_masked_eval"))
        label = marks[i] % 2 if marks[i] < 8 else None
        assert (r.label, r.diagnosis) == (label, None if label is None else ("normal", "abnormal")[label])
        other = i + 1 if i % 3 == 0 else i - 1 if i % 3 == 1 else None
        assert r.duplicate_of_id == (other if other in got else None) and r.duplicate_of_component is None
        own = sorted((m.split, m.image_id, m.hamming_distance, m.iou) for m in matches if m.id == i and m.iou >= 0.5)
        assert r.matches == (";".join(f"{s}/{k}({d},iou={v:.2f})" for s, k, d, v in own) or None)
    crops, whole = kernels._pair(spark, SF)
    none = spark.createDataFrame([], "component string, id int, label int")
    table, summary = workflows.box_table(crops.where("id < 40"), whole, none, catalog.QUERIES["cross_collection_payloads"](spark, SF).limit(0), {}, threshold=90)
    assert table.count() == 40 and table.where("label is not null or matches is not null or duplicate_of_id is not null").count() == 0
    s = summary.first()
    fine = [found[i] for i in range(40)]
    assert s.n == 40 and s.ssim_mean == pytest.approx(sum(r.ssim for r in fine if r.ssim is not None) / sum(r.ssim is not None for r in fine))
