"""Spreadsheets: round trips by column, foreign files, limits, and what a failing write leaves behind."""

import datetime as dt
import decimal
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from brindle import sources
from brindle.plans import catalog, sinks
from brindle.sources import workbook

SCHEMA = "id long, name string, x double, ok boolean, day date, at timestamp, price decimal(20,3)"


def test_sheets_are_read_back_by_columns(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    rows = [
        (1, " a <b> & \"c\" ", 1.5, True, dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 12, 30, 15, 250000), decimal.Decimal("12.345")),
        (2, "", float("inf"), False, dt.date(1900, 3, 1), dt.datetime(1999, 12, 31, 23, 59, 59), decimal.Decimal("-0.001")),
        (None, None, None, None, None, None, None),
        ((1 << 63) - 1, "line\nbreak\ttab \x01 _x0041_ \r é 日本 🙂", float("nan"), None, None, None, decimal.Decimal("12345678901234567.891")),
        (-7, "x" * 32767, -0.1 - 0.2, True, dt.date(2099, 1, 1), None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    more = spark.range(0, 10_000, 1, 7).select("id", (F.col("id") * 3).alias("three"), F.lit(None).cast("string").alias("none"))
    sinks.workbook({"all kinds": df.coalesce(1), "many & more": more, "empty": df.limit(0)}, path)
    assert os.listdir(tmp_path) == ["book.xlsx"]
    got = [tuple(r) for r in sources.sheet(spark, path, "all kinds", SCHEMA).collect()]
    assert repr(got) == repr(rows)
    some = sources.sheet(spark, path, "many & more", "three long")
    assert some.columns == ["three"] and [r.three for r in some.collect()] == [3 * k for k in range(10_000)]
    assert sources.sheet(spark, path, "empty").columns == df.columns and sources.sheet(spark, path, "empty").count() == 0
    text = sources.sheet(spark, path, "all kinds").first()
    assert text.id == "1" and text.ok == "true"
    assert sources.sheet(spark, path, "all kinds", "name long, x boolean").collect()[0] == (None, None)
    with pytest.raises(Exception, match="no columns"):
        sources.sheet(spark, path, "empty", "other long").collect()
    with pytest.raises(Exception, match="no sheet"):
        sources.sheet(spark, path, "none").collect()


def test_a_folder_of_workbooks(spark, tmp_path):
    for k in range(3):
        sinks.workbook({"s": spark.range(k + 1).withColumn("k", F.lit(k))}, str(tmp_path / f"{k}.xlsx"))
    df = sources.sheet(spark, str(tmp_path), None, "k int")
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r.k for r in df.collect()) == [0, 1, 1, 2, 2, 2]


def test_files_of_other_programs(spark, tmp_path):
    """Shared strings with runs, absolute targets, cells by reference with gaps, errors, formula results and ISO dates."""
    path = tmp_path / "other.xlsx"
    main = workbook.MAIN
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{workbook.RELATED}"><sheets><sheet name="first" sheetId="9" r:id="rA"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rA" Target="/xl/worksheets/odd.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>bo</t></r><r><rPr/><t>ld</t></r><rPh><t>hint</t></rPh></si><si><t>n</t></si><si><t>day</t></si></sst>')
        cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c><c r="AA1" t="s"><v>3</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><f>1+1</f><v>2</v></c><c r="AA2" t="d"><v>2024-05-06</v></c></row>'
        cells += '<row r="5"><c r="C5" t="e"><v>#DIV/0!</v></c><c r="AA5" s="1"><v>45000</v></c></row><row r="6"><c r="A6" t="str"><f>A1</f><v>made</v></c><c r="C6"><v>2.5</v></c></row>'
        z.writestr("xl/worksheets/odd.xml", f'<worksheet xmlns="{main}"><cols/><sheetData>{cells}</sheetData></worksheet>')
    got = [tuple(r) for r in sources.sheet(spark, str(path), schema="day date, n int, name string").collect()]
    assert got == [(dt.date(2024, 5, 6), 2, "bold"), (dt.date(2023, 3, 15), None, None), (None, None, "made")]


def test_a_failing_write_leaves_the_workbook_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "book.xlsx")
    sinks.workbook({"a": spark.range(3)}, path)
    before = (tmp_path / "book.xlsx").read_bytes()
    long_text = spark.range(4).select(F.when(F.col("id") == 3, F.repeat(F.lit("x"), 40_000)).otherwise("y").alias("t"))
    for df, name, said in ((long_text, "b", "characters"), (spark.range(3), "a", "already"), (spark.range(3), "x/y", "named"), (spark.range(0, 1_048_576, 1, 4).select(F.lit(None).cast("int").alias("v")), "c", "rows")):
        with pytest.raises(Exception, match=said):
            workbook.add_sheet(df, path, name)
        assert (tmp_path / "book.xlsx").read_bytes() == before and os.listdir(tmp_path) == ["book.xlsx"]
    workbook.add_sheet(spark.range(2), path, "d")
    assert list(workbook.Book(path).sheets) == ["a", "d"] and sources.sheet(spark, path, "d", "id int").count() == 2


def test_query_writes_and_reads_sheets(spark):
    got = catalog.QUERIES["workbook_columns"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) > 4
