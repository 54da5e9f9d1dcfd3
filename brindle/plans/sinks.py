"""Writers. Every stage writes a new path; nothing overwrites what it reads."""

from __future__ import annotations

import io
import json
import uuid

from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from brindle.sources.stores import located
from brindle.sources.workbook import add_sheet


def _bag(columns: list[str]) -> list[Column]:
    """Aggregates that tell whether two tables hold the same rows, as often, in these columns; none depends on their order."""
    h = F.xxhash64(*columns)
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string").alias("xor")]


def _observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, *metrics), seen


def csv(df: DataFrame, path: str) -> dict[str, int]:
    """Writes a CSV table with a header; gives the rows written and the nulls of each column, counted by the write itself."""
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls {c}") for c in df.columns]]
    watched, seen = _observed(df, "csv", *counts)
    watched.write.option("header", "true").csv(path)
    return dict(seen.get)


def workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A new spreadsheet file with a sheet for each table, in order."""
    for k, (name, df) in enumerate(sheets.items()):
        add_sheet(df, path, name, overwrite=k == 0)


def json_report(df: DataFrame, path: str) -> None:
    df.write.json(path)


def nested_report(sections: dict[str, DataFrame | tuple[DataFrame, str] | str | int | float | bool | None], path: str, order: dict[str, list[str]] | None = None) -> None:
    """One JSON document of named sections: a table as an array of its rows, a table with the name of a key column as an object of its rows (of their only other field, if there is but one), or a value.

    Spark writes each section as sorted lines, in as many tasks as it likes; these are then joined into one file as a stream, line by line, so nothing is held whole. The document takes its place by one
    move at the end. Keys should be different; null fields are left out.
    """
    spark = next(x[0] if isinstance(x, tuple) else x for x in sections.values() if isinstance(x, (tuple, DataFrame))).sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    store, folder = located(parts)
    store.create_dir(folder, recursive=True)
    try:
        with store.open_output_stream(f"{folder}/document") as out:
            for k, (name, x) in enumerate(sections.items()):
                out.write((("{" if k == 0 else ",") + f"\n {json.dumps(name)}: ").encode())
                if not isinstance(x, (tuple, DataFrame)):
                    out.write(json.dumps(x).encode())
                    continue
                df, key = x if isinstance(x, tuple) else (x, None)
                rest = [c for c in df.columns if c != key]
                one = F.to_json(F.array(F.col(rest[0]))) if key and len(rest) == 1 else F.to_json(F.struct(*rest))
                line = F.expr("substring(_one, 2, length(_one) - 2)") if key and len(rest) == 1 else F.col("_one")
                by = (order or {}).get(name) or ([key] if key else df.columns)
                named = df.orderBy(*by).withColumn("_one", one)
                if key:
                    head = F.to_json(F.array(F.col(key).cast("string")))
                    line = F.concat(F.substring(head, F.lit(2), F.length(head) - 2), F.lit(": "), line)
                named.select(line.alias("value")).write.text(f"{parts}/{k}")
                out.write(b"{" if key else b"[")
                first = True
                for info in sorted(store.get_file_info(FileSelector(f"{folder}/{k}")), key=lambda i: i.base_name):
                    if info.base_name.startswith("part-"):
                        with store.open_input_stream(info.path) as lines:
                            for text in io.BufferedReader(lines, 1 << 20):
                                out.write((b"\n  " if first else b",\n  ") + text.rstrip(b"\n"))
                                first = False
                out.write(b"\n }" if key else b"\n ]")
            out.write(b"\n}\n")
        store.move(f"{folder}/document", located(path)[1])
    finally:
        store.delete_dir(folder)


class RowsChanged(ValueError):
    """A version of a table that doesn't hold exactly the rows of the one before."""


def versioned(df: DataFrame, path: str, version: int, before: int | None = None) -> str:
    """Writes the next version of a table; earlier ones stay readable while later columns are built from them.

    With `before`, an earlier version that df only adds columns to: the write itself counts rows and sums up hashes over that version's columns. If a row was lost, doubled or changed, the version isn't
    published and RowsChanged says so; the earlier one stays the last. Map columns aren't compared.
    """
    spark = df.sparkSession
    out = f"{path}/version={version}"
    if before is None:
        df.write.parquet(out)
        return out
    old = spark.read.parquet(f"{path}/version={before}")
    columns = [c for c, kind in old.dtypes if "map<" not in kind]
    if missing := [c for c in old.columns if c not in df.columns]:
        raise RowsChanged(f"columns {missing} of version {before} are gone")
    made = f"{path}/.version={version}-{uuid.uuid4().hex}"
    watched, seen = _observed(df, "version", *_bag(columns))
    watched.write.parquet(made)
    fs, at = _hadoop(spark, made)
    want, got = old.agg(*_bag(columns)).first().asDict(), seen.get
    if got != want:
        fs.delete(at, True)
        said = "rows were lost or doubled" if got["rows"] != want["rows"] else "rows or values were changed"
        raise RowsChanged(f"version {version} has {got['rows']} rows, version {before} {want['rows']}: {said}")
    to = _hadoop(spark, out)[1]
    if fs.exists(to) or not fs.rename(at, to):  # into a folder that is there a rename would put the new one
        fs.delete(at, True)
        raise FileExistsError(out)
    return out


def _hadoop(spark, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def markdown_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(line) of a Markdown table; columns maps names to format strings such as %.4f."""
    cells = [F.coalesce(F.format_string(f, F.col(c)), F.lit("")) for c, f in columns.items()]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown(df: DataFrame, columns: dict[str, str], most: int = 10_000) -> str:
    """The whole table as text, for summaries; a table of more than `most` rows is refused, as it belongs in files (see markdown_rows)."""
    lines = [r["line"] for r in markdown_rows(df.limit(most + 1), columns).collect()]
    if len(lines) > most:
        raise ValueError(f"over {most} rows; write markdown_rows() as text instead")
    return "\n".join([f"| {' | '.join(columns)} |", "|" + "---|" * len(columns), *lines])


def plot_points(df: DataFrame, x: Column, y: Column, panel: str, flag: str) -> DataFrame:
    """(panel, x, y, flagged): what a scatter grid draws."""
    return df.select(F.col(panel).alias("panel"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.col(flag).alias("flagged"))


def counted_lines(counts: DataFrame) -> DataFrame:
    """(name, n): the columns of a one-row table of counts as lines."""
    each = [F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n")) for c in counts.columns]
    return counts.select(F.inline(F.array(*each)))


def console(counts: DataFrame, of: str | None = None) -> str:
    """Prints a one-row table of counts, a line each, with its share of the count named `of`; gives the text back."""
    row = counts.first()
    total = row[of] if of else None
    text = "\n".join(f"{c}: {row[c]}" + (f" ({row[c] / total:.1%})" if total and c != of else "") for c in counts.columns)
    print(text)
    return text
