"""Spreadsheets (zipped XML) as a data source: sheets are read by the columns that are asked for, and written by tasks, with one file at the end or none."""

from __future__ import annotations

import datetime
import decimal
import gzip
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from brindle.sources.stores import located

# Fixed values of the format: its namespaces, the day that serial dates count from, and the most rows, columns and characters that it allows.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
BEGIN = datetime.datetime(1899, 12, 30)
MOST_ROWS, MOST_COLUMNS, MOST_CHARS, MOST_NAME = 1_048_576, 16_384, 32_767, 31
#: Rows that a task hands on together.
TOGETHER = 4096
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(reference: str) -> int:
    """B7 is 1."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _text(element) -> str:
    """The text of a string, its runs together, without phonetic hints."""
    out = []
    for e in element:
        if _local(e.tag) == "t":
            out.append(e.text or "")
        elif _local(e.tag) == "r":
            out += [t.text or "" for t in e if _local(t.tag) == "t"]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(out))


class Book:
    """An open workbook for reading."""

    def __init__(self, path: str):
        store, inner = located(path)
        self.zip = zipfile.ZipFile(store.open_input_file(inner))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {}
        for s in book.iter(f"{{{MAIN}}}sheet"):
            target = targets[s.get(f"{{{RELATED}}}id")]
            self.sheets[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.shared: list[str] | None = None

    def _string(self, k: int) -> str:
        if self.shared is None:
            with self.zip.open("xl/sharedStrings.xml") as f:
                self.shared = [_text(e) for _, e in ElementTree.iterparse(f) if _local(e.tag) == "si"]
        return self.shared[k]

    def rows(self, sheet: str | None, wanted: set[int] | None = None) -> Iterator[dict[int, tuple[str, str]]]:
        """Rows as {column: (kind, text)}; cells of other columns are passed over, and a row is dropped from memory once it is given."""
        if sheet is not None and sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet!r}; there are {list(self.sheets)}")
        with self.zip.open(self.sheets[sheet] if sheet is not None else next(iter(self.sheets.values()))) as f:
            data = None
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                name = _local(e.tag)
                if event == "start":
                    data = e if name == "sheetData" else data
                elif name == "row":
                    row, at = {}, -1
                    for c in e:
                        at = _column(c.get("r")) if c.get("r") else at + 1
                        if wanted is None or at in wanted:
                            kind = c.get("t", "n")
                            parts = {_local(x.tag): x for x in c}
                            if kind == "inlineStr":
                                row[at] = ("str", _text(parts["is"])) if "is" in parts else ("str", "")
                            elif "v" in parts:
                                value = parts["v"].text or ""
                                row[at] = ("str", self._string(int(value))) if kind == "s" else (kind, value)
                    yield row
                    data.clear()


def _value(cell: tuple[str, str] | None, kind: pa.DataType):
    """A cell as a value of a column; what can't be one is null."""
    if cell is None or cell[0] == "e":
        return None
    how, text = cell
    try:
        if pa.types.is_string(kind):
            return {"1": "true", "0": "false"}.get(text, text) if how == "b" else text
        if pa.types.is_boolean(kind):
            return {"1": True, "0": False, "true": True, "false": False}.get(text.strip().lower())
        if pa.types.is_integer(kind):
            exact = decimal.Decimal(text)
            return int(exact) if exact == int(exact) and -(1 << kind.bit_width - 1) <= exact < 1 << kind.bit_width - 1 else None
        if pa.types.is_floating(kind):
            return float(text)
        if pa.types.is_decimal(kind):
            return decimal.Decimal(text).quantize(decimal.Decimal(1).scaleb(-kind.scale))
        if pa.types.is_date(kind):
            return datetime.date.fromisoformat(text[:10]) if how in ("str", "d") else (BEGIN + datetime.timedelta(days=float(text))).date()
        if pa.types.is_timestamp(kind):
            at = datetime.datetime.fromisoformat(text) if how in ("str", "d") else BEGIN + datetime.timedelta(microseconds=round(float(text) * 86_400_000) * 1000)
            return at.replace(tzinfo=datetime.UTC) if kind.tz and at.tzinfo is None else at
    except (ValueError, ArithmeticError, OverflowError):
        return None
    raise TypeError(f"no cells of type {kind}")


def _files(path: str) -> list[str]:
    """The workbooks that a path stands for: itself, or those in a folder."""
    import pyarrow.fs as stores

    store, inner = located(path)
    if store.get_file_info(inner).type == stores.FileType.Directory:
        found = store.get_file_info(stores.FileSelector(inner, recursive=True))
        head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        return sorted(head + f.path for f in found if f.is_file and f.path.endswith(".xlsx"))
    return [path]


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.sheet = schema, options.get("sheet")
        self.path = options["path"]

    def partitions(self) -> list[_File]:
        return [_File(f) for f in _files(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        book = Book(partition.path)
        arrow = to_arrow_schema(self.schema)
        head = next(book.rows(self.sheet), {})
        names = {text: at for at, (_, text) in sorted(head.items(), reverse=True)}
        missing = [n for n in arrow.names if n not in names]
        if missing:
            raise ValueError(f"{partition.path}: no columns {missing}; there are {list(names)[::-1]}")
        wanted, held = [names[n] for n in arrow.names], []
        rows = book.rows(self.sheet, set(wanted))
        next(rows, None)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_value(r.get(k), t) for r in held], t) for k, t in zip(wanted, arrow.types)], schema=arrow)

        for row in rows:
            held.append(row)
            if len(held) == TOGETHER:
                yield batch()
                held = []
        if held:
            yield batch()


def _cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, decimal.Decimal)) and abs(v) < 10**15 or isinstance(v, float) and v - v == 0:
        return f"<c><v>{v!r}</v></c>" if isinstance(v, float) else f"<c><v>{v}</v></c>"
    if isinstance(v, datetime.datetime):
        return f'<c s="2"><v>{(v.replace(tzinfo=None) - BEGIN) / datetime.timedelta(days=1)!r}</v></c>'
    if isinstance(v, datetime.date):
        return f'<c s="1"><v>{(v - BEGIN.date()).days}</v></c>'
    text = str(v)  # also numbers that a sheet's 15 digits can't hold, inf and nan
    if len(text) > MOST_CHARS:
        raise ValueError(f"a cell holds at most {MOST_CHARS} characters; there are {len(text)}")
    text = _CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


@dataclass
class _Part(WriterCommitMessage):
    task: int
    rows: int
    path: str


class _Writer(DataSourceWriter):
    """Tasks write their rows as XML into a folder beside the workbook; the commit puts them into one file, piece by piece, and only then the workbook changes."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.path, self.overwrite = schema.names, options["path"], overwrite
        self.zoned = {k for k, f in enumerate(schema) if isinstance(f.dataType, TimestampType)}  # a worker sees these in its own time zone; sheets have UTC
        self.sheet = options.get("sheet", "Sheet1")
        if not self.sheet or len(self.sheet) > MOST_NAME or re.search(r"[\[\]:*?/\\]", self.sheet):
            raise ValueError(f"no sheet can be named {self.sheet!r}")
        if len(self.names) > MOST_COLUMNS:
            raise ValueError(f"over {MOST_COLUMNS} columns")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = located(self.parts)
        store.create_dir(folder, recursive=True)
        path, n = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}", 0
        with store.open_output_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1) as out:
            for n, row in enumerate(iterator, 1):
                cells = [v.astimezone(datetime.UTC) if v is not None and k in self.zoned else v for k, v in enumerate(row)]
                out.write(f"<row>{''.join(map(_cell, cells))}</row>".encode())
        return _Part(context.partitionId(), n, path)

    def commit(self, messages: list[_Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        rows = sum(m.rows for m in parts)
        if rows >= MOST_ROWS:
            raise ValueError(f"a sheet holds at most {MOST_ROWS} rows with its header; there are {rows}")
        store, target = located(self.path)
        before = {}
        if not self.overwrite and store.get_file_info(target).is_file:
            before = Book(self.path).sheets
        if self.sheet in before:
            raise ValueError(f"there is a sheet {self.sheet!r} already")
        folder = located(self.parts)[1]
        store.create_dir(folder, recursive=True)
        made = f"{folder}/book"
        with store.open_output_stream(made) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as out:
            _frame(out, [*before, self.sheet])
            if before:
                old = Book(self.path)
                for k, part in enumerate(before.values(), 1):
                    with old.zip.open(part) as a, out.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as b:
                        shutil.copyfileobj(a, b, 1 << 20)
            with out.open(f"xl/worksheets/sheet{len(before) + 1}.xml", "w", force_zip64=True) as b:
                b.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData><row>{"".join(map(_cell, self.names))}</row>'.encode())
                for m in parts:
                    with store.open_input_stream(m.path, compression=None) as a, gzip.GzipFile(fileobj=a) as text:
                        shutil.copyfileobj(text, b, 1 << 20)
                b.write(b"</sheetData></worksheet>")
        store.move(made, target)
        store.delete_dir(folder)

    def abort(self, messages: list[_Part | None]) -> None:
        import pyarrow.fs as stores

        store, folder = located(self.parts)
        if store.get_file_info(folder).type == stores.FileType.Directory:
            store.delete_dir(folder)


def _frame(out: zipfile.ZipFile, sheets: list[str]) -> None:
    """The parts of a workbook but for its sheets: a list of parts, the sheets' names, and two date formats."""
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    each = list(enumerate(sheets, 1))
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}worksheet+xml"/>' for k, _ in each)
    out.writestr("[Content_Types].xml", f'{xml}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/>{parts}</Types>')
    out.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELATED}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    out.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{MAIN}" xmlns:r="{RELATED}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in each) + "</sheets></workbook>")
    links = "".join(f'<Relationship Id="rId{k}" Type="{RELATED}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in each)
    out.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{PACKAGE}/relationships">{links}<Relationship Id="rId0" Type="{RELATED}/styles" Target="styles.xml"/></Relationships>')
    formats = "".join(f'<xf numFmtId="{n}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for n in (0, 14, 22))
    out.writestr("xl/styles.xml", f'{xml}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{formats}</cellXfs></styleSheet>')


class Workbook(DataSource):
    """format("workbook"): options path (a file, or for reading a folder of them) and sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        """Without a given schema all columns of the first file, as text."""
        head = next(Book(_files(self.options["path"])[0]).rows(self.options.get("sheet")), {})
        return StructType([StructField(text, StringType()) for _, (_, text) in sorted(head.items())])

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, dict(self.options), overwrite)


def sheet(spark: SparkSession, path: str, name: str | None = None, schema: str | None = None) -> DataFrame:
    """The columns that schema names of a sheet (the first one by default), or all as text; of a folder, those of all workbooks in it, a task each.

    Cells of other columns are neither decoded nor kept, and rows are streamed. A value that can't be one of its column's type is null, as is an empty cell; a missing column is an error.
    """
    spark.dataSource.register(Workbook)
    read = spark.read.format("workbook").option("path", path)
    read = read.option("sheet", name) if name is not None else read
    return (read.schema(schema) if schema else read).load()


def add_sheet(df: DataFrame, path: str, name: str, overwrite: bool = False) -> None:
    """Adds df as a sheet to a workbook, or begins a new one; rows keep the order of df's partitions.

    Each task writes its rows, and the commit joins them into one file as a stream, so neither a task nor the driver holds a sheet. The workbook is replaced by one move at the end:
    a failing task, a sheet of too many rows or a cell with too long a text leaves it as it was. Integers and decimals of more than 15 digits, inf and nan are written as text, which reading takes as numbers.
    """
    df.sparkSession.dataSource.register(Workbook)
    df.write.format("workbook").option("sheet", name).mode("overwrite" if overwrite else "append").save(path)
