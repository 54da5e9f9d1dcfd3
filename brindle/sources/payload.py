"""Encoded images in columns and files: pixels, and sizes from headers alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from brindle.raster import jpeg, png
from brindle.sources.stores import opened

#: Decoded bytes that are handed on together, so that a batch of payloads isn't held as pixels all at once.
TOGETHER = 16 << 20
#: Bytes that are read at a time while a header is walked.
BLOCK = 512
PIXELS = [StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("nChannels", IntegerType()), StructField("mode", IntegerType()), StructField("data", BinaryType()), StructField("status", StringType())]


def _pixels(content: bytes | None) -> tuple[np.ndarray | None, str]:
    if not content:
        return None, "empty"
    try:
        return (png if content.startswith(png.SIGNATURE) else jpeg).decoded(content), "ok"
    except jpeg.Unreadable as e:
        return None, str(e)


def decoded(df: DataFrame, content: str = "content", together: int = TOGETHER) -> DataFrame:
    """df with the pixels of an encoded image instead of its content: height, width, nChannels, mode and data as Spark's image source has them, and a status.

    JPEG (sequential or progressive, gray or colour) and PNG of 8 bits. Content that is null or can't be decoded has null pixels and a status that says why:
    empty, no jpeg, unsupported, truncated or corrupt; no row goes. Columns of these names in df are replaced.
    """
    made = {f.name for f in PIXELS}
    keep = [c for c in df.columns if c != content and c not in made]
    schema = StructType([*[df.schema[c] for c in keep], *PIXELS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, size = 0, [], 0

            def flush(end: int) -> pa.RecordBatch:
                columns = [b.column(c).slice(at, end - at) for c in keep]  # noqa: B023
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                return pa.RecordBatch.from_arrays([*columns, *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], names=schema.names)  # noqa: B023

            for k, value in enumerate(b.column(content)):
                a, status = _pixels(value.as_py())
                if a is None:
                    rows.append((None, None, None, None, None, status))
                else:
                    data = np.ascontiguousarray(a).tobytes()
                    channels = 1 if a.ndim == 2 else a.shape[2]
                    rows.append((a.shape[0], a.shape[1], channels, 8 * (channels - 1), data, status))
                    size += len(data)
                if size >= together:
                    yield flush(k + 1)
                    at, rows, size = k + 1, [], 0
            if rows:
                yield flush(len(b))

    return df.select(*keep, content).mapInArrow(work, schema)


def encoded(df: DataFrame, name: str = "content") -> DataFrame:
    """df with a PNG file in place of height, width and data; null pixels give null."""
    gone = {"height", "width", "nChannels", "mode", "data", "status", name}
    keep = [c for c in df.columns if c not in gone]
    schema = StructType([*[df.schema[c] for c in keep], StructField(name, BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, data in zip(*(b.column(c).to_pylist() for c in ("height", "width", "data"))):
                a = None if data is None else np.frombuffer(data, np.uint8)
                out.append(None if a is None else png.encoded(a.reshape(h, w) if len(a) == h * w else a.reshape(h, w, -1)[..., :3]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.binary())], names=schema.names)

    return df.select(*keep, "height", "width", "data").mapInArrow(work, schema)


class Ranges:
    """Reads parts of a file, a block at a time, and counts what it has read."""

    def __init__(self, file, block: int = BLOCK):
        self.file, self.block, self.size = file, block, file.size()
        self.begin, self.held, self.bytes = 0, b"", 0

    def __call__(self, start: int, size: int) -> bytes:
        if start < self.begin or start + size > self.begin + len(self.held):
            self.file.seek(min(start, self.size))
            self.begin, self.held = start, self.file.read(max(size, self.block))
            self.bytes += len(self.held)
        return self.held[start - self.begin : start - self.begin + size]


def headers(files: DataFrame) -> DataFrame:
    """files, of which path names a JPEG, with height, width, nChannels, bytes_read and status.

    Marker segments are walked by their lengths up to the frame header, so neither pixels nor what an application segment holds (a thumbnail, say) are read: about a block a segment, whatever
    the size of the file. Files that are no JPEG or end too early have null sizes and a status.
    """
    made = [StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("nChannels", IntegerType()), StructField("bytes_read", LongType()), StructField("status", StringType())]
    keep = [c for c in files.columns if c not in {f.name for f in made}]
    schema = StructType([*[files.schema[c] for c in keep], *made])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                with opened(path) as file:
                    read = Ranges(file)
                    try:
                        rows.append((*jpeg.dimensions(read), read.bytes, "ok"))
                    except jpeg.Unreadable as e:
                        rows.append((None, None, None, read.bytes, str(e)))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *columns], names=schema.names)

    return files.select(*keep).mapInArrow(work, schema)


def base64_of(content: str = "content"):
    """The text that a payload table holds for a binary column: no line breaks."""
    return F.translate(F.base64(content), "\r\n", "")
