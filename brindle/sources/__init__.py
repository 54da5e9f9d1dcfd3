"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.payload import base64_of, decoded, encoded, headers  # noqa: F401
from brindle.sources.workbook import sheet  # noqa: F401

LABELS = "filename string, label int"
ENCODED = "image_id int, b64 string"
CAPTIONS = "text string, image_ids array<int>"
BOXES = (
    "component string, id int, x int, y int, width int, height int, match_score double, peak_margin double, near_exact_fraction double, "
    "mae double, rmse double, ssim double, pearson_corr double, hist_intersection double"
)


def _named(df: DataFrame, path: str) -> DataFrame:
    """Adds component (the folder), stem and id: the stem as a number, null for names such as 972(1)."""
    part = lambda p: F.regexp_extract(path, p, 1)
    df = df.withColumns({"component": part(r"([^/]+)/[^/]+$"), "stem": part(r"([^/]+)\.[^./]+$")})
    return df.withColumn("id", F.expr("try_cast(stem as int)"))


def listing(spark: SparkSession, path: str, pattern: str = "*.jpg", without: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, component, stem, id) of files below path; contents aren't read. Files of the folders in `without` are left out."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    return _named(df, "path").where(~F.col("component").isin(*without) if without else F.lit(True))


def contents(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, content, component, stem, id)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return _named(df, "path")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(component, stem, id, height, width, nChannels, mode, data) by the JVM's decoder; files that aren't images are dropped."""
    df = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return _named(df.select("image.*"), "origin").drop("origin")


def dimensions(spark: SparkSession, path: str) -> DataFrame:
    """(component, id, height, width) from the frame header of each JPEG: a few ranges of each file are read, no pixels are decoded. Other files give no row."""
    return headers(listing(spark, path)).where("status = 'ok'").select("component", "id", "height", "width")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(component, id, label) from <component>/<component>.txt, tab separated, without a header."""
    df = spark.read.option("sep", "\t").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").schema(LABELS).csv(path)
    df = df.select("*", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("component"))
    return df.select("component", F.expr("try_cast(regexp_extract(filename, '^([^.]+)', 1) as int)").alias("id"), "label")


def encoded_images(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(split, image_id, content) from lines of id, tab, base64; lines that don't decode have null content."""
    df = spark.read.option("sep", "\t").option("maxCharsPerColumn", "-1").schema(ENCODED).csv(path)
    return df.select(F.lit(split).alias("split"), "image_id", F.try_to_binary("b64", F.lit("base64")).alias("content"))


def captions(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(split, text, image_id), each once."""
    df = spark.read.schema(CAPTIONS).json(path)
    return df.select(F.lit(split).alias("split"), "text", F.explode("image_ids").alias("image_id")).dropDuplicates()


def table(spark: SparkSession, path: str, schema: str = BOXES) -> DataFrame:
    """A CSV table with a header, in which inf, -inf and nan are numbers."""
    return spark.read.option("header", "true").option("negativeInf", "-inf").option("positiveInf", "inf").option("nanValue", "nan").schema(schema).csv(path)


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A nested JSON document."""
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def layered(parts: dict[str, DataFrame], name: str = "layer") -> DataFrame:
    """One table of several with like columns, each tagged by its name."""
    out = None
    for tag, df in parts.items():
        df = df.withColumn(name, F.lit(tag))
        out = df if out is None else out.unionByName(df)
    return out
