"""Files in any store that Arrow knows, for code that runs outside Spark's own readers and writers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def located(path: str):
    """(store, path in it); file:/x, as Spark writes it, and plain paths are local or mounted."""
    import pyarrow.fs as stores

    if not re.match(r"[A-Za-z][\w+.-]*:/", path):
        return stores.LocalFileSystem(), path
    return stores.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def opened(path: str):
    """A file for random access."""
    store, inner = located(path)
    return store.open_input_file(inner)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where the session names none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that what follows neither repeats it nor depends on the executors that made it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
