"""What several operators share: tables in the shared folder, global ranks, joins that bear hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: A value counts as hot above one part in so many of all rows, so there are never more hot values than that.
HOT_PARTS = 1000
#: Hash buckets of flags_of().
FLAGS = 1 << 24

_written: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends there, so a lost executor costs only its running tasks.

    The shuffle files of that write go as soon as it is done, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that saved() returned, where no frame reads it any more."""
    path = df._brindle_path
    _written.remove(path)
    _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session sends Python at most so many rows at once, for whole texts: both sides hold a batch, beside a heap that doesn't shrink.

    A smaller number that is set already stays; no result depends on it.
    """
    now = int(spark.conf.get(ARROW_ROWS, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def written() -> int:
    """How many tables saved() has written and release() not deleted."""
    return len(_written)


def kept(df: DataFrame, name: str, since: int) -> DataFrame:
    """saved(), after which all other tables written after the first `since` are deleted: for a result that stands for all the work before it."""
    out = saved(df, name)
    for path in _written[since:-1]:
        _delete(df.sparkSession, path)
    del _written[since:-1]
    return out


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that saved() wrote after the first `since`; call it once no frame that reads them is needed."""
    while len(_written) > since:
        _delete(spark, _written.pop())


def flags_of(keys: DataFrame, columns: list[str], buckets: int = FLAGS) -> Column:
    """Which of a fixed number of hash buckets some key of a table falls in, 64 to a long: 2 MB at any size, so it can go to every task.

    flagged() is true for all keys of the table and for few others while these are fewer than the buckets; a join decides. So rows that have no partner needn't move.
    """
    at = _flag(*[F.col(c) for c in columns], buckets=buckets)
    hit = keys.select(F.shiftright(at, 6).alias("b"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63)).alias("on"))
    hit = hit.groupBy("b").agg(F.bit_or("on").alias("on"))
    every = keys.sparkSession.range(buckets // 64).select(F.col("id").cast("int").alias("b"))
    x = every.join(hit, "b", "left").select(F.struct("b", F.coalesce("on", F.lit(0).cast("bigint")).alias("on")).alias("x"))
    return saved(x.agg(F.sort_array(F.collect_list("x")).alias("f")).select(F.transform("f", lambda y: y["on"]).alias("f")), "flags").scalar()


def _flag(*columns: Column, buckets: int = FLAGS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def flagged(flags: Column, *columns: Column, buckets: int = FLAGS) -> Column:
    at = _flag(*columns, buckets=buckets)
    return F.call_function("shiftright", F.get(flags, F.shiftright(at, 6)), at.bitwiseAND(63)).bitwiseAND(F.lit(1)) == 1


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def in_order(df: DataFrame, order: Iterable[str], name: str) -> DataFrame:
    """df range-partitioned and sorted by order, saved, with the partition (_part) and the place in it (_at).

    Rows that tie on order may be dealt to several partitions by their input place, so repeated rows make no hot partition.
    """
    order = list(order)
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    numbered = dealt.withColumn("_n", F.monotonically_increasing_id())
    return saved(
        numbered.withColumn("_part", F.shiftright("_n", 33).cast("int"))
        .withColumn("_at", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_tie", "_n"),
        name,
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds _rank, from 0 and gapless within each value of keys, in the given order.

    No window over a key: rows are sorted by range, and each partition's count for a key is added up
    over the partitions before it. That table has a row for each partition and key that meet, which
    range partitioning holds to the number of partitions plus the number of keys.
    """
    from pyspark.sql import Window

    rows = in_order(df, [*keys, *order], name)
    parts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*keys, "_part"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    out = rows.alias("r").join(parts.alias("p"), cond)
    return out.select(*[f"r.{c}" for c in rows.columns if c not in ("_part", "_at")], (F.col("r._at") - F.col("p._first") + F.col("p._before")).alias("_rank"))


def with_unique(big: DataFrame, small: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of big with small, which has one row a key and big's number of rows for it in count.

    Keys with over a thousandth of all rows, at most a thousand of them, are broadcast, so their rows stay where
    they are; all others go through an ordinary join. big should be a saved table, as it is read twice.
    """
    least = total // HOT_PARTS
    hot = small.where(F.col(count) > least).drop(count)
    cold = small.where(F.col(count) <= least).drop(count)
    return (
        big.join(F.broadcast(hot), key)
        .unionByName(big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))
    )
