"""Contiguous shards of near equal bytes from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import documents, in_order, saved, text_of

SHARDS = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): documents by ascending id, cut where their running bytes pass equal parts of the total.

    A document belongs to the part in which its middle byte lies, so a shard is off its target by less than the longest
    document. Size is the text's UTF-8 bytes plus 1; null texts have size 1. Ties on the id go by size, then checksum; null ids come first.
    An empty table gives an empty result.

    The text itself never moves: a row is its id, size and checksum. Each partition of the sorted rows gives its bytes and rows, a
    running sum over those few totals tells where it starts, and places within it add to that.
    """
    text = F.encode(text_of(text_col), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = in_order(rows, ["id", "size", "text_crc32"], "sizes")
    parts = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    parts = parts.select("_part", start("_bytes").alias("_b0"), start("_rows").alias("_r0"), F.sum("_bytes").over(Window.partitionBy()).alias("_total"))
    parts = saved(parts, "parts")
    here = Window.partitionBy("_part").orderBy("_at")
    rows = rows.withColumn("_end", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    # one row a partition: its number is fixed by the shuffle, not by the data
    rows = rows.join(F.broadcast(parts), "_part")
    middle = 2 * (F.col("_b0") + F.col("_end")) - F.col("size")
    shard = F.expr(f"least({shards - 1}, cast(_middle * {shards} div (2 * _total) as int))")
    rows = rows.withColumn("_middle", middle).withColumn("shard", shard).withColumn("_row", F.col("_r0") + F.col("_at"))
    rows = saved(rows.select("id", "size", "text_crc32", "shard", "_row"), "sharded")
    # at most `shards` rows
    first = rows.groupBy("shard").agg(F.min("_row").alias("_first"))
    return rows.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def op3_byte_shards(spark, sf_dir) -> DataFrame:
    out = byte_shards(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is worked out bit by bit, as SQL has no such function.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT doc_id, octet_length(b) + 1 AS size, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT) AS v FROM d),
s AS (SELECT doc_id, size::BIGINT AS size, xor(4294967295::BIGINT, list_reduce(v, lambda a, x:
  list_reduce(range(8), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(3988292384::BIGINT, y >> 1) ELSE y >> 1 END, xor(a, x)), 4294967295::BIGINT)) AS text_crc32 FROM c),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS e, sum(size) OVER () AS total FROM s),
h AS (SELECT *, least(7, ((2 * e - size) * 8) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM h
"""
