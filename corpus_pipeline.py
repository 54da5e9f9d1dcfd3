"""From documents to packed sequences: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import lines, mixing, packing, rules, simhash
from brindle.llm.common import documents, release, shared_dir, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a learned rule rejects go."""
    return rules.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; n_chars follows the text."""
    out = lines.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the smallest id.

    Links are those of SimHash fingerprints, by their grid and exact check, and those of shingle sets that are too far apart for them.
    """
    return simhash.without_near_copies(docs, of=simhash.copy_components)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which their sources' blocks are scheduled."""
    return mixing.in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document's ids: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences follow the order in which the mixing stage's files hold the documents.
    """
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path(packing.VOCABULARY), place=mixing.stored_order(docs)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("pfair_mixing", mix),
    ("best_fit_packing", pack),
]
#: Learned rules, components, schedules and packing are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        tables = written()
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/brindle/stage-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        release(spark, tables)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
