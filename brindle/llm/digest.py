"""Canonical exact digests: folded text, wide xxhash, byte comparison inside equal buckets."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import documents, saved, with_unique

ROW = "id {kind}, n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double"


def canonical(text: str) -> bytes:
    """NFKC, case folded, NFKC again (folding may decompose), white space runs to one space, trimmed."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as much of the start of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(text: str, following: str) -> tuple:
    """What a row returns, given the next row's text. Likeness is 1 for equal canonical bytes, else 0."""
    new = edited(text, following)
    a, b, c = canonical(text), canonical(new), canonical(following)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, digest(a), digest(b), float(a == b), float(a == c), a


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row; null counts as empty."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "digest": [digest(canonical(t or "")) for t in b["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(work, f"id {kind}, digest string")


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbours within a sorted partition. The first text and the last row leave undone, for the partitions next to it.

    A row with mark 0 says that its id's digest occurs more than once; it precedes the texts (mark 1) of that id.
    """
    last = part = first_id = None
    shared_id, shared = None, False
    cols = ["id", *[x.split()[0] for x in ROW.split(", ")[1:]], "canon", "part", "state", "text"]

    def row(i, text, dup, following):
        n, sha, d, e, x, y, canon = _compared(text, following)
        return i, n, sha, d, e, x, y, canon if dup else None, None, 0, None

    for b in batches:
        out = []
        for p, i, mark, t in zip(b["part"], b["id"], b["mark"], b["text"]):
            i = None if pd.isna(i) else int(i)
            part = int(p)
            if mark == 0:
                shared_id, shared = i, True
                continue
            t = t or ""
            dup = shared and shared_id == i
            if last is None:
                out.append((i, None, None, None, None, None, None, None, part, 1, t))
            else:
                out.append(row(*last, t))
            last = (i, t, dup)
        if out:
            yield _frame(out, cols)
    if last is not None:
        i, t, dup = last
        yield _frame([(i, None, None, None, None, None, None, b"" if dup else None, part, 2, t)], cols)


def _frame(rows: list[tuple], cols: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=cols)
    for c in ("id", "n_chars", "part", "state"):
        out[c] = out[c].astype("Int64")
    for c in ("near_edited", "near_next"):
        out[c] = out[c].astype("Float64")
    return out


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["id", *[x.split()[0] for x in ROW.split(", ")[1:]], "canon", "part", "state", "text"]
    for b in batches:
        rows = []
        for i, t, dup, following in zip(b["id"], b["text"], b["dup"], b["following"]):
            n, sha, d, e, x, y, canon = _compared(t, following)
            rows.append((None if pd.isna(i) else int(i), n, sha, d, e, x, y, canon if dup else None, None, 0, None))
        yield _frame(rows, cols)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row beside the next by ascending id (after the last: the first), plus canon: the canonical bytes where the digest occurs again.

    The texts move once, by ranges of the id. What a partition can't know, its neighbour's first text, is settled afterwards from
    two texts a partition. Of several rows with one id (or with none) each is beside the next in some order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    each = saved(digests(rows, "id"), "digests")
    again = saved(each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").withColumn("again", F.lit(True)), "again")
    marks = with_unique(each, again, "digest", "n", each.count()).where("again").select("id").distinct()
    marks = saved(marks, "marks")
    both = rows.withColumn("mark", F.lit(1)).unionByName(marks.withColumn("text", F.lit(None).cast("string")).withColumn("mark", F.lit(0)))
    sorted_ = both.repartitionByRange("id").sortWithinPartitions("id", "mark").withColumn("part", F.spark_partition_id())
    schema = ROW.format(kind="long") + ", canon binary, part int, state int, text string"
    walked = saved(sorted_.mapInPandas(_walk, schema), "walked")
    # two rows a partition
    first = walked.where("state = 1").select("part", F.col("text").alias("following"))
    order = Window.orderBy("part")
    lead = first.withColumn("prev", F.lag("part").over(order)).withColumn("top", F.max("part").over(Window.partitionBy()))
    lead = lead.select(F.coalesce("prev", "top").alias("part"), "following")
    ends = walked.where("state = 2").select("part", "id", "text", F.col("canon").isNotNull().alias("dup"))
    ends = ends.join(lead, "part").select("id", "text", "dup", "following")
    done = walked.where("state = 0").unionByName(ends.mapInPandas(_finish, schema))
    return done.drop("part", "state", "text")


def collisions(done: DataFrame) -> DataFrame:
    """(digest, canon, variant from 0) of digests that different canonical texts share: the byte comparison inside equal buckets.

    Only digests that occur again have canon, and equal bytes meet in a partial aggregate before they move.
    """
    texts = done.where("canon is not null").groupBy("digest", "canon").agg(F.min("id").alias("least"))
    several = texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    order = Window.partitionBy("digest").orderBy("canon")
    return texts.join(several, "digest", "left_semi").withColumn("variant", F.row_number().over(order) - 1).drop("least")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Equal canonical texts have equal fingerprints and different ones different: should two share a digest, the later in byte order gets
    a suffix. Null counts as empty. An empty table gives an empty result; a single row is its own neighbour.
    """
    done = saved(neighbours(docs, id_col, text_col), "done")
    found = saved(collisions(done), "collisions")
    out = done.withColumn("fingerprint", F.col("digest"))
    if not found.isEmpty():
        out = done.join(found, ["digest", "canon"], "left")
        out = out.withColumn("fingerprint", F.when(F.col("variant") > 0, F.concat_ws("-", "digest", "variant")).otherwise(F.col("digest")))
    return out.select("id", "n_chars", "edited_sha256", "fingerprint", F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")


def op4_canonical_digest(spark, sf_dir) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
