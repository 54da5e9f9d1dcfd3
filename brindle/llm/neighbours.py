"""Quality by nearest neighbours: labelled documents as latent-semantic vectors, exact cosines to all of them, votes weighted by similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import documents
from brindle.llm.words import chunks, coded, hashes

#: Hash buckets of words (letters and digits alone, lower case), of their shapes, of pairs of shapes side by side; and whether a word repeats the one before it.
WORDS, SHAPES, PAIRS, REPEATS = 1 << 12, 1 << 9, 1 << 11, 2
FEATURES = WORDS + SHAPES + PAIRS + REPEATS
#: How much each of these families counts in a cosine before the projection.
WEIGHTS = (0.5, 1.0, 1.0, 1.0)
#: Labelled rows that are fitted on and vote, the first by a hash of the id; everything else covers all rows. They and the projection, 4 MB, go to every task.
FIT_ROWS = 4096
#: Latent dimensions.
LATENT = 64
#: Neighbours that vote, and the power of the similarity that weights a vote.
VOTERS, POWER = 15, 8
GOOD = 0.7
#: Documents that are worked on together.
BLOCK = 256


def counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts by feature) of blocks of texts, over the whole texts; null counts as empty."""
    offsets, codes, words = coded(pc.fill_null(texts, ""))
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    rows, codes = rows[full], codes[full]
    bucket = lambda x, n: (hashes(x) % np.uint64(n)).astype(np.int64)
    bare = pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}\p{N}]+", ""))
    shape = words
    for kind, to in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0"), (r"\p{Lo}+", "x")):
        shape = pc.replace_substring_regex(shape, kind, to)
    word, form = bucket(bare, WORDS)[codes], bucket(shape, SHAPES)[codes]
    beside = np.flatnonzero(rows[1:] == rows[:-1])
    pair = (form[beside] * 31 + form[beside + 1]) % PAIRS
    again = (codes[beside] == codes[beside + 1]).astype(np.int64)
    begin = np.cumsum([0, WORDS, SHAPES, PAIRS])
    families = [(rows, word + begin[0]), (rows, form + begin[1]), (rows[beside], pair + begin[2]), (rows[beside], again + begin[3])]
    for a in range(0, len(texts), BLOCK):
        z = min(len(texts), a + BLOCK)
        x = np.zeros((z - a) * FEATURES, np.int64)
        for r, f in families:
            k = slice(*np.searchsorted(r, [a, z]))
            x += np.bincount((r[k] - a) * FEATURES + f[k], minlength=len(x))
        yield a, x.reshape(-1, FEATURES)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """(documents, how many of them have each feature). A task adds up its own, so a row a feature and task is all that moves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for b in chunks(batch, "text"):
                n += len(b)
                for _, x in counts(b.column("text")):
                    df += (x > 0).sum(0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["feature", "df"])

    out, total = np.zeros(FEATURES, np.int64), 0
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(work, "feature bigint, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        if r["feature"] < 0:
            total = r["df"]
        else:
            out[r["feature"]] = r["df"]
    return total, out


def weighted(x: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Roots of each family's shares, so that length doesn't matter, times rarity; each family then has its weight's length, or none where it has no counts."""
    out = np.sqrt(x, dtype=np.float32) * rarity
    at = 0
    for size, weight in zip((WORDS, SHAPES, PAIRS, REPEATS), WEIGHTS):
        part = out[:, at : at + size]
        length = np.linalg.norm(part, axis=1)
        part *= (weight / np.where(length > 0, length, 1))[:, None]
        at += size
    return out


@dataclass
class Voters:
    """Labelled documents as unit vectors in the latent space, and the way into it."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    good: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        y = weighted(x, self.rarity) @ self.axes
        length = np.linalg.norm(y, axis=1)[:, None]
        return np.where(length > 1e-6, y / np.maximum(length, 1e-6), 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Share of the votes for good of the nearest labelled documents, each vote weighted by its cosine; without any similar one the share of good among all."""
        n = len(self.good)
        if not n:
            return np.full(len(x), 0.5)
        # cosines as integers, equal ones by place: blocks of other sizes may round the last bit otherwise
        cosines = np.rint((self.place(x) @ self.vectors.T) * 1e5).astype(np.int64)
        keys = cosines * n - np.arange(n)
        k = min(VOTERS, n)
        near = np.argpartition(keys, n - k, axis=1)[:, n - k :]
        weight = np.maximum(0, np.take_along_axis(cosines, near, 1) / 1e5) ** POWER
        total = weight.sum(1)
        share = (weight * self.good[near]).sum(1) / np.where(total > 1e-12, total, 1)
        return np.round(np.where(total > 1e-12, np.clip(share, 0, 1), self.good.mean()), 6)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Voters:
    """The labelled documents' vectors: counts weighted by rarity over all documents, on the leading singular directions of the labelled ones' matrix.

    Of several labels for an id the lowest holds; null labels and labels without a document don't vote. At most `rows` documents, as counts, reach the driver.
    """
    total, df = document_frequencies(docs, text_col)
    rarity = (1 + np.log((1 + total) / (1 + df))).astype(np.float32)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("good"))
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # labels without a document take no place in the sample
    chosen = marks.join(some.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                for a, x in counts(b.column("text")):
                    r, f = np.nonzero(x)
                    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(x)))]), pa.int32())
                    lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int64))) for v in (f, x[r, f])]
                    yield pa.RecordBatch.from_arrays([*b.slice(a, len(x)).select(["id", "good"]).columns, *lists], names=["id", "good", "f", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = some.join(F.broadcast(chosen), "id").mapInArrow(work, f"id {kind}, good int, f array<bigint>, n array<bigint>")
    one = found.groupBy("id").agg(F.min_by(F.struct("good", "f", "n"), F.xxhash64("f", "n")).alias("x"))  # an id with several texts votes once
    got = one.orderBy("id").select("x.*").toArrow()
    good = got.column("good").to_numpy().astype(np.int64)
    matrix = np.zeros((len(good), FEATURES), np.float32)
    f, n = (got.column(c).combine_chunks() for c in ("f", "n"))
    size = pc.list_value_length(f).to_numpy() if len(good) else np.zeros(0, np.int64)
    if len(good):
        matrix[np.repeat(np.arange(len(good)), size), f.flatten().to_numpy()] = n.flatten().to_numpy()
    x = weighted(matrix, rarity)
    out = Voters(rarity, _axes(x), np.zeros((0, LATENT), np.float32), good)
    out.vectors = np.concatenate([out.place(matrix[a : a + BLOCK]) for a in range(0, len(good), BLOCK)]) if len(good) else out.vectors
    return out


def _axes(x: np.ndarray) -> np.ndarray:
    """The leading right singular vectors, by a random projection and four power steps: the same for the same rows."""
    n = min(LATENT, *x.shape)
    if not n:
        return np.zeros((x.shape[1], LATENT), np.float32)
    y = x @ np.random.default_rng(0).standard_normal((x.shape[1], min(n + 16, len(x)))).astype(np.float32)
    for _ in range(4):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    return np.linalg.svd(np.linalg.qr(y)[0].T @ x, full_matrices=False)[2][:n].T.copy()


def scored(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, by its own whole text: no shuffle. Null, empty and blank texts have no neighbours and get the share of good among the voters, or 0.5 without any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                s = [voters.scores(x) for _, x in counts(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.concatenate(s))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, score double")


def judged(docs: DataFrame, labels: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score, predicted) for every row of docs; labels for which held_out (a condition over the id column) holds don't vote.

    Only texts are inputs. Repeated rows are scored alike, each in a row of its own; other columns aren't read; empty tables give no rows.
    """
    known = labels if held_out is None else labels.where(~F.coalesce(held_out, F.lit(True)))
    out = scored(docs, fit(docs, known, id_col, text_col, label_col), id_col, text_col)
    return out.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op11_quality_neighbours(spark, sf_dir) -> DataFrame:
    held_out = lambda c: F.crc32(F.col(c).cast("string")) % 4 == 2
    out = judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out("doc_id"))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", "predicted")
