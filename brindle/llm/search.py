"""Ranked lexical search: hashed sketches of maxima bound every score, exact rescoring goes down the bounds to a threshold."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import documents, flagged, flags_of, saved
from brindle.llm.words import chunks, coded, hashes

#: A term is a run of ASCII letters and digits and of anything beyond ASCII; A-Z count as a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Coordinates of a sketch. Only those that some term falls on are stored, so a document of n different terms shares one with a foreign term in n / 2^16 of cases.
WIDTH = 1 << 16
TOP = 20
#: Items that are looked up together, and their different terms: what every task is sent.
ITEMS, TERMS = 512, 100_000
#: Entries of (document, item) that are worked on together.
CELLS = 1 << 21


def folded(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and a space for each character outside terms; null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = (data[offsets[0] : offsets[-1]].to_pybytes() if data else b"").translate(_FOLD)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data)])


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(document, code, how often) for each different term of each text, sorted, and the terms by code."""
    offsets, codes, words = coded(folded(texts))
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), words
    rows = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[codes]
    keys, n = np.unique(rows[full] * len(words) + codes[full], return_counts=True)
    return keys // len(words), keys % len(words), n, words


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, at, most): terms of the whole text with repeats, the sketch's coordinates in use and the highest count of a term on each.

    A term's part of a score grows with its count and nothing else in a document, so the maximum of counts is the maximum of impacts once the corpus' totals are known.
    One pass without a shuffle. Rows without an id take no part; a null text has no terms.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                rows, codes, tf, words = counted(b.column("text"))
                n = np.bincount(rows, tf, len(b)).astype(np.int64)
                at = (hashes(words) % np.uint64(WIDTH)).astype(np.int64)[codes]
                order = np.lexsort((at, rows))
                rows, at, tf = rows[order], at[order], tf[order]
                first = np.flatnonzero(np.diff(rows * WIDTH + at, prepend=-1))
                most = np.maximum.reduceat(tf, first) if len(first) else tf
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows[first], minlength=len(b)))])
                places, most = at[first].astype("<u2").tobytes(), most.astype("<u4").tobytes()
                cut = lambda data, size: pa.array([data[size * p : size * q] for p, q in zip(ends, ends[1:])], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n), cut(places, 2), cut(most, 4)], names=["doc", "n", "at", "most"])

    some = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    return some.mapInArrow(work, "doc bigint, n bigint, at binary, most binary")


@dataclass
class Queries:
    """Items whose terms are numbered: terms, and (item, term, how often) in parallel arrays."""

    names: list
    terms: list[bytes]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def blocks(items: DataFrame, item_col: str, text_col: str, most: int = ITEMS, terms: int = TERMS) -> Iterator[Queries]:
    """The items, repeated rows once, in blocks of bounded size; one block at a time is on the driver. Items without terms give no rows anywhere and are left out."""
    numbers: dict[bytes, int] = {}
    names, entries = [], []

    def block() -> Queries:
        item, term, times = (np.array(x, np.int64) for x in zip(*entries))
        return Queries(list(names), list(numbers), item, term, times)

    for row in items.select(item_col, text_col).where(F.col(text_col).isNotNull()).distinct().orderBy(item_col, text_col).toLocalIterator():
        found = Counter(row[1].encode("utf-8", "replace").translate(_FOLD).split())
        if names and (len(names) == most or len(numbers) + len(found) > terms):
            yield block()
            numbers, names, entries = {}, [], []
        if found:
            entries += [(len(names), numbers.setdefault(t, len(numbers)), c) for t, c in found.items()]
            names.append(row[0])
    if names:
        yield block()


def frequencies(docs: DataFrame, terms: list[bytes], text_col: str = "text") -> np.ndarray:
    """How many documents hold each term. A task adds its documents up, so it gives a row a term at most."""
    wanted = pa.array([t.decode() for t in terms], pa.large_string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for b in chunks(batch, "text"):
                _, codes, _, words = counted(b.column("text"))
                known = pc.fill_null(pc.index_in(words.cast(pa.large_string()), wanted), -1).to_numpy(zero_copy_only=False)[codes]
                df += np.bincount(known[known >= 0], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(work, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


@dataclass
class Scorer:
    """Scores of one block of items over a corpus of N documents with L terms."""

    queries: Queries
    weight: np.ndarray
    N: int
    L: int

    def damping(self, n: np.ndarray) -> np.ndarray:
        """12 * m of documents with n terms, in Python's integers as the product may leave 64 bits."""
        return np.array([12 * (75 + 25 * int(x) * self.N // self.L) for x in n], np.int64)

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each coordinate its number among those in use (-1: none); for each of these where its items begin; items and weights.

        Terms of an item on one coordinate are added up: each of them can be the maximum."""
        q = self.queries
        at = (hashes(pa.array([t.decode() for t in q.terms], pa.large_string())) % np.uint64(WIDTH)).astype(np.int64)[q.term]
        keys, back = np.unique(at * len(q.names) + q.item, return_inverse=True)
        weights = np.bincount(back, q.times * self.weight[q.term], len(keys))
        used, first = np.unique(keys // len(q.names), return_index=True)
        number = np.full(WIDTH, -1)
        number[used] = np.arange(len(used))
        return number, np.append(first, len(keys)), keys % len(q.names), weights

    def bounds(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, upper bounds by item) of a batch of sketches. All products and sums are below 2^53, so doubles hold them exactly."""
        number, first, items, weights = self.lookup()
        m = self.damping(batch.column("n").to_numpy())
        ends = np.cumsum(pc.binary_length(batch.column("at")).to_numpy()) // 2
        at = np.frombuffer(b"".join(batch.column("at").to_pylist()), "<u2")
        tf = np.frombuffer(b"".join(batch.column("most").to_pylist()), "<u4").astype(np.int64)
        docs, width = batch.column("doc").to_numpy(), len(self.queries.names)
        step = max(1, CELLS // width)
        for a in range(0, len(docs), step):
            z = min(len(docs), a + step)
            lo, hi = (ends[a - 1] if a else 0), ends[z - 1]
            rows = np.repeat(np.arange(z - a), np.diff(ends[a:z], prepend=lo))
            sums = np.zeros((z - a) * width)
            at_, tf_ = number[at[lo:hi]], tf[lo:hi]
            hit = np.flatnonzero(at_ >= 0)
            part = 1_000_000_000 * tf_[hit] // (1000 * tf_[hit] + m[a + rows[hit]])
            size = first[at_[hit] + 1] - first[at_[hit]]
            for k in _runs(size, CELLS):
                s, r = size[k], rows[hit[k]]
                place = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(first[at_[hit[k]]], s)
                sums += np.bincount(np.repeat(r, s) * width + items[place], np.repeat(part[k], s) * weights[place], len(sums))
            yield docs[a:z], sums.reshape(-1, width)

    def score(self, rows: np.ndarray, words: np.ndarray, tf: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Exact scores of (row, item) pairs from the terms (as numbers of this block, -1 none) of rows."""
        q = self.queries
        known = words >= 0
        width = len(q.terms)
        keys = rows[known] * width + words[known]  # sorted by row; terms aren't
        order = np.argsort(keys)
        keys, tf = keys[order], tf[known][order]
        by_item = np.searchsorted(q.item, np.arange(len(q.names) + 1))
        size = by_item[pairs[:, 1] + 1] - by_item[pairs[:, 1]]
        out = np.zeros(len(pairs), np.int64)
        m = self.damping(n)
        for k in _runs(size, CELLS):
            s = size[k]
            e = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(by_item[pairs[k, 1]], s)
            want = np.repeat(pairs[k, 0], s) * width + q.term[e]
            at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            hit = np.flatnonzero(keys[at] == want) if len(keys) else np.zeros(0, np.int64)
            t = tf[at[hit]]
            part = q.times[e[hit]] * self.weight[q.term[e[hit]]] * (1_000_000_000 * t // (1000 * t + m[np.repeat(pairs[k, 0], s)[hit]]))
            np.add.at(out, np.repeat(k, s)[hit], part)
        return out


def _runs(size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Consecutive indexes whose sizes add up to about `most` at a time."""
    if len(size):
        yield from np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1)


class Best:
    """The highest bounds of each item so far, equal ones by document: at most `top` an item, however many are shown."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.zeros(items)
        self.item, self.doc, self.bound = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, docs: np.ndarray, bounds: np.ndarray) -> None:
        row, item = np.nonzero((bounds >= self.least) & (bounds > 0))
        item, doc, bound = np.append(self.item, item), np.append(self.doc, docs[row]), np.append(self.bound, bounds[row, item])
        order = np.lexsort((doc, -bound, item))
        item, doc, bound = item[order], doc[order], bound[order]
        start = np.searchsorted(item, np.arange(len(self.least)))
        rank = np.arange(len(item)) - start[item]
        keep = rank < self.top
        self.item, self.doc, self.bound = item[keep], doc[keep], bound[keep]
        last = rank == self.top - 1
        self.least[item[last]] = bound[last]


def highest_bounds(index: DataFrame, scorer: Scorer, top: int) -> DataFrame:
    """(item, doc): the `top` documents of each item by bound. A task gives its own best, so rows grow with tasks and items alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(scorer.queries.names), top)
        for b in batches:
            for docs, bounds in scorer.bounds(b):
                best.add(docs, bounds)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc), pa.array(best.bound)], names=["item", "doc", "bound"])

    order = Window.partitionBy("item").orderBy(F.desc("bound"), "doc")
    return index.mapInArrow(work, "item bigint, doc bigint, bound double").withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).select("item", "doc")


def reaching(index: DataFrame, scorer: Scorer, least: np.ndarray, last: np.ndarray) -> DataFrame:
    """(item, doc) whose bound is over the item's threshold, or equal to it with an id up to the one that set it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, bounds in scorer.bounds(b):
                row, item = np.nonzero((bounds > 0) & ((bounds > least) | ((bounds == least) & (docs[:, None] <= last))))
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(docs[row])], names=["item", "doc"])

    return index.mapInArrow(work, "item bigint, doc bigint")


def rescored(docs: DataFrame, pairs: DataFrame, scorer: Scorer, id_col: str, text_col: str, few: bool) -> DataFrame:
    """(item, doc, score) of the pairs by their whole texts. Only documents that a pair names move; few: pairs are bounded by the block and go to every task instead."""
    terms = pa.array([t.decode() for t in scorer.queries.terms], pa.large_string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in chunks(batch, "text"):
                rows, codes, tf, words = counted(b.column("text"))
                known = pc.fill_null(pc.index_in(words.cast(pa.large_string()), terms), -1).to_numpy(zero_copy_only=False)
                lists = b.column("items")
                size = pc.list_value_length(lists).to_numpy()
                pairs = np.stack([np.repeat(np.arange(len(b)), size), lists.flatten().to_numpy()], 1)
                score = scorer.score(rows, known[codes] if len(codes) else codes, tf, np.bincount(rows, tf, len(b)).astype(np.int64), pairs)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(b.column("doc").to_numpy()[pairs[:, 0]]), pa.array(score)], names=["item", "doc", "score"])

    some = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    by_doc = pairs.groupBy("doc").agg(F.collect_set("item").alias("items"))  # no more than the block's items
    if not few:
        some = some.where(flagged(flags_of(pairs, ["doc"]), F.col("doc")))
    return some.join(F.broadcast(by_doc) if few else by_doc, "doc").mapInArrow(work, "item bigint, doc bigint, score bigint").where("score > 0")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, doc, score): for every item its `top` documents with a score above 0, or all if there are fewer; equal scores by ascending id.

    Every document has a sketch, made once. For a block of items, one lookup pass over the sketches finds the documents with the highest bounds; their exact scores set
    a threshold for each item, and every document whose bound reaches it is rescored. No bound is below its score, so no document is missed.
    Ids are integers. Null and empty texts (and items) have no terms and are in no result; a row that is repeated in documents is ranked each time,
    one repeated in items once; other columns aren't read. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    index = saved(sketches(docs, id_col, text_col), "sketches")
    total = index.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    kind = items.schema[item_col].dataType
    parts = []
    for q in blocks(items, item_col, item_text) if total["L"] else ():
        df = frequencies(docs.where(F.col(id_col).isNotNull()), q.terms, text_col)
        weight = np.array([math.floor(1000 * math.log((2 * total["N"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        scorer = Scorer(q, weight, total["N"], total["L"])
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
        ranks = lambda x: x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # noqa: B023, E731
        least, last = np.zeros(len(q.names)), np.full(len(q.names), np.iinfo(np.int64).max)
        for r in ranks(rescored(docs, highest_bounds(index, scorer, top), scorer, id_col, text_col, few=True)).where(F.col("rank") == top).collect():
            least[r["item"]], last[r["item"]] = r["score"], r["doc"]
        pairs = saved(reaching(index, scorer, least, last), "reaching")
        names = spark.createDataFrame(list(enumerate(q.names)), f"item bigint, {item_col} {kind.simpleString()}")
        out = ranks(rescored(docs, pairs, scorer, id_col, text_col, few=False)).join(F.broadcast(names), "item")
        parts.append(out.select(item_col, F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"))
    if not parts:
        return spark.createDataFrame([], f"{item_col} {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, parts)


def op12_ranked_search(spark, sf_dir) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
OP12_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id,
    sum(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN n USING (doc_id) CROSS JOIN c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""
