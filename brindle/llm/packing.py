"""Best-fit packing of token pieces by a configuration linear program."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import documents, modest_batches, ranked, saved
from brindle.llm.words import chunks, coded

CAPACITY, END_ID = 2048, 0
VOCABULARY = "word_bpe_49k.json"
#: Words a worker remembers, some 200 bytes each; all are forgotten when there are more. Each of an executor's cores has a worker that keeps them beside the heap.
WORDS = 250_000
#: Patterns within this part of the best price are used; rounds of the multiplicative weights, their least number for what rounding left, and their
#: rate; pieces that best fit may take on at the end.
EPSILON, ROUNDS, LATER, RATE, FEW = 0.02, 60, 10, 0.15, 48

#: Rounds in which a plan's patterns take turns where places matter.
PARTS = 16

#: A control character no text is expected to hold, with an id of its own; words that hold it all the same are encoded alone.
_MARK = "\x01"
_END = "</w>"
_TAILED = re.compile(r"(.*[A-Za-z])([!-&(-/:-@\[-`{-~]+)", re.S)


class Ids:
    """Token ids of whole texts, as unsigned 32-bit numbers.

    The tokenizer never joins what ASCII white space separates, nor a letter and the ASCII punctuation after it (the apostrophe
    aside), and it ignores case; so each distinct word of a batch is looked up once, and each distinct stem among new words is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # stems of a-z are one word to the tokenizer, so its model alone can take them; their last token ends a word
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(_END)]] = True

    def of(self, text: str | None) -> bytes:
        return self.many(pa.array([text or ""]))[0].astype("<u4").tobytes()

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column; null counts as empty."""
        texts = pc.fill_null(texts, "")
        # such a text may name a special token, whose case and punctuation count
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        offsets, code, words = coded(pc.ascii_lower(texts))
        found = self._known(words.to_pylist())
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(np.frombuffer(b"".join(found), "<u4")))
        flat = ids.take(pa.array(code)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[code], dtype=np.int64)])[offsets]
        out = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for k in special.tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
        return out

    def forget(self) -> None:
        """Lets go of all words, and of the memory that Arrow keeps for later."""
        self.words = {"": b""}
        pa.default_memory_pool().release_unused()

    def _known(self, words: list[str]) -> list[bytes]:
        if len(self.words) > WORDS:
            self.forget()
        found = list(map(self.words.get, words))
        self._learn([w for w, x in zip(words, found) if x is None])
        return [self.words[w] if x is None else x for w, x in zip(words, found)]

    def _learn(self, new: list[str]) -> None:
        known, tailed, todo = self.words, [], set()
        for w in new:
            stem = w
            if not w.isalpha():
                m = _TAILED.fullmatch(w)
                if m:
                    stem, tail = m.groups()
                    tailed.append((w, stem, tail))
                    if tail not in known:
                        todo.add(tail)
            if stem not in known:
                todo.add(stem)
        encode = self.tokenizer.encode_batch_fast
        letters = [x for x in todo if x.isascii() and x.isalpha()]
        for a in range(0, len(letters), 2000):
            some = letters[a : a + 2000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            data, begin = ids.tobytes(), 0
            for x, end in zip(some, (4 * ends).tolist(), strict=True):
                known[x] = data[begin:end]
                begin = end
        marked = [x for x in todo if x not in known and _MARK not in x] if self.mark is not None else []
        for a in range(0, len(marked), 500):
            some = marked[a : a + 500]
            ids = np.array(encode([f" {_MARK} ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            data, begin = ids.tobytes(), 0
            for x, end in zip(some, [*(4 * np.flatnonzero(ids == self.mark)).tolist(), len(data)], strict=True):
                known[x] = data[begin:end]
                begin = end + 4
        for x in todo:
            if x not in known:
                known[x] = np.array(encode([x], add_special_tokens=False)[0].ids, "<u4").tobytes()
        for w, stem, tail in tailed:
            known[w] = known[stem] + known[tail]


_encoders: dict[str, Ids] = {}


def encoder(path: str) -> Ids:
    """One for each worker process, so that later tasks needn't load the vocabulary."""
    if path not in _encoders:
        _encoders[path] = Ids(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, place: Column | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids with the end id, cut only where it exceeds the capacity; with `place`, a column (place) too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = encoder(path)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for b in chunks(batch, "text"):
                row, out = [], []
                for r, data in enumerate(ids.many(b.column("text"))):
                    n = len(data) + 1
                    for k, a in enumerate(range(0, n, capacity)):
                        crc = zlib.crc32(data[a : a + capacity])
                        last = a + capacity >= n
                        row.append(r)
                        out.append((k, a, min(capacity, n - a), zlib.crc32(end, crc) if last else crc))
                cut = np.array(out, np.int64).reshape(-1, 4)
                columns = {"id": b.column("id").take(pa.array(row, pa.int64()))}
                columns |= {c: pa.array(cut[:, k].astype(t)) for k, (c, t) in enumerate((("piece", np.int32), ("start", np.int64), ("length", np.int32), ("ids_crc32", np.int64)))}
                if ordered:
                    columns["place"] = b.column("place").take(pa.array(row, pa.int64()))
                yield pa.record_batch(columns)
        ids.forget()  # the process lives on and may serve other stages

    modest_batches(docs.sparkSession)
    ordered = place is not None
    at = place.cast("string") if ordered else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), at.alias("place"))
    return rows.mapInArrow(work, "id long, piece int, start long, length int, ids_crc32 long" + ", place string" * ordered)


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best total price within each capacity, the last length taken for it (-1: none) and the fill it is taken at; lengths ascend."""
    value, last, full = np.zeros(capacity + 1), np.full(capacity + 1, -1), np.zeros(capacity + 1, int)
    reach = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c], last[c] = value[c - 1], last[c - 1]  # one token stays free
        full[c] = full[c - 1]
        j = reach[c]
        if j:
            v = value[c - lengths[:j]] + price[:j]
            k = int(v.argmax())
            if v[k] > value[c]:
                value[c], last[c], full[c] = v[k], k, c
    return value, last, full


def _trace(last: list[int], full: list[int], lengths: list[int], fill: int) -> Counter:
    out: Counter[int] = Counter()
    while last[fill] >= 0:
        k = last[fill]
        out[k] += 1
        fill = full[fill] - lengths[k]
    return out


def configuration_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> dict[tuple, float]:
    """Patterns (sorted (length index, copies)) and how often to use each, as fractions, covering no length beyond its count.

    Multiplicative weights: prices start at the lengths. A round prices patterns by one knapsack table; for each length the
    best pattern that holds it is read off, and those near the best price share out this round's part of every count. What stays uncovered
    grows dearer, so lengths that are hard to fill round come to lead the patterns of later rounds.
    """
    weight = counts * lengths / (counts * lengths).sum()
    used: dict[tuple, float] = Counter()
    covered = np.zeros(len(counts))
    for t in range(1, rounds + 1):
        price = weight / counts
        value, last, full = knapsack(price, lengths, capacity)
        last, full, sizes = last.tolist(), full.tolist(), lengths.tolist()
        with_k = price + value[capacity - lengths]
        due = np.maximum(counts * t / rounds - covered, 0)
        lag = due * rounds / counts
        left = due.tolist()
        order = np.argsort(-with_k, kind="stable")
        for k in order[: int((with_k >= (1 - EPSILON) * value[capacity]).sum())].tolist():
            if left[k] <= 0:
                continue
            pattern = _trace(last, full, sizes, capacity - sizes[k])
            pattern[k] += 1
            amount = min([left[j] / c for j, c in pattern.items()])
            if amount > 0:
                for j, c in pattern.items():
                    left[j] -= amount * c
                used[tuple(sorted(pattern.items()))] += amount
        left = np.array(left)
        covered += due - left
        weight = weight * np.exp(np.where(left > 0, RATE * np.minimum(lag, 3), -RATE))
        weight /= weight.sum()
    return used


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; the space left is looked up by a table of open bins."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    for n in sorted(sizes, reverse=True):
        space = next((s for s in range(n, capacity + 1) if by_space[s]), None)
        if space is None:
            bins.append([n])
            by_space[capacity - n].append(len(bins) - 1)
        else:
            k = by_space[space].pop()
            bins[k].append(n)
            by_space[space - n].append(k)
    return bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, few: int = FEW) -> list[tuple[dict[int, int], int]]:
    """(pattern of length to copies, times): together they hold every piece of the histogram once.

    The linear program's fractional uses are rounded down, then, in order of what is left of each, once up where the pieces are there. What no pattern
    took is the next program's histogram. The residue goes by best fit: `few` pieces at most, or those of which no pattern's pieces are all there.
    The work and the size of the plan depend on the capacity, not on the number of pieces, and are alike at every size.
    """
    left = Counter({n: c for n, c in histogram.items() if c > 0})
    out: Counter[tuple] = Counter()
    if left.get(capacity):
        out[((capacity, 1),)] = left.pop(capacity)

    def take(named: list[tuple[int, int]], most: int) -> None:
        times = min(most, *(left[n] // c for n, c in named))
        if times > 0:
            out[tuple(named)] += times
            for n, c in named:
                left[n] -= c * times

    while sum(left.values()) > few:
        lengths = np.array(sorted(left))
        counts = np.array([left[n] for n in lengths], float)
        used = configuration_lp(lengths, counts, capacity, rounds)
        patterns = [([(int(lengths[k]), c) for k, c in pattern], amount) for pattern, amount in used.items()]
        for named, amount in sorted(patterns, key=lambda x: (-x[1], x[0])):
            take(named, int(amount + 1e-9))
        for named, amount in sorted(patterns, key=lambda x: (-(x[1] % 1), -sum(n * c for n, c in x[0]), x[0])):
            take(named, 1)
        left = +left
        if sum(left.values()) == int(counts.sum()):
            break
        rounds = max(LATER, rounds // 2)
    for b in best_fit([n for n, c in left.items() for _ in range(c)], capacity):
        out[tuple(sorted(Counter(b).items()))] += 1
    return [(dict(p), t) for p, t in sorted(out.items())]


def slots(planned: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For each length, runs of ranks that share a pattern: (key, copies, first sequence, first offset), keys ascending."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in planned:
        offset = 0
        for n, copies in sorted(pattern.items(), reverse=True):
            rows.append((_key(n, taken[n]), copies, sequence, offset, taken[n]))
            taken[n] += copies * times
            offset += copies * n
        sequence += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def spread(planned: list[tuple[dict[int, int], int]], parts: int = PARTS) -> list[tuple[dict[int, int], int]]:
    """The plan in `parts` rounds, each with its share of every pattern's uses, so that a round takes about the same share of each length's ranks."""
    out = []
    for b in range(parts):
        for k, (pattern, times) in enumerate(planned):
            phase = k * parts * 0.6180339887498949 % 1  # patterns used less often than there are rounds fall in different ones
            n = int(times * (b + 1) / parts + phase) - int(times * b / parts + phase)
            if b == parts - 1:
                n = times - int(times * b / parts + phase)
            if n:
                out.append((pattern, n))
    return out


def _key(length, rank):
    return length * (1 << 48) + rank


def packed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, place: Column | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every document's ids in sequences of at most the capacity.

    Null and empty texts are one piece with the end id alone. Repeated rows are packed like others; pieces of equal length are alike
    to the plan, so only their ranks decide where each goes. An empty table gives an empty result.

    The driver gets the histogram, which has a row for each length up to the capacity, and sends back the plan's runs.

    With `place`, a column whose text sorts as the documents should follow each other, pieces of equal length rank by it, patterns take turns
    (spread) so that a sequence's pieces have near places, and sequences are numbered by their first piece's place.
    """
    cut = saved(pieces(docs, path, id_col, text_col, capacity, place), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    planned = plan(histogram, capacity)
    key, copies, sequence, offset, first = slots(planned if place is None else spread(planned))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, r = b["length"].to_numpy(np.int64), b.pop("_rank").to_numpy(np.int64)
            at = np.searchsorted(key, _key(n, r), side="right") - 1
            j = r - first[at]
            b["sequence_id"] = sequence[at] + j // copies[at]
            b["offset"] = offset[at] + j % copies[at] * n
            b["id"] = b["id"].astype("Int64")
            yield b

    kind = "id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long"
    if place is None:
        return ranked(cut, ["length"], ["id", "piece"], "ranked").mapInPandas(put, kind)
    kind = kind.replace("sequence_id", "place string, sequence_id")
    rows = saved(ranked(cut, ["length"], ["place", "id", "piece"], "ranked").mapInPandas(put, kind), "placedpieces")
    heads = rows.groupBy("sequence_id").agg(F.min("place").alias("place"))
    numbered = ranked(heads, [], ["place", "sequence_id"], "heads").select("sequence_id", F.col("_rank").alias("_to"))
    out = rows.join(numbered, "sequence_id").withColumn("sequence_id", F.col("_to"))
    return out.select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_best_fit_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    out = packed(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return out.withColumnRenamed("id", "doc_id").withColumn("length", F.col("length").cast("long"))
