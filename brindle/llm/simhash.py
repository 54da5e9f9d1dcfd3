"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact check."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import flagged, flags_of, kept, modest_batches, saved, with_unique, written
from brindle.llm.components import components

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: The pipeline's stage takes documents for near copies whose sets of so many-word shingles have a Jaccard similarity of 4/5 at least.
WORDS, LIKE = 5, 0.8
#: Minima a band, bands, and bits by which the SimHashes of two such sets may differ: 9.7 on average by the angle of the sets, with a deviation of 2.9.
ROWS, BANDS, BITS = 5, 24, 20
#: At most so many fingerprints of one grid cell are compared within one task; larger cells go in pairs of parts.
CELL = 4096
_EVEN = np.uint64(0x5555555555555555)
_SPAN = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit i is 1 if over half the shingles' XXH64 have it. Null, empty and blank texts: 0.

    Works in spans of a fixed number of shingles, so a very long text needs no more memory than its words.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
        return hashes[0]
    ones = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _SPAN):
        end = min(n, at + _SPAN)
        cut = [words[at + k : end + k] for k in range(shingle)]
        h = np.fromiter([digest(join(w), SEED) for w in zip(*cut)], np.uint64, end - at)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long with the same bits."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"id": b["id"], "fp": fp.view(np.int64)})

    modest_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(work, f"id {kind}, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, in unary (0: 00, 1: 01, 2: 11), so that the XOR of two
    embeddings has as many bits as their Manhattan distance, which is at most the Hamming distance."""
    low, high = fp & _EVEN, (fp >> np.uint64(1)) & _EVEN
    return (low | high) | ((low & high) << np.uint64(1))


def grid(n: int, distance: int = DISTANCE) -> list[np.uint64]:
    """Masks over the embedding: two points within the distance are equal under one mask at least.

    With b blocks of segments, a Manhattan distance of d touches d blocks at most, so b - d are equal. More
    fingerprints get more blocks, thus narrower cells: the smallest b for which random fingerprints share a cell with
    few others.
    """
    for b in range(distance + 1, 17):
        masks = []
        edges = [round(32 * k / b) for k in range(b + 1)]
        block = [sum(3 << (2 * s) for s in range(edges[k], edges[k + 1])) for k in range(b)]
        masks = [np.uint64(sum(block[k] for k in keep)) for keep in combinations(range(b), b - distance)]
        # text fingerprints lean: a segment's counts agree about every other time
        if len(masks) * n * 0.5 ** (32 * (b - distance) / b) <= 512 or len(masks) > 60:
            return masks
    return masks


def linked(fp: np.ndarray, ids: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints: breadth first, each taken out once it is reached.

    The Manhattan bound on the embedding goes first, the Hamming distance decides.
    """
    out: list[tuple[int, int]] = []
    emb = embed(fp)
    rest = np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            k = queue.pop()
            near = np.bitwise_count(emb[rest] ^ emb[k]) <= distance
            if near.any():
                at = np.flatnonzero(near)
                hit = at[np.bitwise_count(fp[rest[at]] ^ fp[k]) <= distance]
                if len(hit):
                    found = rest[hit]
                    out.extend((int(ids[k]), int(ids[j])) for j in found)
                    queue.extend(found)
                    rest = np.delete(rest, hit)
    return out


def _cells(masks: list[np.uint64]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy()
            emb = embed(fp.view(np.uint64))
            ids = b["rep"].to_numpy()
            for t, m in enumerate(masks):
                yield pd.DataFrame({"t": np.full(len(fp), t, np.int32), "cell": (emb & m).view(np.int64), "fp": fp, "rep": ids})

    return work


def _pairs(distance: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            links = []
            for fps, reps in zip(b["fps"], b["reps"]):
                fps = np.asarray(fps, np.int64).view(np.uint64)
                if len(fps) == 2:
                    if (int(fps[0]) ^ int(fps[1])).bit_count() <= distance:
                        links.append((int(reps[0]), int(reps[1])))
                else:
                    links += linked(fps, np.asarray(reps, np.int64), distance)
            if links:
                yield pd.DataFrame(sorted(set(links)), columns=["a", "b"])

    return work


def near_links(classes: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """classes (fp, rep), one row a fingerprint, to links (a, b) between reps that join the same components as all
    pairs within the distance do.

    A cell with one fingerprint goes no further. Cells of up to CELL are compared in a task; larger ones are split by
    hash into parts and each pair of parts is compared, so no task grows with a cell. Only forests leave the tasks.
    """
    masks = grid(n, distance)
    cells = saved(classes.select("fp", "rep").mapInPandas(_cells(masks), "t int, cell long, fp long, rep long"), "cells")
    sizes = cells.groupBy("t", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = saved(sizes, "sizes")
    large = saved(sizes.where(F.col("n") > CELL).select("t", "cell", F.ceil(2 * F.col("n") / CELL).cast("int").alias("parts")), "largecells")
    crowded = not large.isEmpty()
    small = cells.join(large, ["t", "cell"], "left_anti") if crowded else cells
    small = small.groupBy("t", "cell").agg(F.collect_list(F.struct("fp", "rep")).alias("m"))
    small = small.where(F.size("m") > 1).select(F.col("m.fp").alias("fps"), F.col("m.rep").alias("reps"))
    links = small.mapInPandas(_pairs(distance), "a long, b long")
    if crowded:
        part = F.pmod(F.xxhash64(F.col("fp")), F.col("parts")).cast("int")
        dealt = cells.join(large, ["t", "cell"]).withColumn("part", part)
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        dealt = dealt.withColumn("other", other).where("parts = 1 or other <> part")
        dealt = dealt.groupBy("t", "cell", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
        blocks = dealt.agg(F.collect_list(F.struct("fp", "rep")).alias("m")).select(F.col("m.fp").alias("fps"), F.col("m.rep").alias("reps"))
        links = links.unionByName(blocks.mapInPandas(_pairs(distance), "a long, b long"))
    return links


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(id, fp, component): the smallest id reachable over links of at most the given Hamming distance.

    Null, empty and blank texts have fingerprint 0 and link like any other. Equal fingerprints are one class, so
    repeated texts and rows cost nothing beyond the first aggregation. Null ids are kept: they have their class's
    component, which is null if the class has no id. Other columns of docs are not read.
    """
    each = saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named, total = fingerprint_components(each, distance)
    return with_unique(each, named, "fp", "n", total)


def fingerprint_components(each: DataFrame, distance: int = DISTANCE) -> tuple[DataFrame, int]:
    """(fp, n, component) for the different fingerprints of each (id, fp), and the number of all rows."""
    classes = saved(each.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "classes")
    total, n = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    found = saved(components(near_links(classes.where("rep is not null"), n, distance)), "found")
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return saved(named.select("fp", "n", F.coalesce("component", "rep").alias("component")), "named"), total


def shingles(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """The different shingles' XXH64, ascending; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return np.array([digest(join(words), SEED)], np.uint64)
    cut = [words[k : len(words) - shingle + 1 + k] for k in range(shingle)]
    return np.unique(np.fromiter((digest(join(w), SEED) for w in zip(*cut)), np.uint64, len(cut[0])))


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = rng.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return draw[0], draw[1] | np.uint64(1)


def bands(found: np.ndarray) -> list[int]:
    """BANDS hashes of ROWS minima each: two sets of similarity s share one with probability 1 - (1 - s ** ROWS) ** BANDS, over 0.9999 at LIKE."""
    turn, times = _MIX
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        h = (found[at : at + 4096, None] ^ turn) * times
        h ^= h >> np.uint64(32)
        np.minimum(low, (h * times).min(0), out=low)
    data = low.reshape(BANDS, ROWS).astype("<u8")
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(data)]


_MIX = _mixers()


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, near, h, size, fp, bands): fingerprint(), the hash of the shingle set, how many it has, its SimHash (a bit is 1 if over half the different shingles have it) and its bands."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                found = shingles(t)
                ones = np.zeros(64, np.int64)
                for at in range(0, len(found), _SPAN):
                    part = found[at : at + _SPAN].astype("<u8").view(np.uint8).reshape(-1, 8)
                    ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
                fp = int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little", signed=True)
                near = int(np.uint64(fingerprint(t)).astype(np.int64))
                out.append((near, xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED) - (1 << 63), len(found), fp, bands(found)))
            names = ("near", "h", "size", "fp", "bands")
            yield pd.DataFrame({"id": b["id"], **dict(zip(names, map(list, zip(*out))))} if out else {c: [] for c in ("id", *names)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(work, f"id {kind}, near long, h long, size int, fp long, bands array<long>")


def sets_of(wanted: DataFrame, docs: DataFrame, each: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, s): the shingle sets of the given hashes, made again from one text each."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [shingles(t) for t in b["text"]]
            h = [xxhash.xxh64_intdigest(x.astype("<u8").tobytes(), SEED) - (1 << 63) for x in made]
            yield pd.DataFrame({"h": h, "s": [x.view(np.int64) for x in made]})

    some = saved(each.join(wanted, "h", "left_semi").groupBy("h").agg(F.min("id").alias("id")).select("id").distinct(), "wantedids")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(flagged(flags_of(some, ["id"]), F.col("id")))
    rows = rows.join(some, "id", "left_semi").select("text")
    # an id may have other texts too
    return rows.mapInPandas(work, "h long, s array<long>").join(wanted, "h", "left_semi").groupBy("h").agg(F.first("s").alias("s"))


def alike(pairs: DataFrame, docs: DataFrame, each: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """pairs (a, b) of set hashes to those whose sets have a Jaccard similarity of LIKE at least; just the sets that take part are made again."""
    pairs = saved(pairs, "nearpairs")
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "wantedsets")
    sets = saved(sets_of(wanted, docs, each, id_col, text_col), "sets")
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    # same / (all - same) >= 4 / 5
    return both.where(9 * same >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def rare_shingles(sets: DataFrame) -> DataFrame:
    """(n, lo, mid, hi): for each shingle that three of the sets hold at most, how many and which: mid where n is 3, lo = hi where it is 1.

    The third holder is what remains of all holders' XOR, so a shingle of any number of sets is a row of fixed size.
    """
    rows = sets.select("h", F.explode("s").alias("s"))
    held = rows.groupBy("s").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.bit_xor("h").alias("x"))
    return held.where("n <= 3").select("n", "lo", F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi")).alias("mid"), "hi")


def bounded(members: DataFrame, rare: DataFrame) -> DataFrame:
    """members (h, fp, comp, size) with rest, the number of shingles that over three members hold."""
    holders = F.when(F.col("n") == 1, F.array("lo")).when(F.col("n") == 2, F.array("lo", "hi")).otherwise(F.array("lo", "mid", "hi"))
    few = rare.select(F.explode(holders).alias("h")).groupBy("h").agg(F.count("*").alias("few"))
    return members.join(few, "h", "left").select("h", "fp", "comp", "size", (F.col("size") - F.coalesce("few", F.lit(0))).alias("rest"))


def met(members: DataFrame, rare: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that share rare shingles and may reach LIKE: those they share and the rest of the one with less is the most that they have in common."""
    pair = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in combinations(("lo", "mid", "hi"), 2)]
    pairs = rare.where("n > 1").select(F.explode(F.when(F.col("n") == 2, F.array(pair[1])).otherwise(F.array(*pair))).alias("p"))
    pairs = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("c"))
    x, y = (members.select(F.col("h").alias(k), F.struct("fp", "comp", "size", "rest").alias(f"of{k}")) for k in "ab")
    near = (F.col("ofa.comp") != F.col("ofb.comp")) & (F.bit_count(F.col("ofa.fp").bitwiseXOR(F.col("ofb.fp"))) <= BITS)
    most = F.col("c") + F.least("ofa.rest", "ofb.rest")
    return pairs.join(x, "a").join(y, "b").where(near & (9 * most >= 4 * (F.col("ofa.size") + F.col("ofb.size")))).select("a", "b")


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of one cell that no component joins yet, whose fingerprints differ by BITS at most and that reach LIKE if they share all shingles but rare ones.

    For that one of the two has 8/9 of its shingles at least among those, so light ones are never held against each other. The largest component
    is never compared with itself, so a crowd costs each outsider one row of comparisons.
    """
    for b in batches:
        for m in b["m"]:
            fp = np.array([x["fp"] for x in m], np.int64).view(np.uint64)
            h, comp, size, rest = (np.array([x[c] for x in m], np.int64) for c in ("h", "comp", "size", "rest"))
            heavy = 9 * rest >= 8 * size
            names, counts = np.unique(comp, return_counts=True)
            outside = comp != names[counts.argmax()]
            out = []

            def hold(some: np.ndarray, against: np.ndarray) -> None:
                for k in some:
                    near = (comp[against] != comp[k]) & (np.bitwise_count(fp[against] ^ fp[k]) <= BITS)
                    hit = against[near & (9 * np.minimum(rest[against], rest[k]) >= 4 * (size[against] + size[k]))]
                    out.append(np.stack([np.minimum(h[hit], h[k]), np.maximum(h[hit], h[k])], 1))

            hold(np.flatnonzero(outside & heavy), np.arange(len(h)))
            hold(*sorted((np.flatnonzero(outside & ~heavy), np.flatnonzero(~outside & heavy)), key=len))
            if out:
                yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])


def across(named: DataFrame, classes: DataFrame, docs: DataFrame, each: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of set hashes that share a cell, or a rare shingle, and may be alike, but are in different components.

    Only shingles of sets in cells with several components are counted. A crowd of texts from one template, each with words of its own, can't reach LIKE by
    what many of them share; so it gives no pairs, where pairs of its cells would grow with its square.
    """
    mixed = named.groupBy("cell").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("cell")
    named = saved(named.join(mixed, "cell", "left_semi"), "mixedcells")
    members = named.select("h", "comp").distinct().join(classes.select("h", "fp", "size"), "h")
    members = saved(members, "members")
    rare = saved(rare_shingles(sets_of(members.select("h"), docs, each, id_col, text_col)), "rareshingles")
    members = saved(bounded(members, rare), "boundedmembers")
    cells = saved(named.select("cell", "h").join(members, "h"), "boundedcells")
    heavy = F.max((9 * F.col("rest") >= 8 * F.col("size")).cast("int"))
    open_cells = cells.groupBy("cell").agg(heavy.alias("heavy"), F.count("*").alias("n")).where("heavy = 1").select("cell", "n")
    parts = F.when(F.col("n") > CELL, F.ceil(2 * F.col("n") / CELL).cast("int")).otherwise(1)
    dealt = cells.join(open_cells, "cell").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or other <> part")
    blocks = dealt.groupBy("cell", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    blocks = blocks.agg(F.collect_list(F.struct("h", "fp", "comp", "size", "rest")).alias("m"))
    return blocks.select("m").mapInPandas(_across, "a long, b long").unionByName(met(members, rare)).distinct()


def alike_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): the smallest id reachable over pairs whose sets of WORDS-word shingles have a Jaccard similarity of LIKE at least.

    Candidates share a band, or a rare shingle, and differ by BITS bits of the SimHash at most; the sets themselves decide. First each member of a cell is held
    against the cell's least one, which settles crowds of near copies; then the pairs that are still in different components. Texts without words are alike.
    """
    each = saved(sketches(docs, id_col, text_col), "sketches")
    of, total = set_components(each, docs, id_col, text_col)
    return with_unique(each.select("id", "h"), of, "h", "n", total).select("id", "component")


def copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): the smallest id reachable over links of fingerprints, as near_components() finds them, and over pairs that alike_components() links.

    Components of either kind are joined where a document is in both. Ids must not be null.
    """
    each = saved(sketches(docs, id_col, text_col), "sketches")
    named, _ = fingerprint_components(each.select("id", F.col("near").alias("fp")))
    of, total = set_components(each, docs, id_col, text_col)
    both = saved(each.select("near", "h").distinct(), "kinds")
    often = both.groupBy("near").agg(F.count("*").alias("_n")).join(named.select(F.col("fp").alias("near"), F.col("component").alias("a")), "near")
    links = with_unique(both, saved(often, "oftenkinds"), "near", "_n", both.count())
    links = links.join(of.select("h", F.col("component").alias("b")), "h").select("a", "b").where("a <> b").distinct()
    # a component's name is its smallest id, so the smallest name is the smallest id of all that are joined
    joint = saved(components(links), "joint").select(F.col("node").alias("component"), F.col("component").alias("least"))
    sized = saved(of.groupBy("component").agg(F.count("*").alias("_n")).join(joint, "component", "left"), "sizedcomponents")
    names = with_unique(of, sized, "component", "_n", of.count()).select("h", "n", F.coalesce("least", "component").alias("component"))
    names = saved(names, "jointsets")
    return with_unique(each.select("id", "h"), names, "h", "n", total).select("id", "component")


def set_components(each: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(h, n, component) for the different shingle sets of each, and the number of all rows."""
    first = [F.first(c).alias(c) for c in ("fp", "size", "bands")]
    classes = saved(each.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"), *first), "setclasses")
    cells = saved(classes.select("h", "fp", F.explode("bands").alias("cell")), "bandcells")
    least = cells.groupBy("cell").agg(F.min(F.struct("h", "fp")).alias("l"), F.count("*").alias("_n")).where("_n > 1").select("cell", "l")
    shared = saved(cells.join(least, "cell"), "sharedcells")
    star = shared.where((F.col("h") != F.col("l.h")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("l.fp"))) <= BITS))
    links = saved(alike(star.select(F.col("l.h").alias("a"), F.col("h").alias("b")).distinct(), docs, each, id_col, text_col), "starlinks")
    found = saved(components(links), "starfound")
    named = shared.drop("l", "fp").join(found.withColumnRenamed("node", "h"), "h", "left").withColumn("comp", F.coalesce("component", "h"))
    named = saved(named.select("cell", "h", "comp"), "namedcells")
    more = saved(across(named, classes, docs, each, id_col, text_col), "across")
    if not more.isEmpty():
        found = saved(components(links.unionByName(alike(more, docs, each, id_col, text_col))), "allfound")
    classes = classes.select("h", "rep", "n").join(found.withColumnRenamed("node", "h"), "h", "left").withColumn("comp", F.coalesce("component", "h"))
    classes = saved(classes.select("h", "rep", "n", "comp"), "labelled")
    firsts = saved(classes.groupBy("comp").agg(F.min("rep").alias("component"), F.count("*").alias("_n")), "setfirsts")
    rows, kinds = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return saved(with_unique(classes, firsts, "comp", "_n", kinds).select("h", "n", "component"), "ofsets"), rows


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of: Callable[..., DataFrame] = alike_components) -> DataFrame:
    """The rows of docs, with all columns, whose id is the smallest of its component of near copies, as `of` finds them.

    Rows with the same id are one document and stay together. Rows without an id can't be named, so they take no part and stay.
    """
    since = written()
    taking = docs.where(F.col(id_col).isNotNull())
    stays = of(taking, id_col, text_col).groupBy(F.col("id").alias("_id")).agg(F.bool_or(F.col("id") == F.col("component")).alias("_stays"))
    gone = stays.where("not _stays").select("_id")
    gone = kept(gone, "nearcopies", since)
    hit = flagged(flags_of(gone, ["_id"]), F.col(id_col))
    # only rows that may go are looked up; all others stay where they are
    return docs.where(~hit | F.col(id_col).isNull()).unionByName(taking.where(hit).join(gone, F.col(id_col) == F.col("_id"), "left_anti"))


def hex16(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def op6_simhash(spark, sf_dir) -> DataFrame:
    from brindle.llm.common import documents

    out = near_components(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), hex16("fp").alias("fingerprint"), F.col("component").alias("component_id"))
