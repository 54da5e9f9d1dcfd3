"""Exact duplicate groups, their classes and notes, and Hamming joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.stores import cut

#: Hashes of a block that are compared in one piece, and rows of it at a time.
CHUNK, STRIP = 4096, 256
#: Bands of a 64-bit hash that are looked up, and how many bits of one are turned at most.
BANDS, RADIUS = 4, 2


def exact_groups(df: DataFrame, content: str, member: list[str], digest: str = "md5") -> DataFrame:
    """(md5, n, members): contents that occur more than once, with their members sorted. Null contents are no duplicates."""
    hashed = df.where(F.col(content).isNotNull()).select(F.md5(F.col(content).cast("binary")).alias(digest), F.struct(*member).alias("m"))
    return hashed.groupBy(digest).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("m")).alias("members")).where("n > 1")


def first_groups(df: DataFrame, content: str, item: str, n: int) -> DataFrame:
    """(md5, n, first_<item>): of the contents that occur more than once the n with the smallest item, by it. Members are never gathered."""
    hashed = df.where(F.col(content).isNotNull()).select(F.md5(F.col(content).cast("binary")).alias("md5"), item)
    first = f"first_{item.rsplit('_', 1)[-1]}"
    return hashed.groupBy("md5").agg(F.count("*").alias("n"), F.min(item).alias(first)).where("n > 1").orderBy(first, "md5").limit(n)


def duplicate_counts(df: DataFrame, content: str) -> DataFrame:
    """One row: files, unique contents, groups of equal ones, files in them, the largest group."""
    hashed = df.where(F.col(content).isNotNull()).groupBy(F.md5(F.col(content).cast("binary")).alias("md5")).agg(F.count("*").alias("n"))
    several = F.when(F.col("n") > 1, F.col("n"))
    return hashed.agg(
        F.sum("n").alias("files"), F.count("*").alias("unique"), F.count(several).alias("groups"), F.coalesce(F.sum(several), F.lit(0)).alias("grouped files"), F.max("n").alias("largest group")
    )


def hash_counts(df: DataFrame, content: str) -> DataFrame:
    """(files, unique_hashes)."""
    return df.where(F.col(content).isNotNull()).agg(F.count("*").alias("files"), F.count_distinct(F.md5(F.col(content).cast("binary"))).alias("unique_hashes"))


def group_classes(df: DataFrame, content: str, layer: str, side: Column, split: str) -> DataFrame:
    """One row a duplicate group: whether all its members are in one layer, whether both sides occur, in how many splits it is.

    Boolean aggregates, so groups are never gathered: n, all_same_layer, cross_side, cross_mixed (both sides, more than one layer), n_splits.
    """
    hashed = df.where(F.col(content).isNotNull()).select(F.md5(F.col(content).cast("binary")).alias("md5"), F.col(layer).alias("_l"), side.alias("_s"), F.col(split).alias("_p"))
    out = hashed.groupBy("md5").agg(
        F.count("*").alias("n"),
        (F.min("_l") == F.max("_l")).alias("all_same_layer"),
        (F.bool_or("_s") & F.bool_or(~F.col("_s"))).alias("cross_side"),
        F.count_distinct("_p").alias("n_splits"),
    )
    return out.where("n > 1").withColumn("cross_mixed", F.col("cross_side") & ~F.col("all_same_layer"))


def split_leaks(df: DataFrame, content: str, split: str, wanted: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """(md5, n, splits): duplicate groups that occur in all the wanted splits."""
    hashed = df.where(F.col(content).isNotNull()).groupBy(F.md5(F.col(content).cast("binary")).alias("md5")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set(split)).alias("splits")
    )
    return hashed.where((F.col("n") > 1) & (F.size(F.array_intersect("splits", F.array(*map(F.lit, wanted)))) == len(wanted)))


def pair_notes(df: DataFrame, content: str, item: str, part: str, pair_mode: str = "exact2") -> DataFrame:
    """(item, part, other_item, other_part): for each member of a duplicate group its partner.

    exact2: only groups of two have partners. all: a member of a larger group is paired with the first member, and that with the last, so no
    group is expanded into pairs. other_item is set where the items differ, other_part where the item is the same.
    """
    keyed = df.where(F.col(content).isNotNull()).select(F.md5(F.col(content).cast("binary")).alias("md5"), F.struct(item, part).alias("m"))
    ends = keyed.groupBy("md5").agg(F.count("*").alias("n"), F.min("m").alias("first"), F.max("m").alias("last"))
    ends = ends.where("n = 2" if pair_mode == "exact2" else "n > 1").drop("n")
    both = keyed.join(ends, "md5")
    other = F.when(F.col("m") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    rows = both.select("m", other.alias("o")).where("m <> o")
    same = F.col(f"m.{item}") == F.col(f"o.{item}")
    return rows.select(
        F.col(f"m.{item}").alias(item), F.col(f"m.{part}").alias(part), F.when(~same, F.col(f"o.{item}")).alias("other_item"), F.when(same, F.col(f"o.{part}")).alias("other_part")
    )


def match_notes(matches: DataFrame, keys: list[str], split: str, image: str, distance: str, overlap: str) -> DataFrame:
    """(keys, note): verified matches of a row as split/image(distance,iou=0.00), sorted, joined by semicolons."""
    one = F.format_string("%s/%d(%d,iou=%.2f)", F.col(split), F.col(image), F.col(distance), F.col(overlap))
    rows = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(split, image, distance, overlap, one.alias("text")))).alias("m"))
    return rows.select(*keys, F.array_join(F.transform("m", lambda x: x["text"]), ";").alias("note"))


def sign_hash(values: str | Column, bits: int) -> Column:
    """Bit i is 1 where value i is positive, for the first `bits` values (64 at most, as the bits of a long)."""
    values = F.col(values) if isinstance(values, str) else values
    flags = F.transform(F.slice(values, 1, bits), lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def bits_to_long(bits: str) -> Column:
    """An array of 0/1, the most significant bit first."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b.cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_join(left: DataFrame, right: DataFrame, block: str, hash_: str, most: int, order: str | None = None) -> DataFrame:
    """All pairs of a block at a distance of `most` at most; columns l_* and r_*, distance. With `order`, a column, only pairs whose left side has the lesser one.

    Compares each pair of a block inside the join; for a few bits banded_hamming_join() compares far fewer.
    """
    a = left.select([F.col(c).alias(f"l_{c}") for c in left.columns])
    b = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    d = hamming(F.col(f"l_{hash_}"), F.col(f"r_{hash_}"))
    cond = (F.col(f"l_{block}") == F.col(f"r_{block}")) & (d <= most)
    if order:
        cond = cond & (F.col(f"l_{order}") < F.col(f"r_{order}"))
    return a.join(b, cond).withColumn("distance", d)


def banded_hamming_join(left: DataFrame, right: DataFrame, block: str, hash_: str, most: int, bits: int = 64) -> DataFrame:
    """The same pairs by equal bands: of most + 1 bands of the bits one at least is equal, so the join is on (block, band, its bits).

    A pair is kept at its first equal band alone, so no distinct over pairs is needed.
    """
    edges = [round(bits * k / (most + 1)) for k in range(most + 2)]
    masks = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(most + 1)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]

    def side(df: DataFrame, p: str) -> DataFrame:
        keys = F.array(*[F.col(hash_).bitwiseAND(F.lit(m).cast("long")) for m in masks])
        return df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns], F.posexplode(keys).alias(f"{p}_band", f"{p}_key"))

    a, b = side(left, "l"), side(right, "r")
    x = F.col(f"l_{hash_}").bitwiseXOR(F.col(f"r_{hash_}"))
    first = reduce(lambda acc, k: F.when(x.bitwiseAND(F.lit(masks[k]).cast("long")) == 0, F.lit(k)).otherwise(acc), reversed(range(most + 1)), F.lit(-1))
    cond = (F.col(f"l_{block}") == F.col(f"r_{block}")) & (F.col("l_band") == F.col("r_band")) & (F.col("l_key") == F.col("r_key")) & (F.bit_count(x) <= most) & (first == F.col("l_band"))
    return a.join(b, cond).withColumn("distance", F.bit_count(x)).drop("l_band", "r_band", "l_key", "r_key")


def best_distance(left: DataFrame, right: DataFrame, block: str, hash_: str, row_id: str, other: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(block, id, best): the least distance from each right row to any left row of its block, or with `other` to any with another id; null where there is none.

    Equal hashes are found by a join and every hash counts once. Blocks of up to `chunk` different hashes are compared in one piece. Rows of larger ones are looked up by growing radius: with
    BANDS bands, pairs that differ by up to r bits in every band but one are seen by probing bands with r bits turned, so a row whose best is BANDS * (r + 1) at most is proven and
    done. Only what is still unproven after RADIUS is compared with its whole block, in pieces of `chunk` by `chunk`; pairs of rows are never made. Rows with a null block, id or hash, or of a block that
    left doesn't have, are left out.
    """
    kinds = {c: right.schema[c].dataType.simpleString() for c in (block, row_id)}
    some = left.where(F.col(block).isNotNull() & F.col(hash_).isNotNull()).groupBy(F.col(block).alias("b"), F.col(hash_).alias("h")).agg(F.count("*").alias("_n"), F.min(row_id).alias("_one"))
    some = cut(some)
    rows = right.select(F.col(block).alias("b"), F.col(row_id).alias("id"), F.col(hash_).alias("h")).dropna().distinct()
    sizes = some.groupBy("b").agg(F.count("*").alias("_size"))
    rows = rows.join(sizes, "b").join(some, ["b", "h"], "left")
    # a hash that only the row itself has is no other row's
    equal = F.col("_n").isNotNull() & ((F.col("_n") > 1) | (F.col("_one") != F.col("id")) if other else F.lit(True))
    rows = cut(rows.select("b", "id", "h", "_size", F.when(equal, F.lit(0)).alias("best")))
    done, todo = [rows.where("best = 0")], rows.where("best is null")
    hashes = some.select("b", "h").join(sizes, "b")
    if sizes.where(F.col("_size") > chunk).limit(1).count():
        done.append(todo.where(F.col("_size") <= chunk).transform(lambda x: _in_pieces(x, hashes, chunk, kinds)))
        todo, index = todo.where(F.col("_size") > chunk), _banded(hashes.where(F.col("_size") > chunk), [0]).drop("_size").withColumnRenamed("h", "g")
        for radius in range(RADIUS + 1):
            probes = _banded(todo, [m for m in range(1 << 64 // BANDS) if m.bit_count() == radius])
            d = hamming(F.col("h"), F.col("g"))
            found = probes.join(index, ["b", "_band", "_key"]).where(d > 0).groupBy("b", "id", "h").agg(F.min(d).alias("_d"))
            todo = cut(todo.join(found, ["b", "id", "h"], "left").withColumn("best", F.least("best", "_d")).drop("_d"))
            proven = F.coalesce(F.col("best") <= BANDS * (radius + 1), F.lit(False))
            done.append(todo.where(proven))
            todo = todo.where(~proven)
    done.append(_in_pieces(todo, hashes, chunk, kinds))
    every = reduce(DataFrame.unionByName, [x.select("b", "id", "best") for x in done])
    return every.groupBy(F.col("b").alias(block), F.col("id").alias(row_id)).agg(F.min("best").alias("best"))


def _banded(rows: DataFrame, turned: list[int]) -> DataFrame:
    """A row for each band of the hash, with its bits turned in each of the given ways."""
    bits = 64 // BANDS
    keys = [F.shiftrightunsigned("h", bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(BANDS)]
    each = rows.select("*", F.posexplode(F.array(*keys)).alias("_band", "_own"))
    return each.withColumn("_key", F.explode(F.transform(F.array(*map(F.lit, turned)), lambda m: F.col("_own").bitwiseXOR(m.cast("long"))))).drop("_own")


def _in_pieces(rows: DataFrame, hashes: DataFrame, chunk: int, kinds: dict[str, str]) -> DataFrame:
    """(b, id, best) of rows against all hashes of their block but equal ones: pieces of either side meet by block, a task holds one pair of them."""
    block_kind, id_kind = kinds.values()

    def pieces(df: DataFrame, columns: list[str], size: Column, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*columns), F.ceil(size / chunk))
        return df.groupBy("b", part.alias(name)).agg(*[F.collect_list(c).alias(f"{name}_{c}") for c in columns])

    count = rows.groupBy("b").agg(F.count("*").alias("_rows"))
    # one list of structs keeps ids, hashes and distances together
    r = rows.join(count, "b").withColumn("x", F.struct("id", "h", "best"))
    both = pieces(r, ["x"], F.col("_rows"), "r").join(pieces(hashes, ["h"], F.col("_size"), "l"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                x, g = one.column("r_x").flatten(), one.column("l_h").flatten().to_numpy()
                ids, h, best = (x.field(c) for c in range(3))
                h, known = h.to_numpy(), pc.fill_null(best, 65).to_numpy()
                for a in range(0, len(h), STRIP):
                    d = np.bitwise_count((h[a : a + STRIP, None] ^ g).view(np.uint64)).astype(np.int32)
                    least = np.minimum(np.where(d > 0, d, 65).min(1, initial=65), known[a : a + STRIP])
                    ids_ = ids.slice(a, STRIP)
                    block_ = pa.array([one.column("b")[0].as_py()] * len(least), one.schema.field("b").type)
                    yield pa.RecordBatch.from_arrays([block_, ids_, pa.array(least, pa.int32(), mask=least > 64)], names=["b", "id", "best"])

    return both.select("b", "r_x", "l_h").mapInArrow(compare, f"b {block_kind}, id {id_kind}, best int")


def best_summary(best: DataFrame, block: str) -> DataFrame:
    return best.groupBy(block).agg(F.count("*").alias("n"), F.median("best").alias("median_best"), F.min("best").alias("min_best"))
