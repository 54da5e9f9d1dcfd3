import zlib

from brindle.llm import shards as S


def slow(rows, n):
    rows = sorted(((i if i is not None else -1), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, at, out = sum(r[1] for r in rows), 0, []
    slots = {}
    for i, size, crc in rows:
        shard = min(n - 1, (2 * at + size) * n // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i, size, crc, shard, slots[shard]))
        at += size
    return out


def check(spark, rows, n=8):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, slot int").repartition(3)
    got = sorted((r.id if r.id is not None else -1, r.size, r.text_crc32, r.shard, r.slot) for r in S.byte_shards(df, n).collect())
    assert got == sorted(slow(rows, n))
    return got


def test_matches_brute_force(spark):
    check(spark, [(i * 7, "é" * (i % 50) + "x" * (i * i % 97)) for i in range(700)])


def test_edge_rows(spark):
    check(spark, [(1, None), (1, None), (1, ""), (None, "a"), (3, "z" * 100_000)] + [(5, "same")] * 300)
    check(spark, [(4, "one")])
    assert S.byte_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shards_are_balanced_and_contiguous(spark):
    out = S.op3_byte_shards(spark, "/root/testdata/sf0.01").collect()
    sizes, longest = {}, max(r["size"] for r in out)
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - mean) <= longest for s in sizes.values())
    assert [r.shard for r in sorted(out, key=lambda r: r.doc_id)] == sorted(r.shard for r in out)
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}


def test_query_matches_sql(spark):
    from tests.llm.sql import same

    same(spark, "/root/testdata/sf0.01", "op3_byte_shards")
