"""Exact duplicates, their classes and notes, and Hamming joins."""

from pyspark.sql import functions as F

from brindle.operators import dedup
from brindle.plans.registry import register, table


def _docs(spark, sf_dir):
    split = F.expr("CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'test' ELSE 'valid' END")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", split.alias("split"))


_SPLIT = "(SELECT *, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'test' ELSE 'valid' END AS split FROM documents WHERE text IS NOT NULL)"


@register(
    "exact_dup_groups",
    "SELECT md5(text) AS md5, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
)
def exact_dup_groups(spark, sf_dir):
    out = dedup.exact_groups(_docs(spark, sf_dir), "text", ["doc_id"])
    return out.select("md5", "n", F.array_join(F.transform("members", lambda m: m["doc_id"].cast("string")), ",").alias("ids"))


@register("hash_counts", "SELECT count(*) AS files, count(DISTINCT md5(text)) AS unique_hashes FROM documents WHERE text IS NOT NULL")
def hash_counts(spark, sf_dir):
    return dedup.hash_counts(_docs(spark, sf_dir), "text")


@register(
    "dup_group_classes",
    f"""
    WITH g AS (SELECT md5(text) AS md5, count(*) AS n, min(source) = max(source) AS all_same_layer, bool_or(lang = 'en') AND bool_or(lang <> 'en') AS cross_side,
      count(DISTINCT split) AS n_splits FROM {_SPLIT} GROUP BY 1 HAVING count(*) > 1)
    SELECT *, cross_side AND NOT all_same_layer AS cross_mixed FROM g
    """,
)
def dup_group_classes(spark, sf_dir):
    return dedup.group_classes(_docs(spark, sf_dir), "text", "source", F.col("lang") == "en", "split")


@register(
    "cross_split_leak",
    f"""
    SELECT md5(text) AS md5, count(*) AS n, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM {_SPLIT} GROUP BY 1
    HAVING count(*) > 1 AND count(DISTINCT split) FILTER (split IN ('train', 'test')) = 2
    """,
)
def cross_split_leak(spark, sf_dir):
    return dedup.split_leaks(_docs(spark, sf_dir), "text", "split").withColumn("splits", F.array_join("splits", ","))


@register(
    "dup_notes",
    """
    WITH h AS (SELECT doc_id, source, md5(text) AS md5 FROM documents WHERE text IS NOT NULL),
    g AS (SELECT md5 FROM h GROUP BY 1 HAVING count(*) = 2),
    p AS (SELECT a.doc_id, a.source, b.doc_id AS o, b.source AS os FROM h a JOIN h b ON a.md5 = b.md5 AND a.doc_id <> b.doc_id JOIN g ON g.md5 = a.md5)
    SELECT d.doc_id, p.o AS duplicate_of FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id
    """,
)
def dup_notes(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    notes = dedup.pair_notes(docs, "text", "doc_id", "source")
    return docs.select("doc_id").join(notes.select("doc_id", F.col("other_item").alias("duplicate_of")), "doc_id", "left")


@register(
    "dup_notes_all_members",
    """
    WITH h AS (SELECT doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL),
    g AS (SELECT md5, min(doc_id) AS a, max(doc_id) AS b FROM h GROUP BY 1 HAVING count(*) > 1)
    SELECT doc_id, CASE WHEN doc_id = a THEN b ELSE a END AS duplicate_of FROM h JOIN g USING (md5)
    """,
)
def dup_notes_all_members(spark, sf_dir):
    return dedup.pair_notes(_docs(spark, sf_dir), "text", "doc_id", "source", "all").select("doc_id", F.col("other_item").alias("duplicate_of"))


@register(
    "match_notes",
    """
    SELECT l_orderkey, string_agg(l_returnflag || '/' || l_linenumber || '(' || (l_quantity::INT) || ',iou=' || printf('%.2f', l_discount) || ')', ';'
      ORDER BY l_returnflag, l_linenumber, l_quantity::INT, l_discount) AS note
    FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1
    """,
)
def match_notes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("l_discount >= 0.05").withColumn("q", F.col("l_quantity").cast("int"))
    return dedup.match_notes(items, ["l_orderkey"], "l_returnflag", "l_linenumber", "q", "l_discount")


def _hashes(spark, sf_dir, bits):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", dedup.sign_hash("embedding", bits).alias("h"))


def _hash_sql(bits):
    return f"""WITH h AS (SELECT vec_id, label, sum(CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END)::BIGINT AS h
      FROM embeddings, (SELECT unnest(range(1, {bits + 1})) AS i) GROUP BY ALL) """


def _pairs_sql(bits, most):
    return (
        _hash_sql(bits)
        + f"SELECT a.label, a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.label = b.label AND a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= {most}"
    )


@register("hamming_pairs", _pairs_sql(62, 20))
def hamming_pairs(spark, sf_dir):
    h = _hashes(spark, sf_dir, 62)
    out = dedup.hamming_join(h, h, "label", "h", 20, order="vec_id")
    return out.select(F.col("l_label").alias("label"), F.col("l_vec_id").alias("a"), F.col("r_vec_id").alias("b"), "distance")


@register("hamming_banded", _pairs_sql(16, 2))
def hamming_banded(spark, sf_dir):
    h = _hashes(spark, sf_dir, 16)
    out = dedup.banded_hamming_join(h, h, "label", "h", 2, bits=16).where("l_vec_id < r_vec_id")
    return out.select(F.col("l_label").alias("label"), F.col("l_vec_id").alias("a"), F.col("r_vec_id").alias("b"), "distance")


@register(
    "hamming_best_per_row",
    _hash_sql(62)
    + """, b AS (SELECT r.label, r.vec_id, min(bit_count(xor(l.h, r.h))) AS best FROM h r JOIN h l ON l.label = r.label AND l.vec_id <> r.vec_id GROUP BY ALL)
    SELECT label, count(*) AS n, median(best) AS median_best, min(best)::INT AS min_best FROM b GROUP BY label""",
)
def hamming_best_per_row(spark, sf_dir):
    h = _hashes(spark, sf_dir, 62)
    best = dedup.best_distance(h, h, "label", "h", "vec_id", other=True)
    return dedup.best_summary(best, "label")
