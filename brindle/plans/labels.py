"""Labels, flags, classification and set operations on ids."""

from pyspark.sql import functions as F

from brindle.operators import enrich
from brindle.plans.registry import register, table

_NAMES = "CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END"


def _labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = enrich.lookup_join(docs, table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])
    return out.withColumn("diagnosis", enrich.code_names(F.col("quality"), {0: "low", 1: "high"}))


@register("label_join", f"SELECT doc_id, lang, quality, toxic, {_NAMES} AS diagnosis FROM documents LEFT JOIN labels USING (doc_id)")
def label_join(spark, sf_dir):
    return _labelled(spark, sf_dir)


@register("label_rate", "SELECT lang, count(*) AS n, count(*) FILTER (quality IS NULL) AS missing, round(avg(toxic), 6) AS toxic_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_rate(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.isnull("quality")).alias("missing"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))


@register("value_counts", f"SELECT {_NAMES} AS diagnosis, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def value_counts(spark, sf_dir):
    from brindle.operators.profile import value_counts as counts

    return counts(_labelled(spark, sf_dir), "diagnosis")


@register("missing_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_ids(spark, sf_dir):
    return enrich.missing_ids(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@register("paired_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def paired_ids(spark, sf_dir):
    return enrich.paired_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@register("exists_flag", "SELECT doc_id, lang = 'en' AND doc_id IN (SELECT doc_id FROM labels) AS has_label FROM documents")
def exists_flag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return enrich.exists_flag(docs, table(spark, sf_dir, "labels"), "doc_id", "has_label", F.col("lang") == "en").drop("lang")


_PHRASES = {"economy": "EC", "small": "SM", "promo": "PR", "standard": "ST"}


@register(
    "caption_region",
    "WITH h AS (SELECT p_partkey, unnest(['economy', 'small', 'promo', 'standard']) AS ph, unnest(['EC', 'SM', 'PR', 'ST']) AS code, lower(p_type) AS t FROM part) "
    "SELECT p_partkey, CASE WHEN count(*) FILTER (contains(t, ph)) = 1 THEN max(code) FILTER (contains(t, ph)) END AS region FROM h GROUP BY 1",
)
def caption_region(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", enrich.classify(F.col("p_type"), _PHRASES).alias("region"))


@register(
    "union_ids",
    "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)",
)
def union_ids(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@register("drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def drop_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@register("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@register(
    "location_decode",
    "SELECT url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, "
    "try_cast(regexp_extract(url, '/([0-9]+)', 1) AS INT) AS item FROM pages",
)
def location_decode(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "url", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) AS INT)").alias("item")
    )
