"""Reports on collections: first groups, samples, note columns, ordered lists, merged layers, summary lines."""

import uuid

from pyspark.sql import functions as F

from brindle import sources
from brindle.operators import dedup, enrich, profile
from brindle.plans import sinks
from brindle.plans import workflows as W
from brindle.plans.registry import register, table
from brindle.sources.stores import shared_dir


@register(
    "first_dup_groups",
    "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY first_id LIMIT 10",
)
def first_dup_groups(spark, sf_dir):
    """The ten duplicate groups that appear first."""
    return dedup.first_groups(table(spark, sf_dir, "documents"), "text", "doc_id", 10)


@register("seeded_sample", "SELECT lang, arg_min(doc_id, (md5('0:' || doc_id), doc_id)) AS doc_id FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def seeded_sample(spark, sf_dir):
    return profile.sampled_row(table(spark, sf_dir, "documents"), "lang", "doc_id", seed=0)


_NOTE = "string_agg(l_linenumber || '(' || (l_quantity::INT) || ')', ';' ORDER BY l_linenumber, l_quantity::INT) FILTER (l_returnflag = '{}') AS note_{}"


@register(
    "note_lookup",
    f"WITH n AS (SELECT l_orderkey, {', '.join(_NOTE.format(f, f.lower()) for f in 'ANR')} FROM lineitem GROUP BY 1) "
    "SELECT o_orderkey, note_a, note_n, note_r FROM orders LEFT JOIN n ON o_orderkey = l_orderkey",
)
def note_lookup(spark, sf_dir):
    """Three note columns for each order, from one aggregation and one join."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    notes = enrich.note_columns(items, ["o_orderkey"], "l_returnflag", {"A": "note_a", "N": "note_n", "R": "note_r"}, ["l_linenumber", "q"], "%d(%d)")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(notes, "o_orderkey", "left")


@register(
    "two_key_order",
    "SELECT o_orderpriority, o_totalprice, o_orderkey, (row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey))::INT AS place FROM orders QUALIFY place <= 20",
)
def two_key_order(spark, sf_dir):
    """The first twenty by two keys, with their places."""
    top = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(20)
    rows = F.array_agg(F.struct("o_orderpriority", (-F.col("o_totalprice")).alias("_p"), "o_orderkey", "o_totalprice"))
    listed = top.agg(F.array_sort(rows).alias("r")).select(F.posexplode("r").alias("place", "x"))
    return listed.select("x.o_orderpriority", "x.o_totalprice", "x.o_orderkey", (F.col("place") + 1).alias("place"))


@register("suffix_filter", "SELECT p_partkey, p_type FROM part WHERE suffix(p_type, 'ARD')")
def suffix_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_type").endswith("ARD")).select("p_partkey", "p_type")


@register(
    "layer_merge",
    """
    WITH u AS (SELECT 'customer' AS layer, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier
      UNION ALL SELECT 'nation', n_nationkey FROM nation UNION ALL SELECT 'region', r_regionkey FROM region)
    SELECT k, count(*) AS n, string_agg(DISTINCT layer, ',' ORDER BY layer) AS layers FROM u GROUP BY 1
    """,
)
def layer_merge(spark, sf_dir):
    """Four sources under one key: united before one grouping, so each is shuffled once."""
    keys = {"customer": "c_nationkey", "supplier": "s_nationkey", "nation": "n_nationkey", "region": "r_regionkey"}
    every = sources.layered({name: table(spark, sf_dir, name).select(F.col(k).alias("k")) for name, k in keys.items()})
    return every.groupBy("k").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))


@register(
    "payload_join",
    """
    SELECT doc_id, quality, label FROM documents JOIN labels USING (doc_id) JOIN embeddings ON vec_id = doc_id WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''
    """,
)
def payload_join(spark, sf_dir):
    """Flags with their record and payload; rows without a payload, or with a blank one, go."""
    docs = table(spark, sf_dir, "documents").where(F.btrim("text", F.lit(" \t\n")) != "").select("doc_id")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")


@register(
    "containment_sweep",
    """
    WITH b AS (SELECT o_orderkey AS id, v, o_orderkey % 47 * v AS s FROM orders, (SELECT unnest([1, 2, 3]) AS v))
    SELECT 'grow' AS step, v::DOUBLE AS value, count(*) AS n, count(*) FILTER (s >= id % 31 + 1 AND s >= id % 29 + 1) AS n_contains, median(s / 150.0) AS median_kept,
      median(s / 200.0) AS median_width_frac FROM b GROUP BY v
    """,
)
def containment_sweep(spark, sf_dir):
    """How often boxes hold their region at each setting, with the median coverage."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    boxes = ids.select("id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("v")).withColumn("s", F.col("id") % 47 * F.col("v"))
    zero = F.lit(0)
    boxes = boxes.select("id", F.lit("grow").alias("step"), F.col("v").cast("double").alias("value"), zero.alias("x0"), zero.alias("y0"), F.col("s").alias("x1"), F.col("s").alias("y1"), (F.col("s") / 150).alias("kept"), (F.col("s") / 200).alias("width_frac"))
    regions = ids.select("id", F.lit(1).alias("rx0"), F.lit(1).alias("ry0"), (F.col("id") % 31 + 1).alias("rx1"), (F.col("id") % 29 + 1).alias("ry1"))
    return W.containment(boxes, regions)


@register(
    "duplicate_report",
    """
    WITH g AS (SELECT md5(text) AS md5, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT unnest(['files', 'unique', 'groups', 'grouped files', 'largest group']) AS name,
      unnest([sum(n), count(*), count(*) FILTER (n > 1), coalesce(sum(n) FILTER (n > 1), 0), max(n)])::BIGINT AS n FROM g
    """,
)
def duplicate_report(spark, sf_dir):
    """The lines of a console report on exact duplicates; sinks.console() prints them."""
    return sinks.counted_lines(dedup.duplicate_counts(table(spark, sf_dir, "documents"), "text"))


@register(
    "workbook_columns",
    """SELECT 'events' AS sheet, event_type AS name, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL
    UNION ALL SELECT 'items', l_returnflag, count(*), round(avg(l_quantity), 6) FROM lineitem GROUP BY ALL""",
)
def workbook_columns(spark, sf_dir):
    """Two summaries as sheets of one spreadsheet, read back by three of their columns."""
    path = f"{shared_dir(spark)}/brindle/summary-{uuid.uuid4().hex}.xlsx"
    sheets = {}
    for name, source, group, value in (("events", "events", "event_type", "value"), ("items", "lineitem", "l_returnflag", "l_quantity")):
        means = table(spark, sf_dir, source).groupBy(F.col(group).alias("name"))
        sheets[name] = means.agg(F.min(value).alias("least"), F.count("*").alias("n"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))
    sinks.workbook(sheets, path)
    parts = [sources.sheet(spark, path, name, "mean double, name string, n long").withColumn("sheet", F.lit(name)) for name in sheets]
    return parts[0].unionByName(parts[1])


@register(
    "nested_report_back",
    """WITH g AS (SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    SELECT md5 AS name, n, first_id FROM g UNION ALL SELECT 'groups', count(*), NULL FROM g""",
)
def nested_report_back(spark, sf_dir):
    """Duplicate groups written as sections of one JSON document, an object by hash beside a list of counts, and read back from it."""
    path = f"{shared_dir(spark)}/brindle/report-{uuid.uuid4().hex}.json"
    docs = table(spark, sf_dir, "documents").where("text is not null")
    groups = docs.groupBy(F.md5(F.col("text").cast("binary")).alias("md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    sinks.nested_report({"groups": (groups, "md5"), "totals": groups.agg(F.count("*").alias("groups")), "made by": "md5"}, path)
    back = sources.report(spark, path, "groups map<string, struct<n: bigint, first_id: bigint>>, totals array<struct<groups: bigint>>")
    each = back.select(F.explode("groups").alias("name", "x")).select("name", "x.n", "x.first_id")
    return each.unionByName(back.select(F.inline("totals")).select(F.lit("groups").alias("name"), F.col("groups").alias("n"), F.lit(None).cast("bigint").alias("first_id")))
