"""Personal data: exact patterns, and terms that disclose what the patterns found."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import GAP, documents, flagged, flags_of, saved, text_of

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
#: In this order; a term that discloses an entity and an identifier that is a secret come last.
KINDS = ("email", "ip", "card", "phone", "term", "secret")
#: An identifier is a run of so many of these characters at least, with a letter and a digit; the word before it, up to so many other characters away on its line, is what announces it.
IDENTIFIER = r"(?:(?<![A-Za-z0-9_+/-])|\G)[A-Za-z0-9_+/-]{20,}+={0,2}+"
NEEDS_IDENTIFIER = r"[A-Za-z0-9_+/-]{20}"
ANNOUNCED = r"([\p{L}\p{N}_]+)[^\p{L}\p{N}_\n]{1,8}$"
#: The patterns of the four kinds. A lookbehind lets a run that failed at its first character not be tried from each later one; \\G allows
#: what follows a match directly. Possessive repeats never need what they took, so long texts neither backtrack nor recurse.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TRIM = " .,;:!?\"'()[]{}<>|*#$%&/\\=_`~+-–—…«»“”„’"
BUCKETS = 1 << 16
RUN = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Disclosure:
    """A term discloses an entity if their pointwise mutual information is at least alpha times the entity's information
    content, on at least `support` different lines; at `remove` times that it is removed, below generalised."""

    alpha: float = 0.95
    support: int = 3
    remove: float = 0.999


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    backwards = F.split(F.reverse(digits), "")

    def add(acc: Column, d: Column) -> Column:
        v = d.cast("int") * (1 + acc["odd"])
        return F.struct((acc["sum"] + v - F.when(v > 9, 9).otherwise(0)).alias("sum"), (1 - acc["odd"]).alias("odd"))

    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("odd"))
    return F.aggregate(F.filter(backwards, lambda d: d != ""), zero, add, lambda acc: acc["sum"] % 10 == 0)


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def placed(matches: Column, gaps: Column, kind: str, keep=None) -> Column:
    """Spans of matches, given the text between them: code points, end exclusive; those that keep refuses are dropped."""
    number = KINDS.index(kind)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["match"])
        span = F.array(F.struct(a.alias("start"), F.lit(number).alias("kind"), b.alias("end")))
        ok = keep(x["match"]) if keep else F.lit(True)
        return F.struct(b.alias("at"), F.when(ok, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def found(text: Column, kind: str) -> tuple[Column, Column]:
    pattern = F.lit(PATTERNS[kind])
    return F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)


def base_spans(df: DataFrame, text: Column) -> DataFrame:
    """Adds one array of spans for each of the four kinds, named by kind."""
    df = df.withColumn("_t", text)
    for kind in PATTERNS:
        matches, gaps = found(F.col("_t"), kind)
        needed = F.col("_t").contains("@") if kind == "email" else F.col("_t").rlike(NEEDS[kind])
        df = df.withColumn("_m", F.when(needed, F.struct(matches.alias("m"), gaps.alias("g"))))
        spans = _placed_valid(kind)
        df = df.withColumn(kind, F.coalesce(spans, F.array().cast(SPAN))).drop("_m")
    return df.drop("_t")


def _placed_valid(kind: str) -> Column:
    def ok(match: Column) -> Column:
        return valid(kind, match)

    return placed(F.col("_m.m"), F.col("_m.g"), kind, ok)


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])

    def one(s: Column) -> Column:
        return F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def term_of(lower_word: Column) -> Column:
    return F.btrim(lower_word, F.lit(TRIM))


def contexts(units: DataFrame, support: int) -> DataFrame:
    """units (line_id, line) to (line_id, entity, term), each once: all terms of the units that hold an entity.

    Only valid matches are entities and cut out of the text; those on fewer than `support` units are left out up to collisions of buckets.
    """
    out = None
    for kind in PATTERNS:
        matches, gaps = found(F.col("line"), kind)
        rows = units.where(F.col("line").rlike(NEEDS[kind])).select("line_id", matches.alias("m"), gaps.alias("g")).where(F.size("m") > 0)
        parts = F.zip_with("g", "m", lambda g, m: F.struct(g.alias("gap"), m.alias("match"), (m.isNotNull() & F.coalesce(valid(kind, m), F.lit(False))).alias("ok")))  # noqa: B023
        rows = rows.select("line_id", parts.alias("p")).where(F.exists("p", lambda x: x["ok"]))
        rest = F.array_join(F.transform("p", lambda x: F.concat(x["gap"], F.when(x["ok"], F.lit(" ")).otherwise(F.coalesce(x["match"], F.lit(""))))), "")
        good = F.array_distinct(F.transform(F.filter("p", lambda x: x["ok"]), lambda x: x["match"]))
        rows = rows.select("line_id", F.lit(kind).alias("kind"), rest.alias("rest"), good.alias("m"))
        out = rows if out is None else out.unionByName(rows)
    out = saved(out, "units")
    digits = F.regexp_replace("match", "[^0-9]", "")
    name = F.concat("kind", F.lit(":"), F.when(F.col("kind").isin("email", "ip"), F.lower("match")).otherwise(digits))
    often = out.select("line_id", "kind", F.explode("m").alias("match")).select("line_id", name.alias("entity"))
    often = often.distinct().groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    often = saved(often.select(F.col("entity").alias("term")), "entities")
    out = out.select("line_id", "kind", F.array_distinct(F.transform(F.split(F.lower("rest"), GAP), term_of)).alias("terms"), F.explode("m").alias("match"))
    out = out.select("line_id", name.alias("entity"), "terms").where(F.get(bucket_filter(often), bucket(F.col("entity"))))
    out = out.select("line_id", "entity", F.explode("terms").alias("term"))
    # a letter makes a term; digits alone are the patterns' business
    return out.where(F.col("term").rlike(r"\p{L}") & ~F.col("term").rlike("[0-9@]")).distinct()


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bucket_filter(terms: DataFrame) -> Column:
    """Flags that are true where some term falls: as many for any number of terms, so they can go to every task."""
    hit = terms.select(bucket(F.col("term")).alias("b")).distinct()
    every = terms.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    flags = every.join(hit.withColumn("on", F.lit(True)), "b", "left").select(F.struct("b", F.coalesce("on", F.lit(False)).alias("on")).alias("x"))
    return flags.agg(F.array_sort(F.collect_list("x")).alias("f")).select(F.transform("f", lambda x: x["on"])).scalar()


def disclosing(docs: DataFrame, rule: Disclosure = Disclosure(), text_col: str = "text", holders: DataFrame | None = None) -> DataFrame:
    """(term, removed): the terms that disclose an entity by the rule, from all lines and from all documents of docs.

    Co-occurrence is counted by whole line, and again by whole document, for terms that stand on other lines than the entity. A unit counts once
    however often its text occurs, so copies are one witness. holders, if given, has the texts (line) that have a valid match.

    Terms are first counted beside entities, which only holders have; only terms with enough support there are then counted over all texts, for lines
    and documents in the same pass.
    """
    texts = docs.select(text_of(text_col).alias("line"))
    if holders is None:
        holders = saved(texts.where(_holds("line")), "holders")
    # no match holds a line break, so a document's matches are those of its lines
    totals = {"line": _lines(texts).select(F.xxhash64("line").alias("id")), "document": texts.select(F.xxhash64("line").alias("id"))}
    totals = {unit: max(1, ids.distinct().count()) for unit, ids in totals.items()}
    pairs = {unit: _supported(_lines(holders) if unit == "line" else holders, totals[unit], rule) for unit in totals}
    every = saved(pairs["line"].select("term").unionByName(pairs["document"].select("term")).distinct(), "candidates")
    if every.isEmpty():
        return every.select("term", F.lit(True).alias("removed"))
    # sketches of the number of units show the words that are far too common, whose rows then needn't be written
    sizes = saved(term_rows(texts, every).groupBy("term").agg(*[F.approx_count_distinct(unit).alias(f"about_{unit}") for unit in totals]), "sizes")
    pairs = {unit: saved(_not_common(pairs[unit], sizes, unit, totals[unit], rule), "rarer") for unit in totals}
    every = saved(pairs["line"].select("term").unionByName(pairs["document"].select("term")).distinct(), "candidates")
    standing = saved(term_rows(texts, every).join(every, "term", "left_semi").distinct(), "termunits")
    both = _scored(pairs["line"], standing, "line", totals["line"], rule).unionByName(_scored(pairs["document"], standing, "document", totals["document"], rule))
    return both.groupBy("term").agg(F.max("removed").alias("removed"))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.split("line", "\n")).alias("line"))


def _holds(text: str) -> Column:
    """Whether a text has any valid match."""
    out = F.lit(False)
    for kind in PATTERNS:
        some = F.exists(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: valid(kind, m))  # noqa: B023
        out = out | F.when(F.col(text).rlike(NEEDS[kind]), some).otherwise(F.lit(False))
    return out


def _supported(units: DataFrame, total: int, rule: Disclosure) -> DataFrame:
    """(term, entity, n_te, n_e) of the pairs that may pass: on enough units together, and not ruled out by the term's units beside any entity."""
    some = units.where(F.col("line").rlike("@|[0-9]")).select("line", F.xxhash64("line").alias("line_id")).dropDuplicates(["line_id"])
    near = saved(contexts(some, rule.support), "contexts")
    pairs = saved(near.groupBy("term", "entity").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= rule.support), "support")
    n_e = near.select("entity", "line_id").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    beside = near.select("term", "line_id").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    # a term is on no fewer units than those beside entities; the least such count that would fail rules its pair out exactly
    pairs = pairs.join(n_e, "entity").join(beside, "term")
    bar = F.pow(F.col("n_e") / total, F.lit(1 - rule.alpha))
    return saved(pairs.where(F.col("n_te") / F.col("n_near") >= bar * (1 - 1e-9)).drop("n_near"), "pairs")


def _scored(pairs: DataFrame, standing: DataFrame, unit: str, total: int, rule: Disclosure) -> DataFrame:
    n_t = standing.select("term", unit).distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    scored = pairs.join(n_t, "term")
    content = -F.log(F.col("n_e") / total)
    pmi = F.log(F.col("n_te") * float(total) / (F.col("n_t") * F.col("n_e")))
    scored = scored.withColumn("share", pmi / F.greatest(content, F.lit(1e-9))).where(F.col("share") >= rule.alpha)
    return scored.groupBy("term").agg((F.max("share") >= rule.remove).alias("removed"))


def _not_common(pairs: DataFrame, sizes: DataFrame, unit: str, total: int, rule: Disclosure) -> DataFrame:
    """Pairs without those that the rule refuses even at half the sketched number of the term's units, twenty times the sketch's standard error off."""
    most = F.col("n_te") / F.pow(F.col("n_e") / total, F.lit(1 - rule.alpha))
    rows = pairs.join(sizes.select("term", f"about_{unit}"), "term", "left")
    return rows.where(F.coalesce(F.col(f"about_{unit}"), F.lit(0)) <= 2 * most + 8).drop(f"about_{unit}")


def term_rows(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, line, document): hashes of the line and the text in which each occurrence of a term stands, and few occurrences of others."""
    rows = texts.select(F.xxhash64("line").alias("document"), F.explode(F.split("line", "\n")).alias("line"))
    rows = rows.select("document", F.xxhash64("line").alias("line"), F.explode(F.split(F.lower("line"), GAP)).alias("word"))
    # exploded, a term is made once; the filter would make it again
    rows = rows.select("document", "line", F.explode(F.array(term_of(F.col("word")))).alias("term"))
    return rows.where(flagged(flags_of(terms, ["term"]), F.col("term")))


def term_spans(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, gone): spans of the occurrences of terms (term, removed), whatever their case, and those of removed ones, in the documents that have any.

    A term holds no white space, so it stands inside one word, and its first run of letters and digits is one of the word's. Documents with such a run
    are found first; in one more pass over just their texts, the words with one, and only these are searched for their terms.
    """
    heads = saved(terms.withColumn("head", F.regexp_extract("term", RUN, 0)), "heads")
    flags = flags_of(heads, ["head"])
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_t"))
    held = rows.select("id", F.explode(F.split(F.lower("_t"), r"[^\p{L}\p{N}]+", -1)).alias("head")).where(flagged(flags, F.col("head")))
    held = saved(held.join(heads.select("head").distinct(), "head", "left_semi").select("id").distinct(), "held")
    # a column, as a function of each word can't hold the flags themselves; so they are few enough to go with every row
    rows = rows.where(flagged(flags_of(held, ["id"]), F.col("id"))).withColumn("_f", flags_of(heads, ["head"], BUCKETS))

    def runs(word: Column) -> Column:
        return F.regexp_extract_all(F.lower(word), F.lit(RUN), F.lit(0))

    def step(acc: Column, word: Column) -> Column:
        hit = F.exists(runs(word), lambda r: flagged(F.col("_f"), r, buckets=BUCKETS))
        one = F.array(F.struct(acc["at"].alias("at"), word.alias("word")))
        return F.struct((acc["at"] + F.length(word) + 1).alias("at"), F.when(hit, F.concat(acc["hits"], one)).otherwise(acc["hits"]).alias("hits"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<at:bigint,word:string>>").alias("hits"))
    hits = F.aggregate(F.split("_t", r"[\x20\x09-\x0D]", -1), start, step, lambda acc: acc["hits"])
    rows = rows.select("id", F.explode(hits).alias("hit")).select("id", "hit.at", "hit.word")
    rows = rows.select("*", F.explode(F.array_distinct(runs(F.col("word")))).alias("head")).where(flagged(flags, F.col("head"))).join(heads, "head")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), F.replace(F.col("term"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    spans = placed(F.regexp_extract_all("word", pattern, F.lit(0)), F.split("word", pattern, F.lit(-1)), "term")
    moved = F.transform(spans, lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["kind"].alias("kind"), (s["end"] + F.col("at")).alias("end")))
    rows = rows.select("id", "removed", moved.alias("spans"))
    every, gone = F.collect_list("spans"), F.collect_list(F.when(F.col("removed"), F.col("spans")))
    out = rows.groupBy("id").agg(F.array_distinct(F.flatten(every)).alias("term"), F.array_distinct(F.flatten(gone)).alias("gone"))
    return out.where(F.size("term") > 0)


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, document, key, word, start, end): every identifier of the texts, with the word that announces it, lower-cased and empty without one; document is the text's hash."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("_t")).where(F.col("_t").rlike(NEEDS_IDENTIFIER))
    mixed = lambda m: m.rlike("[A-Za-z]") & m.rlike("[0-9]")
    matches, gaps = F.regexp_extract_all("_t", F.lit(IDENTIFIER), F.lit(0)), F.split("_t", IDENTIFIER, -1)
    rows = rows.select("id", F.xxhash64("_t").alias("document"), matches.alias("_m"), gaps.alias("_g")).where(F.exists("_m", mixed))
    each = F.arrays_zip(F.col("_m").alias("key"), F.transform(F.slice("_g", F.lit(1), F.size("_m")), lambda g: F.struct(F.length(g).alias("n"), F.lower(F.regexp_extract(g, ANNOUNCED, 1)).alias("word"))).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]["n"]
        b = a + F.length(x["key"])
        one = F.array(F.struct(x["key"].alias("key"), x["gap"]["word"].alias("word"), a.alias("start"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(mixed(x["key"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<key:string,word:string,start:bigint,end:bigint>>").alias("out"))
    return rows.select("id", "document", F.inline(F.aggregate(each, start, step, lambda acc: acc["out"])))


def secret_spans(docs: DataFrame, rule: Disclosure, id_col: str, text_col: str) -> DataFrame | None:
    """(id, secret, hidden): spans of the secrets and those of removed ones, in the documents that have any; None if there are none.

    That a document holds an identifier is what is protected here. A word tells it by the rule if knowing the word gives away at least alpha of that information: if nearly every different document that
    has the word has it announcing an identifier, with `support` different identifiers at least. An identifier that such a word announces anywhere is a secret wherever it stands; prose words that
    happen to stand before one aren't near the rule.
    """
    keys = saved(identifiers(docs, id_col, text_col), "identifiers")
    told = keys.where("word <> ''").groupBy("word").agg(F.count_distinct("key").alias("n_keys"), F.count_distinct("document").alias("n_te")).where(F.col("n_keys") >= rule.support)
    told = saved(told, "announcing")
    if told.isEmpty():
        return None
    texts = docs.select(F.xxhash64(text_of(text_col)).alias("document"), text_of(text_col).alias("_t"))
    total = max(1, texts.select("document").distinct().count())
    n_e = keys.agg(F.count_distinct("document")).first()[0]
    # a word is in no fewer documents than in those with identifiers; prose words fail by these alone, so they needn't be counted in all texts
    bar = (n_e / total) ** (1 - rule.alpha) * (1 - 1e-9)
    beside = _holding(texts.where(F.col("_t").rlike(NEEDS_IDENTIFIER)), told).withColumnRenamed("n_t", "n_near")
    told = saved(told.join(beside, "word").where(F.col("n_te") >= bar * F.col("n_near")).drop("n_near"), "announcing")
    if told.isEmpty():
        return None
    known = _holding(texts, told)
    content = F.lit(max(1e-9, -math.log(n_e / total)))
    share = F.log(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.lit(n_e))) / content
    words = told.join(known, "word").withColumn("share", share).where(F.col("share") >= rule.alpha)
    secrets = keys.join(F.broadcast(words.select("word", "share")) if told.count() <= BUCKETS else words.select("word", "share"), "word").groupBy("key").agg((F.max("share") >= rule.remove).alias("hidden"))
    span = F.struct("start", F.lit(KINDS.index("secret")).alias("kind"), "end")
    found = keys.join(saved(secrets, "secrets"), "key").groupBy("id").agg(F.collect_set(span).alias("secret"), F.collect_set(F.when(F.col("hidden"), span)).alias("hidden"))
    return saved(found, "secretspans")


def _holding(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n_t): in how many different documents each of the words stands."""
    each = texts.select("document", F.explode(F.array_distinct(F.split(F.lower("_t"), r"[^\p{L}\p{N}_]+", -1))).alias("word"))
    each = each.where(flagged(flags_of(words, ["word"]), F.col("word"))).join(words.select("word"), "word", "left_semi")
    return each.groupBy("word").agg(F.count_distinct("document").alias("n_t"))


def personal(docs: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans, n_email, n_ip, n_card, n_phone, secret, removed): spans of the patterns, and these with the disclosing terms', sorted by start, then kind; apart from
    them those of secrets; removed holds those of terms and secrets to be cut out. sanitised() takes them all.

    Null and empty texts have none. Repeated rows and ids each keep their row; rows that share an id also share its terms' and secrets' spans, so give
    ids that are unique. Other columns of docs are not read.
    """
    rows = base_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), text_of("text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    base = rows.select("id", F.array_sort(F.concat(*PATTERNS)).alias("base"), *counts, F.col("text").alias("line"))
    # one pass finds the patterns; the few texts that have any are kept for the terms beside them
    base = saved(base.withColumn("line", F.when(F.size("base") > 0, F.col("line"))), "base")
    terms = saved(disclosing(docs, rule, text_col, base.where("line is not null").select("line")), "terms")
    secrets = secret_spans(docs, rule, id_col, text_col)
    none = F.array().cast(SPAN)
    out = base.drop("line").withColumns({c: none for c in ("term", "gone", "secret", "hidden")})
    for found in ([] if terms.isEmpty() else [term_spans(docs, terms, id_col, text_col)]) + ([] if secrets is None else [secrets]):
        names = [c for c in found.columns if c != "id"]
        out = out.drop(*names).join(found, "id", "left").withColumns({c: F.coalesce(c, none) for c in names})
    out = out.withColumns({"spans": F.array_sort(F.concat("base", "term")), "removed": F.concat("gone", "hidden"), "secret": F.array_sort("secret")})
    return out.drop("term", "gone", "hidden")


def merged(spans: Column) -> Column:
    """Sorted spans with those that overlap made one of the first one's kind."""
    start = F.array().cast(SPAN)

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        wider = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))
        return F.when(s["start"] < last["end"], joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), start, step)


def sanitised(text: Column, spans: Column, removed: Column | None = None) -> Column:
    """The text with each span generalised to its kind in angle brackets, or cut out where it is among `removed`, spans of the same form.

    Spans that overlap are merged first; what they cover goes as a whole, as the first one's kind, or cut out if all of it is a removed span.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    gone = F.array().cast(SPAN) if removed is None else F.coalesce(removed, F.array().cast(SPAN))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        name = F.when(F.array_contains(gone, s), F.lit("")).otherwise(F.get(names, s["kind"]))
        return F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(between, name)).alias("parts"))

    def done(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    return F.aggregate(merged(spans), start, step, done)


def op9_disclosure(spark, sf_dir) -> DataFrame:
    out = personal(documents(spark, sf_dir))
    return out.select(
        F.col("id").alias("doc_id"), *[f"n_{k}" for k in PATTERNS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        F.size("secret").cast("long").alias("n_secret"), spans_text(F.col("secret")).alias("secret_spans"),
    )
