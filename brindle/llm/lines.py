"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import GAP, documents, dropped, flagged, flags_of, kept, saved, text_of, with_unique, written

#: Two lines match if their word sets have a Jaccard similarity of 4/5 at least. Shorter lines than LEAST different words recur by chance and stay.
LEAST = 5
#: From so many bytes in UTF-8 on, a line of fewer different words matches lines that equal it but for case and white space at its ends: some thirteen
#: letters of a script without spaces, about what five words take elsewhere.
WHOLE = 40
PARTS = 4
#: Up to so many different words 64 bits of parity tell lines apart well enough.
LONG = 96
RANKS = 1 << 16
#: Counters of a row when words are counted: so many times fewer groups stay in the small hash table that Spark compiles for them.
COUNTERS = 4
NO_ID = -(1 << 63)
#: Of so many equal parts of all words, those of the first one are joined before the others: most lines that match an earlier one share a word of it.
SHARES = 4
#: What names a class: the place of its first line, and the parity for ids that repeat with other texts.
OWN = ["doc", "line", "parity"]


def need(total: Column) -> Column:
    """Words that two lines with so many words together must share."""
    return F.ceil(4 * total / 9)


def bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 48).cast("int")


def rarity(docs: DataFrame, text_col: str = "text") -> Column:
    """For each of 65,536 hash buckets what turns a hash's upper 16 bits into the bucket's rank by how many words of the whole corpus fall in it, rarest first.

    A constant array for key(). Its size is fixed, so it is part of the plan, and with it a word's hash alone gives its place in the order: no join of words with counts.
    The driver holds a plan's constants as text several times, for each description of it, so they are small numbers; key() moves them to the upper bits.
    """
    lines = docs.select(F.explode(F.split(F.lower(text_of(text_col)), "\n")).alias("words"))
    words = lines.select(F.explode(split_words(F.col("words"))).alias("w"))
    at = words.select(bucket(F.xxhash64("w")).alias("b"))
    low, high = F.col("b").bitwiseAND(RANKS // COUNTERS - 1), F.shiftright("b", (RANKS // COUNTERS).bit_length() - 1)
    rows = at.groupBy(low.alias("low")).agg(*[F.count(F.when(high == k, 1)).alias(f"n{k}") for k in range(COUNTERS)]).collect()  # 16,384 at most
    counts = {k * (RANKS // COUNTERS) + r["low"]: r[f"n{k}"] for r in rows for k in range(COUNTERS)}
    turns = [0] * RANKS
    for rank, b in enumerate(sorted(range(RANKS), key=lambda b: (counts.get(b, 0), b))):
        # keys are signed, so the lowest ranks are those whose highest bit is set
        turns[b] = (rank - RANKS // 2) % RANKS ^ b
    return F.split(F.lit(",".join(map(str, turns))), ",").cast("array<bigint>")


def key(h: Column, ranks: Column) -> Column:
    """A word's hash with the bucket's rank in place of the bucket: equal keys are equal hashes."""
    # a number is there for each bucket; arrays that can't hold nulls sort as plain longs
    return F.shiftleft(F.coalesce(F.get(ranks, bucket(h)), F.lit(0).cast("bigint")), 48).bitwiseXOR(h)


def split_words(text: Column) -> Column:
    """The words of a text, empty ones among them. Where the blank is its only white space it is cut there, without a regular expression."""
    other = F.contains(text, F.lit("\t"))
    for c in "\x0b\f\r\n":
        other = other | F.contains(text, F.lit(c))
    return F.when(other, F.split(text, GAP)).otherwise(F.split(text, " "))


def tokens(line: Column, ranks: Column) -> Column:
    """A line's different words as sorted longs: the bucket's rank before the rest of the 64-bit hash, so that they
    sort by rarity and equal longs are equal hashes."""

    # hashes first, as key needs each twice; sort_array compares in the engine; array_sort would call a comparator for each pair
    hashes = F.transform(split_words(line), lambda w: F.xxhash64(w))
    keys = F.array_distinct(F.transform(hashes, lambda h: key(h, ranks)))
    # the empty word goes last: outside of transform() longs are compared in compiled code
    return F.sort_array(F.array_remove(keys, key(F.xxhash64(F.lit("")), ranks)))


def key_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line, words): all lines in lower case; a null id counts as the lowest."""
    return docs.select(key_of(id_col).alias("doc"), F.posexplode(F.split(F.lower(text_of(text_col)), "\n")).alias("line", "words"))


def _bit(t: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), t.bitwiseAND(F.lit(63)).cast("int"))


def _turned(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, t: a.bitwiseXOR(_bit(t)))


def _range(k: int) -> Column:
    return F.filter("tok", lambda t: t.bitwiseAND(F.lit((PARTS - 1) << 7)) == F.lit(k << 7))


def occurrences(docs: DataFrame, ranks: Column, id_col: str, text_col: str, least: int = LEAST, whole: int | None = None) -> DataFrame:
    """A row for each line that may take part: doc, line, its words (tok), their number n, and, for a line of fewer than `least` words, its trimmed text (whole) and bytes (size)."""
    rows = line_rows(docs, id_col, text_col)
    # `least` different words take as many characters and the gaps between
    rows = rows.where(F.length("words") >= 2 * least - 1)
    text = F.btrim("words", F.lit(" \t\n\x0b\f\r")) if whole is not None else F.lit(None).cast("string")
    rows = rows.select("doc", "line", text.alias("whole"), tokens(F.col("words"), ranks).alias("tok"))
    return rows.select("doc", "line", "tok", F.size("tok").alias("n"), F.when(F.size("tok") < least, F.col("whole")).alias("whole"))


def described(rows: DataFrame, least: int) -> DataFrame:
    """occurrences() with the 128-bit hash of each line's word set (h1, h2), or of its text where it has few words, and what joins need of it.

    prefix: its rarest words, of which two matching lines share one. parity: 64 bits, of which a word turns over one, so sets differ in as many words at
    least as bits; wide: the same for each of PARTS hash ranges, for lines of over LONG words.
    """
    n, few = F.col("n"), F.col("n") < least
    return rows.select(
        "doc",
        "line",
        F.when(few, F.xxhash64(F.lit(2), F.col("whole"))).otherwise(F.xxhash64("tok")).alias("h1"),
        F.when(few, F.xxhash64(F.lit(3), F.col("whole"))).otherwise(F.xxhash64(F.lit(1), F.col("tok"))).alias("h2"),
        "n",
        F.octet_length("whole").alias("size"),
        F.when(~few, F.slice("tok", F.lit(1), n - F.ceil(4 * n / 5).cast("int") + 1)).alias("prefix"),
        F.when(few, 0).otherwise(_turned(F.col("tok"))).cast("bigint").alias("parity"),
        F.when(n > LONG, F.array(*[_turned(_range(k)) for k in range(PARTS)])).alias("wide"),
    )


def in_first(tok: Column) -> Column:
    """Whether a word is in the first of the SHARES parts, by bits that neither ranks nor parities use."""
    return F.pmod(F.shiftright(tok, 10), F.lit(SHARES)) == 0


def posted(firsts: DataFrame) -> DataFrame:
    """A row for each prefix word of each class: tok, doc, line, at (number of words and place among them), parity and wide (null for short lines)."""
    rows = firsts.select(*OWN, "n", "wide", F.posexplode("prefix").alias("pos", "tok"))
    return rows.select("tok", *OWN, (F.shiftleft(F.col("n").cast("bigint"), 32) + F.col("pos")).alias("at"), "wide")


def close(l: str, r: str) -> Column:
    """Whether two posted rows pass the length, positional and parity filters, which no matching pair fails under the first word that it shares.

    Before that word it shares none, so all it shares are this word and those behind it on either side; under later words it needn't pass.
    """
    n1, n2 = F.shiftright(f"{l}.at", 32), F.shiftright(f"{r}.at", 32)
    p1, p2 = F.col(f"{l}.at").bitwiseAND((1 << 32) - 1), F.col(f"{r}.at").bitwiseAND((1 << 32) - 1)
    apart = F.bit_count(F.col(f"{l}.parity").bitwiseXOR(F.col(f"{r}.parity")))
    wide = sum((F.bit_count(F.get(f"{l}.wide", F.lit(k)).bitwiseXOR(F.get(f"{r}.wide", F.lit(k)))) for k in range(PARTS)), F.lit(0))
    # In whole numbers. Sets of n1 and n2 words that share need(n1 + n2) differ in a ninth of n1 + n2 at most; bits that differ are as many as words that differ, or fewer by
    # an even number, so nothing is lost by rounding. Four ninths of both must be left from the word on; for the whole of a set that is the length filter.
    near = (9 * apart <= n1 + n2) & (9 * (n1 - p1) >= 4 * (n1 + n2)) & (9 * (n2 - p2) >= 4 * (n1 + n2))
    # folding a long line's ranges gives its parity, so a short line has nothing to add
    return near & ((n1 <= LONG) | (n2 <= LONG) | (9 * wide <= n1 + n2))


def before(l: str, r: str) -> Column:
    return (F.col(f"{l}.doc") < F.col(f"{r}.doc")) | ((F.col(f"{l}.doc") == F.col(f"{r}.doc")) & (F.col(f"{l}.line") < F.col(f"{r}.line")))


def involved(rows: DataFrame) -> DataFrame:
    """The posted rows that have some other class under their word which passes the filters with them.

    A semi join: a crowd of near copies gives a row for each posted row, never one for each pair.
    """
    # columns that can't be null are compared without a look at that, and the filters come first: the join holds each row against many
    zero = F.lit(0)
    rows = rows.select("tok", *[F.coalesce(c, zero.cast(rows.schema[c].dataType)).alias(c) for c in (*OWN, "at")], "wide")
    other = (F.col("l.doc") != F.col("r.doc")) | (F.col("l.line") != F.col("r.line"))
    return rows.alias("l").join(rows.alias("r"), (F.col("l.tok") == F.col("r.tok")) & close("l", "r") & other, "left_semi")


def undecided(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Of involved rows those whose class, or a later partner's under the same word, isn't among the classes (OWN) that are known to be matched."""
    rows = saved(rows.join(gone.withColumn("known", F.lit(True)), OWN, "left").withColumn("open", F.isnull("known")).drop("known"), "openrows")
    cond = (F.col("l.tok") == F.col("r.tok")) & ((before("r", "l") & F.col("l.open")) | (before("l", "r") & F.col("r.open"))) & close("l", "r")
    return rows.alias("l").join(rows.alias("r"), cond, "left_semi").drop("open")


def with_words(rows: DataFrame, docs: DataFrame, ranks: Column, id_col: str, text_col: str) -> DataFrame:
    """Posted rows with all words of their line. The words are made again from the texts of just the lines that take part."""
    wanted = saved(rows.select("doc", "line").distinct(), "wanted")
    some = docs.where(flagged(flags_of(wanted, ["doc"]), key_of(id_col)))
    lines = line_rows(some, id_col, text_col).where(flagged(flags_of(wanted, ["doc", "line"]), F.col("doc"), F.col("line")))
    lines = lines.join(wanted, ["doc", "line"]).select("doc", "line", tokens(F.col("words"), ranks).alias("tok"))
    # repeated ids may have other texts
    sets = saved(lines.select("doc", "line", _turned(F.col("tok")).alias("parity"), F.col("tok").alias("words")), "wordsets")
    return rows.join(sets.groupBy(*OWN).agg(F.first("words").alias("words")), OWN)


def matched(rows: DataFrame) -> DataFrame:
    """OWN of the classes that some earlier class matches, from posted rows with words; a semi join stops at the first match."""
    rows = saved(rows, "withwords")
    same = F.size(F.array_intersect("l.words", "r.words"))
    enough = same >= need(F.size("l.words") + F.size("r.words"))
    cond = (F.col("l.tok") == F.col("r.tok")) & before("r", "l") & close("l", "r") & enough
    return rows.alias("l").join(rows.alias("r"), cond, "left_semi").select(*OWN).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: int | None = None, least: int = LEAST) -> DataFrame:
    """(doc, removed array<int>): numbers, from 0, of the lines of each document that match a line before them.

    Before means in a document with a lower id or higher up in the same one. A line is removed if any earlier line matches it, itself removed or
    not, so the result doesn't depend on the order of work. Lines with fewer than `least` different words (1 at least) match equal lines if they take `whole` bytes
    at least, blank ones never; without `whole` they never match, as OP7_SQL has it. Null and empty texts have no line; rows that repeat an id are judged
    alike, each by its own text. Ids are cast to long; a null id counts as the lowest. An empty table gives an empty result.

    Equal sets are one class. Semi joins first find the classes that have a near partner by the filters, then, with the words of just those, the
    classes that an earlier one matches; so no table grows with the pairs of a crowd. That is done for one part of all words and then for the others, where
    only classes that are still unmatched need a partner, so the posted rows are never on disk at once and few rows take their line's words along.
    """
    ranks = rarity(docs.select(text_col), text_col)
    docs = docs.select(id_col, text_col)
    # the filter is on the described rows; before it the optimiser would make the word sets twice, once to filter by
    every = saved(described(occurrences(docs, ranks, id_col, text_col, least, whole), least), "lines")
    taking = F.col("n") >= least if whole is None else (F.col("n") >= least) | ((F.col("n") > 0) & (F.col("size") >= whole))
    rows = every.where(taking)
    # counts alone are summed up by hashing; least structs are sorted, so only those lines that flags don't show to be alone in their class have them sought
    counts = saved(rows.groupBy("h1", "h2").agg(F.count("*").alias("times")), "linecounts")
    flags = flags_of(counts.where("times > 1"), ["h1", "h2"])
    several = flagged(flags, F.col("h1"), F.col("h2"))
    total = counts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    dropped(counts)
    classes = rows.where(several).groupBy("h1", "h2").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("times"))
    classes = saved(classes, "lineclasses")
    # a line alone in its class is its first; the others are looked up, by their place, so that no frequent line gathers
    told = rows.where(F.col("prefix").isNotNull())
    at_first = classes.select("h1", "h2", "first.doc", "first.line")
    places = rows.select("doc", "line", F.struct("h1", "h2").alias("h"))
    told = told.select("h1", "h2", *OWN, "n", "wide", "prefix")
    # the others are read where they are
    firsts = told.where(~several).unionByName(saved(told.where(several).join(at_first, ["h1", "h2", "doc", "line"], "left_semi"), "firsts"))
    if not docs.groupBy(id_col).count().where("count > 1").isEmpty():
        firsts = saved(firsts.dropDuplicates(OWN), "firsts")
    rows = posted(firsts)
    near = saved(involved(rows.where(in_first(F.col("tok")))), "involved")
    gone = saved(matched(with_words(near, docs, ranks, id_col, text_col)), "gone")
    # a line that one word settles needs no other, neither its own nor an earlier line's for it
    near = saved(involved(rows.where(~in_first(F.col("tok")))), "involved")
    near = saved(undecided(near, gone), "undecided")
    gone = gone.unionByName(saved(matched(with_words(near, docs, ranks, id_col, text_col)), "gone")).distinct()
    gone = saved(firsts.select("h1", "h2", *OWN).join(gone, OWN).select("h1", "h2", F.lit(True).alias("gone")).distinct(), "goneclasses")
    # only classes that lose a line matter: those that occur again and those matched by an earlier one
    fate = classes.where("times > 1").join(gone, ["h1", "h2"], "full")
    fate = fate.select(F.struct("h1", "h2").alias("h"), "first", F.coalesce("times", F.lit(1)).alias("times"), F.coalesce("gone", F.lit(False)).alias("gone"))
    fate = saved(fate, "fate")
    judged = with_unique(places, fate, "h", "times", total)
    lost = judged.where(F.col("gone") | (F.col("first") < F.struct("doc", "line")))
    return lost.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: int | None = WHOLE, least: int = LEAST) -> DataFrame:
    """docs with the matching lines taken out of the text; all columns and rows stay. A text that loses no line is as it was.

    Lines of fewer than `least` words go too, from `whole` bytes on, where they repeat exactly. Nulls, repeats and empty tables: see removed_lines().

    Texts of documents that lose nothing don't move.
    """
    since = written()
    lost = kept(removed_lines(docs, id_col, text_col, whole, least), "lost", since)
    key = key_of(id_col)
    hit = flagged(flags_of(lost, ["doc"]), key)
    own, gone, some_gone = _fresh(docs.columns, "key"), _fresh(docs.columns, "removed"), _fresh(docs.columns, "hit")
    keyed = docs.withColumns({own: key, some_gone: hit})
    lines = F.split(F.col(text_col), "\n")
    staying = F.filter(lines, lambda x, k: ~F.array_contains(F.col(gone), k))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(staying, "\n"))
    some = keyed.where(some_gone).join(lost.select(F.col("doc").alias(own), F.col("removed").alias(gone)), own, "left").withColumn(text_col, text)
    return keyed.where(~F.col(some_gone)).select(*docs.columns).unionByName(some.select(*docs.columns))


def _fresh(columns: list[str], name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): every document, the numbers of its removed lines comma-joined."""
    docs = documents(spark, sf_dir)
    since = written()
    lost = kept(removed_lines(docs), "lost", since)
    n = docs.select("doc_id", F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), F.size(F.split(text_of(), "\n")).cast("long").alias("n_lines"))
    out = n.join(lost, "doc", "left")
    return out.select("doc_id", "n_lines", F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS w, generate_subscripts(string_split(lower(coalesce(text, '')), chr(10)), 1) - 1 AS line FROM documents),
s AS (SELECT doc_id, line, list_distinct(list_filter(regexp_split_to_array(w, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS s FROM l),
t AS (SELECT doc_id, line, s, len(s) AS n FROM s WHERE len(s) >= 5),
w AS (SELECT doc_id, line, n, unnest(s) AS word FROM t),
f AS (SELECT word, count(*) AS c FROM w GROUP BY 1),
r AS (SELECT doc_id, line, n, word, row_number() OVER (PARTITION BY doc_id, line ORDER BY c, word) AS k FROM w JOIN f USING (word)),
pre AS (SELECT * FROM r WHERE k <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.doc_id AS d1, a.line AS l1, b.doc_id AS d2, b.line AS l2 FROM pre a JOIN pre b ON a.word = b.word AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.line < b.line)) AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT DISTINCT d2, l2 FROM cand JOIN t x ON x.doc_id = d1 AND x.line = l1 JOIN t y ON y.doc_id = d2 AND y.line = l2 WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)),
g AS (SELECT d2 AS doc_id, count(*) AS n_removed, string_agg(l2::VARCHAR, ',' ORDER BY l2) AS removed FROM m GROUP BY 1)
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents LEFT JOIN g USING (doc_id)
"""
