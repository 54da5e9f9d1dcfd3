"""Quality rules: text statistics and learned decision lists."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import documents, modest_batches, saved

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_window_distinct", "n_upper", "n_chars", "n_lines"]
#: What the rules may test. Each is a plain expression over the counts, so a rule is a Spark condition.
FEATURES: dict[str, str] = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "window_distinct_share": "n_window_distinct / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
}
#: Distinct words are counted within windows of so many words, or long texts would look repetitive.
WINDOW = 100
#: Labelled rows to fit on: the first so many by a hash of the id. Everything else covers all rows.
FIT_ROWS = 20_000
#: A rule must be right on so large a share of the rows it fires on, among those it was not grown on, ...
PRECISION = 0.9
#: ... and fire on so many rows of the class at least.
SUPPORT = 4
MAX_RULES, MAX_TESTS = 12, 3


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS for a text; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    repeat = 0
    if n >= 3:
        grams = list(zip(words, words[1:], words[2:]))
        if len(set(grams)) < len(grams):
            often = {g for g, c in Counter(grams).items() if c > 1}
            covered = -1
            for k, g in enumerate(grams):
                if g in often:
                    repeat += k + 2 - max(covered, k - 1)
                    covered = k + 2
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    upper = sum(map(str.isupper, text)) if n else 0
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, sum(len(set(words[k : k + WINDOW])) for k in range(0, n, WINDOW)), upper, len(text), len(lines)


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS): one pass over the whole texts, row by row, with no shuffle."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = np.array([text_counts(t) for t in b["text"]], np.int64).reshape(len(b), len(COUNTS))
            out = pd.DataFrame(rows, columns=COUNTS)
            out.insert(0, "id", b["id"].to_numpy())
            yield out

    modest_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(work, schema)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.cut if self.above else value <= self.cut


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float
    support: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for t in self.tests:
            out &= t.holds(x)
        return out

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """Adds the test with the most information gained on the class, until the conjunction is pure or full."""
    tests: list[Test] = []
    on = np.ones(len(bad), bool)
    while len(tests) < MAX_TESTS and bad[on].any() and not bad[on].all():
        p, n = bad[on].sum(), on.sum()
        best, gain = None, 1e-9
        for f in FEATURES:
            v = x[f][on]
            order = np.argsort(v, kind="stable")
            s, b = v[order], np.cumsum(bad[on][order])
            ends = np.flatnonzero(np.append(s[1:] > s[:-1], False))  # a cut lies between two values
            if not len(ends):
                continue
            mid = (s[ends] + s[ends + 1]) / 2
            for above, pos, tot in ((False, b[ends], ends + 1), (True, p - b[ends], n - ends - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / tot) - np.log2(p / n)), 0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Test(f, above, float(mid[k])), g[k]
        if best is None:
            break
        tests.append(best)
        on &= best.holds(x)
    return tests


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 0) -> list[Rule]:
    """Sequential covering of the rows to reject: a rule is grown on two thirds of the rows not yet covered, pruned on
    the rest from its last test backwards to the best (p - n) / (p + n), and kept if it is precise there. Rows it covers go; the first
    imprecise rule ends the list, so what no rule is sure of stays. No labelled rows, or one class: an empty list.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    for _ in range(MAX_RULES):
        if bad[left].sum() < SUPPORT:
            break
        part = rng.random(len(bad)) < 2 / 3
        grow, prune = left & part, left & ~part
        tests = _grow({f: v[grow] for f, v in x.items()}, bad[grow])
        if not tests:
            break

        def score(k: int) -> tuple[float, int]:
            on = Rule(tuple(tests[:k]), 0, 0).holds(x) & prune
            p, n = bad[on].sum(), (~bad[on]).sum()
            return ((p - n) / (p + n) if p + n else -1.0, -k)

        k = max(range(1, len(tests) + 1), key=score)
        rule = Rule(tuple(tests[:k]), 0, 0)
        on, held = rule.holds(x) & left, rule.holds(x) & prune
        right = bad[held].mean() if held.any() else 0.0
        if bad[on].sum() < SUPPORT or right < PRECISION or bad[on].mean() < PRECISION:
            break
        rules.append(Rule(rule.tests, float(bad[on].mean()), int(on.sum())))
        left &= ~rule.holds(x)
    return rules


def decision(rules: list[Rule]) -> Column:
    """The ordered conditional: number of the first rule that rejects, null where none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(), F.lit(0))
    for k, r in enumerate(rules[1:], 1):
        out = out.when(r.column(), F.lit(k))
    return out


def fit(counts: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from counts (id, COUNTS) and labels (doc_id, quality); at most `rows` labelled rows reach the driver.

    Labels that are null or lack a document are left out; of several labels for an id the lowest holds.
    """
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("_quality"))
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(rows)
    got = counts.join(F.broadcast(chosen), "id").select("id", "_quality", *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    got = got.groupBy("id").agg(*[F.min(c).alias(c) for c in ["_quality", *FEATURES]]).orderBy("id").toPandas()
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, got["_quality"].to_numpy() == 0)


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """(id, COUNTS, base_failed, rule, kept) for every row of docs, and the rules.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. Null, empty and blank texts have no words, so
    they fail. Repeated rows are judged alike.
    """
    counts = saved(with_counts(docs), "counts")
    rules = fit(counts, labels)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counts.withColumn("base_failed", base).withColumn("rule", decision(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the rules and the base keep, with all columns. Each row is judged by its own text, where it is: no shuffle.

    Only the labelled sample is counted twice, once to fit on it.
    """
    marks = labels.where("quality is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "doc_id")
    rules = fit(with_counts(some), labels, rows)

    @F.pandas_udf("array<bigint>")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([np.array(text_counts(t), np.int64) for t in p], dtype=object)

    counted = docs.select(F.struct(*docs.columns).alias("_doc"), count(F.col(text_col)).alias("_c"))
    counted = counted.select("_doc", *[F.get("_c", F.lit(k)).alias(c) for k, c in enumerate(COUNTS)])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.where(~base & decision(rules).isNull()).select("_doc.*")


def op8_quality_rules(spark, sf_dir) -> DataFrame:
    out, _ = judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return out.select(F.col("id").alias("doc_id"), *cols)
