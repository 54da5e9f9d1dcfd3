"""Labels, presence flags and notes joined to rows; none of these drops or multiplies a row of the left side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_lookup(df: DataFrame, keys: list[str], values: list[str], order: str | None = None) -> DataFrame:
    """One row a key: of several the last by `order`, or the greatest values where no order is given."""
    by = F.struct(order, *values) if order else F.struct(*values)
    return df.groupBy(*keys).agg(F.max(by).alias("_v")).select(*keys, *[F.col(f"_v.{v}") for v in values])


def lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str], values: list[str], order: str | None = None) -> DataFrame:
    return df.join(unique_lookup(lookup, keys, values, order), keys, "left")


def code_names(code: Column, names: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def missing_ids(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other, key, "left_anti")


def paired_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def exists_flag(df: DataFrame, other: DataFrame, key: str, name: str, also: Column | None = None) -> DataFrame:
    """Adds whether the key occurs in other (and also holds)."""
    seen = other.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    flag = F.coalesce("_seen", F.lit(False))
    return df.join(seen, key, "left").withColumn(name, flag & also if also is not None else flag).drop("_seen")


def classify(text: Column, phrases: dict[str, str], strict: bool = False) -> Column:
    """The code of the one phrase that the lower-cased text contains; several or none: null, or an error where strict."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(p)), F.lit(code)) for p, code in phrases.items()]))
    fault = F.raise_error(F.concat(F.lit("not exactly one phrase: "), text)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(fault)


def note_columns(df: DataFrame, keys: list[str], by: str, names: dict[str, str], values: list[str], form: str) -> DataFrame:
    """A row a key with one note column for each named value of `by`: its rows' values in the given form, sorted, joined by semicolons; null without rows.

    One aggregation gives all columns, so a table takes them by one join instead of one a column. Notes are meant for a few rows a key.
    """
    rows = df.where(F.col(by).isin(*names))
    said = F.struct(*values, F.format_string(form, *map(F.col, values)).alias("_said"))
    lists = [F.array_sort(F.collect_list(F.when(F.col(by) == k, said))).alias(name) for k, name in names.items()]
    joined = [F.nullif(F.array_join(F.transform(name, lambda x: x["_said"]), ";"), F.lit("")).alias(name) for name in names.values()]
    return rows.groupBy(*keys).agg(*lists).select(*keys, *joined)
