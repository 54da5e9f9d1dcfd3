"""Main text of web pages by the recurrent block labeller."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import lstm
from brindle.llm.blocks import leaves, vectors

#: Pages labelled together, and blocks from which on fewer are; bounds a worker's memory, but for a single page.
TOGETHER, BLOCKS = 512, 20_000


def main_texts(model: lstm.Model, pages: list[str | None]) -> list[str]:
    out: list[str] = []
    found: list[list] = []

    def work() -> None:
        marks = lstm.label(model, [vectors(f) for f in found])
        out.extend("\n".join(leaf.text for leaf, on in zip(f, m) if on) for f, m in zip(found, marks))
        found.clear()

    blocks = 0
    for p in pages:
        found.append(leaves(p))
        blocks += len(found[-1])
        if len(found) == TOGETHER or blocks >= BLOCKS:
            work()
            blocks = 0
    if found:
        work()
    return out


def main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text", model: lstm.Model | None = None) -> DataFrame:
    """Adds the main text: blocks that the labeller takes for the article, in page order, one a line.

    Null and empty pages and pages without such a block: an empty string. Character references are decoded, white space within a block is
    one space. A column named out_col is replaced; all others stay, as do repeated rows.
    """
    model = model or lstm.labeller()
    keep = [c for c in pages.columns if c not in (html_col, out_col)]

    @F.pandas_udf("string")
    def get(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(main_texts(model, p.tolist()), dtype=object)

    return pages.select(*keep, get(F.col(html_col)).alias(out_col))


def op10_html_extraction(spark, sf_dir) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
