"""The entry points with and without the corpus operators."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("gone", ["xxhash", "brindle.llm", "corpus_pipeline"])
def test_other_queries_stay_without(gone):
    """A package that only the corpus operators need, or these themselves, may be absent: all other queries are there."""
    code = f"""
import sys
sys.modules[{gone!r}] = None
import __spark_entry__ as e
from brindle.plans import catalog
assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLE_SQL) <= set(e.oracle_sql())
assert set(e.oracle_sql()) <= set(e.queries()) and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=entry.HERE)


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
