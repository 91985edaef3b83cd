"""The registered queries against DuckDB at the smallest scale.

A few run here; ``python tests/compare.py SF`` runs all of them at any scale.
"""

import compare
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name",
    ["merge_mates", "normalize_split", "kmer_tokens", "overlap_edges", "connected_components", "vector_dense"],
)
def test_query_equals_sql(spark, name):
    assert compare.check(spark, compare.connect(SF_DIR), name, SF_DIR).startswith("equal")
