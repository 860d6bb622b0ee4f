"""Every query of the catalogue against its SQL."""

import os
import subprocess
import sys

import pytest

from platen.plans import queries, sql


@pytest.mark.parametrize("name", sorted(sql.QUERIES))
def test_query_equals_sql(name, same):
    same(queries.queries()[name], sql.QUERIES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200


def test_queries_are_listed_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, check=True, timeout=120)


def test_flow_covers_all_characters(spark):
    out = queries.queries()["l4_flow"](spark, "/root/testdata/sf0.001").filter("object_type = 'textlinehorizontal'")
    assert out.count() == 200


@pytest.mark.parametrize("name", ["a1_cluster", "a4_snap", "a5_join_edges"])
def test_ties_at_the_next_scale(name, same):
    """Ties decide more there."""
    same(queries.queries()[name], sql.QUERIES[name], "/root/testdata/sf0.01")
