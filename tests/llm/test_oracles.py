"""Queries that SQL can express, against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from compare import frames, same  # noqa: E402

from loomspan.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    got, want = frames(spark, "/root/testdata/sf0.001", name, queries.QUERIES[name], queries.ORACLES[name])
    assert same(got, want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
