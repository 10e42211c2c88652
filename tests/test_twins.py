"""Every relational query gives what DuckDB gives on the same tables."""

import os

import pytest
from conftest import SMALL

import verify
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return verify.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, duck, name):
    ok, note, _ = verify.compare(spark, duck, name, catalog.QUERIES[name], catalog.SQL[name], SMALL)
    assert ok, note
    assert "TYPES" not in note, note


def test_every_name_with_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
