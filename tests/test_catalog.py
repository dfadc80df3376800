"""Every registered query next to its SQL, with the settings of production."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.oracle import oracles
from catalog.queries import QUERIES, Workspace
from catalog.settings import Settings
from compare import connect, differences

SETTINGS = Settings()
TABLES_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def workspace(spark):
    return Workspace(spark, TABLES_DIR, SETTINGS)


@pytest.fixture(scope="module")
def db():
    return connect(TABLES_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries()) and set(oracles()) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(workspace, db, name):
    assert differences(QUERIES[name](workspace), db, oracles(SETTINGS)[name]) is None


def test_entry_is_lazy_and_typed(spark):
    assert dict(entry(spark).dtypes) == {
        "topic": "string", "a": "bigint", "b": "bigint", "support": "bigint"}
