"""Every registered query against its SQL, run by an independent engine on the same files."""

import decimal
import math

import duckdb
import pytest

from provenant.plans import catalogue
from provenant.sources.fixtures import GIVEN, TABLES, Domain, prelude
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return round(float(value), 6) if isinstance(value, decimal.Decimal) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, engine, name):
    found = catalogue.queries()[name](spark, SF_DIR)
    got = table(found.columns, found.collect())
    if name not in catalogue.oracle_sql():
        assert got[0]
        return
    asked = engine.execute(catalogue.oracle_sql()[name])
    assert got == table([d[0] for d in asked.description], asked.fetchall())


@pytest.mark.parametrize("name", sorted(TABLES))
def test_fixture_matches_sql(spark, engine, name):
    found = Domain(spark, SF_DIR).table(name)
    asked = engine.execute(f"{prelude(name)} SELECT * FROM {name}")
    assert table(found.columns, found.collect()) == table([d[0] for d in asked.description], asked.fetchall())
