"""Every query of the catalogue against its oracle SQL, or for its rows alone."""

from __future__ import annotations

import pytest
from compare import bag

from quillmere.plans import catalog

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    result = duck.sql(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    kinds = dict(found.dtypes)
    assert {c: TYPES.get(kinds[c], kinds[c]) for c in columns} == {c: str(t) for c, t in zip(columns, result.types, strict=True)}
    assert bag(found.columns, found.collect()) == bag(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_oracle_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_every_query_names_operators():
    assert set(catalog.OPERATORS) == set(catalog.QUERIES)
    assert all(catalog.OPERATORS.values())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
