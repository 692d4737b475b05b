"""Every core query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from glossmill import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in os.listdir(sf):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return connection


def _rows(rows):
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted(repr(sorted((k, plain(v)) for k, v in row.items())) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = [r.asDict(True) for r in QUERIES[name](spark, sf).collect()]
    if name in SQL:
        result = duck.execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert _rows(got) == _rows([dict(zip(columns, r, strict=True)) for r in result.fetchall()])
    else:
        assert got


def test_nothing_in_the_core_imports_the_training_data_package():
    from pathlib import Path

    root = Path(registry.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "glossmill.llm" not in path.read_text(), path
