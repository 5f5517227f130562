"""Every registered query of the library against its DuckDB SQL."""

import duckdb
import pytest

from stratiform import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 6) + 0.0
    return x


def rows(columns, data):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(([plain(r[i]) for i in at] for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    result = duck.execute(catalog.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in result.description], result.fetchall())


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
