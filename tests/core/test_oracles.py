"""Every registered query with SQL gives DuckDB's rows; the others give rows and keep their columns."""

import duckdb
import pytest

from versewright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return bool(value)
    if isinstance(value, float):
        return int(value) if value.is_integer() else float(f"{value:.9g}")
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, found) == rows(want.columns, want.fetchall())


def test_names_match():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_smoke(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["issue", "n"] and out.count() >= 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
