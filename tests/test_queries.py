"""Every registered query on the smallest tables against its SQL."""

import math
import os
import re

import duckdb
import pytest

from whence.plans import registry

SF_DIR = os.environ.get("WHENCE_TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else repr(v)


def bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry()))
def test_query_matches_its_sql(spark, duck, name):
    q = registry()[name]
    df = q.run(spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns)
    cursor = duck.execute(q.sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(df.collect(), df.columns) == bag(cursor.fetchall(), names)


def test_every_query_has_sql_and_reads_the_tables():
    for name, q in registry().items():
        assert q.sql is not None, name
        assert re.fullmatch(r"[a-z0-9_]+", name)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["n_name", "form", "term", "coef", "delta"] and df.count() > 0
