"""Every query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(columns), sorted(([plain(r[k]) for k in order] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_against_sql(spark, data, duck, name):
    df = __spark_entry__.queries()[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
