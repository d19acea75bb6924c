"""The driver's contract: queries, SQL, and the same rows from both."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 7)
    return x


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, sf)
    columns = sorted(df.columns)
    theirs = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    got = Counter(tuple(map(value, r)) for r in df.select(*columns).collect())
    assert got == Counter(tuple(map(value, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql()) - {n for n in __spark_entry__.queries() if n.startswith(("op", "pipeline"))}))
def test_other_queries_run(spark, sf, name):
    assert __spark_entry__.queries()[name](spark, sf).count() >= 0
