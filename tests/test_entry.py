"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from granary.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def same_rows(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = want.fetchall()
    at = [want.columns.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in at) for r in rows)
    found = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert found == expected


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, data, name):
    same_rows(QUERIES[name](spark, data), ORACLE[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_has_rows(spark, data):
    assert 0 < __spark_entry__.entry(spark).count() <= 5


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
