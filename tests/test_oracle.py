"""Every registered survey query against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from surveyqc.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(found, columns):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r)), columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(([r[c] for c in columns] for r in df.collect()), columns)
    if name not in SQL:
        assert got[0]
        return
    duck.execute(f"CREATE VIEW sql_of_{name} AS {SQL[name]}")
    found = duck.execute(f"SELECT * FROM sql_of_{name}")
    names = [d[0] for d in found.description]
    assert got == rows(([r[names.index(c)] for c in sorted(names)] for r in found.fetchall()), sorted(names))


def test_admin_join_is_its_sql_where_keys_repeat(spark, tmp_path):
    """Orders dealt to fewer keys, some of them null: every row of a key meets all results of it."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    con.execute(f"CREATE TABLE orders AS SELECT * REPLACE (CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 500 END AS o_orderkey) FROM '{SF}/orders.parquet'")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    df = QUERIES["outlier_admin_join"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['outlier_admin_join']})").fetchall()
    assert rows(df.collect(), df.columns) == rows(want, df.columns)
