"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import decimal
import math
import os

import duckdb
import pandas as pd
import pytest

from kinweave.plans import catalog, more  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query that needs more rows than the smallest tables have: its SQL gives null there.
SPARSE = {"cost_summary", "queue_price", "overlapping_confusion"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, (int, float, decimal.Decimal)) or type(v).__module__ == "numpy":
        return repr(float(v))
    return str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SPARSE))
def test_against_sql(spark, sf, duck, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["strict_families", "pair_metrics", "multiview_candidates"])
def test_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).limit(5).count() > 0


def test_search_doesnt_depend_on_partitions(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(catalog.QUERIES["token_topk"](spark, sf).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
