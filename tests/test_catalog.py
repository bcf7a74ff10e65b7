"""Registered queries against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from pagetide.plans import catalog

DIR = "/root/testdata/sf0.001"
SAMPLE = ["ses_1_web_sessions", "ses_3_app_sessions", "rol_12_product_attrs", "rol_15_app_screens", "vw_19_identity_daily", "vw_20_retention", "coh_1_actors_merged", "rd_2_web_overview", "rd_9_identities_user", "dsh_retention_retention_milestones", "ing_4_12_15_events", "url_1_2_3_shape_urls", "lif_3_aged_out_days"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{file}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(catalog.SQL[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    theirs = sorted((tuple(plain(row[order.index(c)]) for c in columns) for row in cursor.fetchall()), key=repr)
    assert mine == theirs and mine


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0
