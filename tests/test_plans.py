"""Every registered plan against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from crawlweft.plans import BASE
from crawlweft.plans.oracles import DUCK

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return f"{v:.9g}" if not math.isnan(v) else "nan"
    return "None" if v is None else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(cell(r[k]) for k in order) for r in data)


#: All plans take minutes; without ALL_PLANS every ninth is compared, and those whose statements are written on their own.
SHOWN = ("K10_shown_sitemaps", "K10_shown_pagespeed_result", "K10_shown_hreflang_rows")  # the other displays are plain selections
OWN = [k for k in DUCK if k in entry.OPERATORS and (k in SHOWN or not k.startswith("K10_"))]
CHOSEN = sorted(entry.base_oracle()) if os.environ.get("ALL_PLANS") else sorted({*sorted(entry.base_oracle())[::9], *OWN, "G13_by_status", "G24_folder_stats"})


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.base_oracle()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_plan_finds_something(duck):
    """No plan is equal on both sides for want of rows; content groups and the like need the larger tables."""
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    assert [name for name, sql in entry.base_oracle().items() if c.execute(f"SELECT count(*) FROM (SELECT 1 FROM ({sql}) q LIMIT 1) p").fetchone()[0] == 0] == []
