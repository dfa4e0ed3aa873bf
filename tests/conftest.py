"""One small local session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from barcraft.session import build_session, share_package

    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    share_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def plain(value):
    """A value as comparable text, the same from either engine."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "None"
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def rows_of_sql(con, sql):
    found = con.sql(sql)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    return sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
