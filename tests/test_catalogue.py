"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from millrace.plans import administered, catalogue, further, more  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal | float):
        return round(float(v), 4)
    return str(v) if isinstance(v, datetime.datetime) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalogue.SQL:
        want = duck.execute(catalogue.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(names)
        assert table(df.columns, got) == table(names, want.fetchall())
    assert got
