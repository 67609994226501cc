"""Every query with SQL gives the rows of DuckDB on the same tables (a spread of them here; all in the driver's check)."""

import glob
import os

import duckdb
import pytest

import dutymark.queries  # noqa: F401
from dutymark.registry import ORACLE_SQL, QUERIES

NAMES = sorted(ORACLE_SQL)


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return [plain(x) for x in v] if isinstance(v, list) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    got = QUERIES[name](spark, sf_dir).toArrow()
    assert sorted(got.column_names) == sorted(columns)
    table = [got.column(c).to_pylist() for c in columns]
    assert sorted(repr([plain(v) for v in r]) for r in zip(*table, strict=True)) == sorted(repr([plain(v) for v in r]) for r in rows)
