"""Queries that SQL can express, over whole tables, against their SQL."""

import os

import duckdb
import pytest

from tidegauge.llm import queries

SF = "/root/testdata/sf0.01"


def by_value(rows):
    return sorted(rows, key=lambda r: tuple((x is None, "" if x is None else x) for x in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    asked = con.execute(queries.ORACLES[name])
    names = [x[0] for x in asked.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert by_value(asked.fetchall()) == by_value(tuple(r) for r in df.select(*names).collect())
