"""Queries against the SQL that goes with them, in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

from tidegauge import queries

SF = "/root/testdata/sf0.001"


def normal(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    tidy = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in at) for r in rows), key=repr), sorted(cols)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in ("customer", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["wf_rms_events", "wf_rms_events_long", "down_odd_resolution", "down_lines_median", "down_zero_fill", "peaks_min_distance", "pipeline_music", "disp_down_rms", "disp_up_linear", "geom_line", "chunk_reassemble", "op_report", "sample_table_seek", "stream_bins", "wav_decode", "wav_header", "signatures", "header_fields", "byte_checksum", "wf_array_smooth", "memory_curve", "position_changes", "op_bottlenecks", "container_map", "samples_concatenate", "file_listing"])
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    c = duck.execute(queries.ORACLES[name])
    assert got == normal(c.fetchall(), [x[0] for x in c.description])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_short_tracks_pass_through(spark):
    """Short tracks are only in the larger tables."""
    con, d = duckdb.connect(), "/root/testdata/sf0.1"
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from '{d}/events.parquet'")
    short = con.execute("select count(*) from (select user_id from events group by 1 having count(*) <= 49)").fetchone()[0]
    df = queries.QUERIES["down_odd_resolution_all"](spark, d)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    c = con.execute(queries.ORACLES["down_odd_resolution_all"])
    assert short > 0 and got == normal(c.fetchall(), [x[0] for x in c.description])


def test_entry_imports_without_optional_folder():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
