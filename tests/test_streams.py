"""Streams: chunks of files and running memory, over several batches and restarts."""

import random

import numpy as np

from tidegauge.operators import stats
from tidegauge.sources import flac, wav
from tidegauge.streaming import incremental


def chunk_rows(df):
    return sorted((r.path.rsplit("/", 1)[1], r.idx, r.is_last, r.first, r.frames, tuple(r.samples or ()), r.error) for r in df.collect())


def test_chunks_as_a_stream_that_goes_on(spark, tmp_path):
    r = np.random.default_rng(1)
    folder, base = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()

    def add(names):
        for n in names:
            x = r.integers(-999, 999, 700)
            (folder / f"{n}.wav").write_bytes(wav.encode(x / 32767, 8000, 2))
            (folder / f"{n}.flac").write_bytes(flac.encode(x, 8000, 2, block=64))

    batches = lambda: len([p for p in (tmp_path / "state" / "out").iterdir() if p.is_dir()])
    stream = lambda: wav.stream_chunks(spark, str(folder), 100, files=2)
    add("abc")
    (folder / "bad.wav").write_bytes(b"RIFF" + bytes(90))
    first = incremental.settle(stream(), "append", base)
    assert batches() == 4 and chunk_rows(first) == chunk_rows(wav.read_chunks(spark, str(folder), 100, "*.{wav,flac}"))
    assert chunk_rows(incremental.settle(stream(), "append", base)) == chunk_rows(first)  # nothing new, nothing twice
    add("de")
    again = chunk_rows(incremental.settle(stream(), "append", base))
    assert batches() >= 6 and again == chunk_rows(wav.read_chunks(spark, str(folder), 100, "*.{wav,flac}")) and len(again) > first.count()


def test_running_memory(spark, tmp_path):
    r = random.Random(4)
    folder, base = str(tmp_path / "in"), str(tmp_path / "state")
    rows, at = [], 0
    for k in range(240):
        at += r.randint(0, 4)
        rows.append((r.choice("ab"), k, at, r.randint(-60, 70)))
    make = lambda part: spark.createDataFrame(part, "track string, seq long, at long, change long").selectExpr("track", "seq", "timestamp_seconds(at) as time", "change")
    stream = lambda: incremental.memory(spark.readStream.schema(make(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(folder), 200)
    for part in (rows[:50], rows[50:51], rows[51:130]):
        make(part).coalesce(1).write.mode("append").parquet(folder)
    incremental.settle(stream(), "append", base)
    make(rows[130:]).coalesce(1).write.mode("append").parquet(folder)
    got = incremental.settle(stream(), "append", base).collect()
    want = {(x.track, x.seq): (x.used, x.level) for x in stats.memory_curve(make(rows), 200).collect()}
    changes = [x for x in got if x.kind == "change"]
    assert len(changes) == len(rows) and {(x.track, x.seq): (x.used, x.level) for x in changes} == want
    # Checks between two changes of a track, wherever memory was high: with a late timeout some end at the watermark.
    checks, due = {}, {}
    for x in got:
        if x.kind == "check":
            checks[x.track, x.seq] = checks.get((x.track, x.seq), 0) + x.checks
    for t in "ab":
        own = [x for x in rows if x[0] == t]
        for x, y in zip(own, own[1:]):
            if want[t, x[1]][1] != "normal" and (n := y[2] // 5 - x[2] // 5):
                due[t, x[1]] = n
    last = {(t, max(x[1] for x in rows if x[0] == t)) for t in "ab"}
    assert due and {k: v for k, v in checks.items() if k not in last} == due


def test_many_small_files_in_few_batches(spark, tmp_path):
    r, folder = np.random.default_rng(3), tmp_path / "in"
    folder.mkdir()
    for k in range(40):
        x = r.integers(-999, 999, 160)
        (folder / f"{k}.wav").write_bytes(wav.encode(x / 32767, 8000))
        (folder / f"{k}.flac").write_bytes(flac.encode(x, 8000))
    rows = wav.read_planned(wav.plan_chunks(spark, str(folder), 16))
    assert rows.count() > 400 and rows.rdd.getNumPartitions() == 4  # plans are small, and still read by all
    assert [wav.files_of(n) for n in (0, 150, 9_000, 90_000, 540_000)] == [64, 64, 563, 5_625, 10_000]
    listers = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listers)
    streamed = incremental.settle(wav.stream_chunks(spark, str(folder), 16, files=wav.files_of(80)), "append", str(tmp_path / "state"))
    assert chunk_rows(streamed) == chunk_rows(rows) and spark.conf.get(listers) == before


def test_memory_of_events_whose_times_do_not_follow_their_ids(spark, tmp_path):
    from tidegauge import queries

    r = random.Random(8)
    rows = [(k, f"2024-01-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:00:00", k % 3, r.randint(0, 900) / 7) for k in range(120)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "value")
    e.write.parquet(str(tmp_path / "events.parquet"))
    got, want = ({(x.track, x.seq, x.used, x.level) for x in queries.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("memory_stream", "memory_curve"))
    assert len(want) == 120 and got == want
