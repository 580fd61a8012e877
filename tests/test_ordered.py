"""Order in pieces against plain Python."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import bins as B
from tidegauge.operators import stats
from tidegauge.operators.ordered import Ordered

TYPES = ["long", "double", "string", "date", "timestamp", "timestamp_ntz"]


def rows_of(seed=1, n=400):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", "c", None]), None if r.random() < 0.02 else r.choice([5, 7, r.randint(0, 9999)]), k, r.choice([None, r.randint(0, 9)])) for k in range(n)]
    return [*rows, ("single", 3, n, 1)]


@pytest.mark.parametrize("kind", TYPES)
@pytest.mark.parametrize("piece_rows", [1000, 11])
def test_numbers_and_neighbours(spark, kind, piece_rows):
    rows = rows_of()
    df = spark.createDataFrame(rows, "track string, at long, tie int, v int").repartition(3)
    if kind == "date":
        df = df.withColumn("at", F.date_add(F.lit("1970-01-01"), F.col("at").cast("int")))
    elif kind.startswith("timestamp"):
        df = df.withColumn("at", F.timestamp_seconds("at").cast(kind))
    elif kind == "double":
        df = df.withColumn("at", F.when(F.col("at") == 7, float("nan")).otherwise(F.col("at") / 3))
    elif kind == "string":
        df = df.withColumn("at", F.when(F.col("at").isNotNull(), F.format_string("%05d", "at")))
    key = lambda r: (r[1] is not None, r[1] == 7 and kind == "double", r[1] or 0, r[2])
    want = {}
    for track, held in groupby(sorted(rows, key=lambda r: (repr(r[0]), *key(r))), key=lambda r: r[0]):
        held, last = list(held), None
        for k, r in enumerate(held):
            last = r[3] if r[3] is not None else last
            want[r[2]] = (track, k, len(held), held[k - 1][2] if k else None, held[k + 1][2] if k + 1 < len(held) else None, last)
    o = Ordered(df, "track", ["at", "tie"], piece_rows)
    numbered = {r.tie: (r.track, r.frame, r.frames) for r in o.numbered().collect()}
    back, ahead = ({r.tie: r.x for r in o.neighbour("tie", "x", ahead=a).collect()} for a in (False, True))
    latest = {r.tie: r.x for r in o.latest(x=F.col("v")).collect()}
    assert {k: (*numbered[k], back[k], ahead[k], latest[k]) for k in numbered} == want


#: Times of one track: a plain one, outliers at both ends, half of all rows in one moment, one time for all.
TIMES = {
    "plain": "id * 7919 % 1000003",
    "outliers": "case id when 7 then -1000000000000000 when 8 then 1000000000000000 else id * 7919 % 1000003 end",
    "burst": "if(id % 2 = 0, 500, id * 7919 % 1000003)",
    "constant": "3",
    "texts": "format_string('%09d', id * 7919 % 1000003)",
}


@pytest.mark.parametrize("kind", TIMES)
def test_pieces_have_about_equal_rows(spark, kind):
    """One long track beside many short ones."""
    n, each = 300_000, 10_000
    rows = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.format_string("t%d", F.col("id") % 400)).otherwise("long").alias("track"), F.expr(TIMES[kind]).alias("at"), F.col("id").cast("double").alias("v"))
    o = Ordered(rows, "track", ["at", "v"], each)
    sizes = [r.n for r in o.rows.groupBy("_piece").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and len(sizes) >= 25 and max(sizes) <= 2 * n / len(sizes)
    assert o.longest == 270_000 and not o.whole
    framed, one = B.frames(rows, "track", ["at", "v"], "v", each), B.short_frames(rows, "track", ["at", "v"], "v")
    assert framed.exceptAll(one).count() == 0 and framed.count() == n


def test_rows_of_one_time_are_cut_by_what_else_they_hold(spark):
    rows = spark.range(100_000).select(F.lit("t").alias("track"), F.lit(1).alias("at"), F.col("id").alias("v"))
    o = Ordered(rows, "track", ["at"], 5_000)
    assert o.rows.groupBy("_piece").count().agg(F.max("count")).first()[0] <= 10_000
    assert o.numbered().select(F.count_distinct("frame"), F.max("frame")).first()[:] == (100_000, 99_999)
    values = {r.v: r.x for r in o.neighbour("v", "x").collect()}
    assert len(set(values.values())) == 100_000  # each row is behind another one, and one behind none


def test_written_pieces_go(spark):
    """What was written is marked to be deleted with the session."""
    from tidegauge.operators.ordered import shared_folder

    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {f.getPath().getName() for f in files.listStatus(folder)}
    before = names()
    Ordered(spark.range(100).select(F.lit("t").alias("track"), "id"), "track", ["id"], 10)
    (new,) = names() - before
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{new}")
    assert files.cancelDeleteOnExit(place) and files.delete(place, True)


MEDIANS = [[], [1.0], [2.0, 1.0], [float("nan"), 1.0, 2.0], [float("inf"), -1.0, float("inf")], [None, None], [None, 4.0, 6.0]]


@pytest.mark.parametrize("piece_rows", [10_000, 9])
def test_exact_median(spark, piece_rows):
    r = random.Random(3)
    groups = [*MEDIANS, [0.0] * 500, [r.choice([0.0, r.gauss(0, 1)]) for _ in range(501)], [r.gauss(0, 9) for _ in range(400)]]
    rows = [(k % 3 if k else None, f"g{k}", x) for k, xs in enumerate(groups) for x in xs]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "a int, b string, x double").repartition(5)
    got = {(q.a, q.b): q.median for q in B.exact_median(df, ["a", "b"], "x", piece_rows=piece_rows).collect()}
    want = {(q.a, q.b): q.m for q in df.groupBy("a", "b").agg(F.median("x").alias("m")).collect()}
    assert repr(sorted(got.items(), key=repr)) == repr(sorted(want.items(), key=repr))


@pytest.mark.parametrize("short", ["passthrough", "zero_fill"])
def test_medians_of_wide_bins(spark, short):
    r = random.Random(4)
    rows = spark.createDataFrame([(t, k, r.choice([None, 0.0, r.gauss(0, 3)])) for t, n in (("a", 700), ("b", 20), ("c", 41)) for k in range(n)], "track string, at int, v double")
    framed = B.frames(rows, "track", ["at"], "v")
    few = B.downsample(framed, 30, "median", short, piece_rows=5).collect()
    assert sorted(map(tuple, few), key=repr) == sorted(map(tuple, B.downsample(framed, 30, "median", short).collect()), key=repr)


def test_nothing_and_one_value(spark):
    none = spark.createDataFrame([], "track string, at long, v double")
    assert B.frames(none, "track", ["at"], "v").count() == 0
    same = spark.range(100).select(F.lit("t").alias("track"), F.lit(5).alias("at"), "id", F.lit(1.0).alias("v"))
    assert sorted(r.frame for r in B.frames(same, "track", ["at", "id"], "v").collect()) == list(range(100))


@pytest.mark.parametrize("piece_rows", [1000, 13])
def test_memory_curve_in_pieces(spark, piece_rows):
    r = random.Random(2)
    rows = [(t, k, r.randint(-50, 50)) for t in ("a", "b") for k in range(300)]
    want = {}
    for t in ("a", "b"):
        used = 0
        for x, k, c in rows:
            if x == t:
                used = max(0, used + c)
                want[t, k] = used
    got = stats.memory_curve(spark.createDataFrame(rows, "track string, seq int, change long"), 100, piece_rows)
    assert {(x.track, x.seq): x.used for x in got.collect()} == want
