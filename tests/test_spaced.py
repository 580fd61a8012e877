"""Points at a distance, configurations, sample tables and running memory: against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import bins as B
from tidegauge.operators import samples as ST
from tidegauge.operators.spaced import spaced


def walked(points, apart):
    out, last = [], None
    for p in sorted(set(points)):
        if last is None or p - last >= apart:
            out.append(p)
            last = p
    return out


@pytest.mark.parametrize("apart", [0, 1, 3, 10, 64, 500])
def test_spaced_points_over_many_pieces(spark, apart):
    r = random.Random(apart)
    tracks = {"a": [r.randrange(5000) for _ in range(1500)], "b": list(range(0, 3000, 7)), None: [5, 5, 6, 4000], "c": [-100, -3, 0, 2], "d": list(range(1000)), "e": [9]}
    rows = [(t, p) for t, ps in tracks.items() for p in ps] + [("a", None), ("f", None)]
    points = spark.createDataFrame(r.sample(rows, len(rows)), "track string, at long").repartition(5)
    for width in (64, 1000, 1 << 20):
        got = {}
        for t, p in spaced(points, apart, width).collect():
            got.setdefault(t, []).append(p)
        assert {t: sorted(ps) for t, ps in got.items()} == {t: walked(ps, apart) for t, ps in tracks.items()}, (apart, width)


def test_spaced_points_of_nothing_and_of_one_long_track(spark):
    assert spaced(spark.createDataFrame([], "track int, at long"), 5).collect() == []
    n = 300_000
    at = np.cumsum(np.random.default_rng(1).integers(1, 9, n))
    points = spark.range(n).select(F.lit(1).alias("track"), "id").join(spark.createDataFrame(list(zip(range(n), at.tolist())), "id long, at long"), "id").drop("id")
    assert sorted(r.at for r in spaced(points, 20, 10_000).collect()) == walked(at.tolist(), 20)


def test_spaced_peaks(spark):
    r = random.Random(2)
    x = [r.random() for _ in range(2000)]
    bins = spark.createDataFrame([("t", k, v) for k, v in enumerate(x)], "track string, bin long, amp double")
    tops = [k for k in range(1, 1999) if x[k] > 0.3 and x[k] > x[k - 1] and x[k] > x[k + 1]]
    for apart in (1, 2, 5, 40):
        assert sorted(q.bin for q in B.spaced_peaks(bins, 0.3, apart, 128).collect()) == walked(tops, apart)


@pytest.mark.parametrize("piece_rows", [1000, 9])
def test_sample_tables(spark, piece_rows):
    r = random.Random(3)
    rows = [(t, k, k * 10, k % 5 + 1, r.randrange(200), r.random() < 0.3) for t in ("a", "b", None) for k in range(60)]
    asks = [(t, q, r.randrange(-20, 220)) for q, t in enumerate(["a", "b", "a", None, "b", "zz"] * 4)]
    samples = spark.createDataFrame(rows, "track string, seq long, offset long, size long, ts_us long, is_key boolean")
    want_us, want = {}, {}
    for t in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == t), key=lambda x: (x[4], x[1]))
        for x, y in zip(own, [*own[1:], None]):
            want_us[t, x[1]] = (x[2] + x[3], None if y is None else y[4] - x[4])
    for t, q, ts in asks:
        held = sorted((x for x in rows if x[0] == t and x[4] <= ts), key=lambda x: (x[4], x[1]))
        keys = [x[1] for x in held if x[5]]
        want[q] = (held[-1][1] if held else None, keys[-1] if keys else None)
    assert {(x.track, x.seq): (x.end_offset, x.us) for x in ST.durations(samples, piece_rows).collect()} == want_us
    got = ST.seek(samples, spark.createDataFrame(asks, "track string, q int, ts_us long"), piece_rows)
    assert {x.q: (x.seq, x.key) for x in got.collect()} == want
