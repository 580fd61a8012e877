"""Fixed numeric cases for the array and the long form."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_random_signals import OF
from tidegauge.config import WaveformConfig
from tidegauge.errors import ConfigurationError
from tidegauge.functions import arrays as A
from tidegauge.functions.scalar import clamp01, display_resolution
from tidegauge.operators import bins as B


def one(spark, values, of):
    df = spark.createDataFrame([(values,)], "a array<double>")
    return df.select(of(F.col("a")).alias("x")).first()["x"]


def each(spark, signals, of):
    """Signals with what ``of`` gives for them, in one job."""
    df = spark.createDataFrame(list(enumerate(signals)), "k int, a array<double>")
    got = {r.k: r.x for r in df.select("k", of(F.col("a")).alias("x")).collect()}
    return [(a, got[k]) for k, a in enumerate(signals)]


def drawn(seed, n, low=-1.0, high=1.0):
    r = random.Random(seed)
    return [r.uniform(low, high) for _ in range(n)]


SIGNALS = [[], [0.0], [-0.0, 0.0], [3.25], [-7.5], *[drawn(n, n) for n in (2, 3, 4, 5, 8, 13, 40)], [x if k % 3 else 0.0 for k, x in enumerate(drawn(99, 30))]]


def mean(x):
    return sum(x) / len(x)


@pytest.mark.parametrize("name", OF)
def test_aggregates(spark, name):
    """Every aggregate of every signal; NaN is no peak."""
    for a, got in each(spark, SIGNALS, A.OF[name]):
        assert got == pytest.approx(OF[name](a)), a
    if name == "peak":
        assert one(spark, [0.125, float("nan"), -2.0], A.peak) == 2.0


def walked(tops, apart):
    out = []
    for t in tops:
        if not out or t - out[-1] >= apart:
            out.append(t)
    return out


@pytest.mark.parametrize("apart", [1, 2, 3, 7])
@pytest.mark.parametrize("least", [-0.4, 0.1, 0.6])
def test_peaks(spark, apart, least):
    for a, got in each(spark, [*SIGNALS, drawn(5, 200)], lambda c: A.peaks(c, least, apart)):
        tops = [k for k in range(1, len(a) - 1) if a[k] > least and a[k - 1] < a[k] > a[k + 1]]
        assert got == walked(tops, apart), a


@pytest.mark.parametrize("window", [1, 2, 3, 4, 5, 9])
def test_smoothing(spark, window):
    h = window // 2 if window > 2 and window % 2 else 0
    for w in (window, F.lit(window)):
        for a, got in each(spark, SIGNALS, lambda c, w=w: A.smooth(c, w)):
            assert got == pytest.approx([mean(a[max(0, k - h) : k + h + 1]) for k in range(len(a))])


def test_normalizing(spark):
    for method, of in (("peak", lambda a: max(a, default=0)), ("rms", OF["rms"])):
        for a, got in each(spark, SIGNALS, lambda c, m=method: A.normalize(c, m)):
            assert got == pytest.approx([x / of(a) if of(a) else 0.0 for x in a])


@pytest.mark.parametrize("name,of", [("linear", lambda x: x), ("logarithmic", lambda x: math.log10(1 + 9 * x) if x > 0 else 0.0), ("exponential", lambda x: x * x), ("sqrt", math.sqrt)])
@pytest.mark.parametrize("factor", [1.0, 0.3, 4.0])
def test_curves(spark, name, of, factor):
    a = [0.0, 1.0, 1.5, *drawn(3, 20, 0, 1)]
    assert one(spark, a, lambda c: A.scale(c, name, factor)) == pytest.approx([min(1.0, of(x) * factor) for x in a])


@pytest.mark.parametrize("channels", [1, 2, 3, 5])
def test_channels(spark, channels):
    for n in (channels, F.lit(channels)):
        for a, got in each(spark, SIGNALS, lambda c, n=n: A.mixdown(c, n)):
            assert got == pytest.approx([mean(a[f * channels : f * channels + channels]) for f in range(len(a) // channels)])


@pytest.mark.parametrize("count", [0, 1, 2, 5, 8, 30])
def test_fewer_and_more_places(spark, count):
    for a, got in each(spark, SIGNALS, lambda c: A.resample(c, count)):
        n = len(a)
        if not n or not count:
            want = []
        elif n > count:
            want = [max(a[math.floor(k * (n / count)) : min(n, math.ceil((k + 1) * (n / count)))]) for k in range(count)]
        else:
            at = [k * (n - 1) / max(1, count - 1) for k in range(count)] if n < count else list(range(n))
            want = [a[int(x)] + (a[min(int(x) + 1, n - 1)] - a[int(x)]) * (x - int(x)) for x in at]
        assert got == pytest.approx(want), (n, count)
        if 1 < n < count:
            assert (got[0], got[-1]) == (pytest.approx(a[0]), pytest.approx(a[-1]))


def test_short_signals_pass_through(spark):
    assert all(a == got for a, got in each(spark, SIGNALS, lambda c: A.downsample(c, 40)))


def edges(frames, r):
    """Bins by their edges in double arithmetic."""
    s, out = frames / r, {}
    for i in range(r):
        for f in range(math.floor(i * s), min(math.floor((i + 1) * s), frames)):
            out[f] = i
    return out


@pytest.mark.parametrize("frames,r", [(54, 49), (119, 49), (55, 49), (64, 49), (1000, 100), (101, 100), (7, 3)])
def test_bins_follow_the_edges(spark, frames, r):
    framed = spark.range(frames).selectExpr("'a' as track", "id as frame", f"{frames}L as frames", "double(id + 1) as v")
    got = {x.bin: x.amp for x in B.downsample(framed, r, "peak").collect()}
    want = {}
    for f, i in edges(frames, r).items():
        want[i] = f + 1.0
    assert got == want
    array = one(spark, [float(f + 1) for f in range(frames)], lambda a: A.downsample(a, r, "peak"))
    assert {i: x for i, x in enumerate(array) if x} == want


def test_long_frames_equal_frames(spark):
    rows = spark.range(500).selectExpr("id % 3 as t", "id * 7 % 500 as o", "double(id) as v")
    one_task = B.frames(rows, "t", ["o"], "v")
    assert sorted(map(tuple, one_task.collect())) == sorted(map(tuple, B.short_frames(rows, "t", ["o"], "v").collect()))


def test_nan_and_clamp(spark):
    row = spark.sql("select double('NaN') as n, 2.0D as x, -1.0D as y").select(clamp01(F.col("n")).alias("n"), clamp01(F.col("x")).alias("x"), clamp01(F.col("y")).alias("y")).first()
    assert math.isnan(row.n) and (row.x, row.y) == (1.0, 0.0)
    nan = spark.sql("select 'a' as track, id as frame, 4L as frames, if(id = 1, double('NaN'), 0.5D) as v from range(4)")
    assert [x.amp for x in B.downsample(nan, 2, "peak").orderBy("bin").collect()] == [0.5, 0.5]
    assert math.isnan(B.downsample(nan, 2, "rms").orderBy("bin").first().amp)


def test_display_resolution(spark):
    w = spark.sql("select 300.0D as w, 0.0D as z")
    row = w.select(display_resolution(F.col("w"), "bars").alias("a"), display_resolution(F.col("w"), "bars", 6, 2).alias("b"), display_resolution(F.col("z"), "line").alias("c")).first()
    assert tuple(row) == (75, 37, 0)


def test_config():
    with pytest.raises(ConfigurationError):
        WaveformConfig(0)
    with pytest.raises(ConfigurationError):
        WaveformConfig(window=4)
    with pytest.raises(ConfigurationError):
        WaveformConfig(factor=-1)
    c = WaveformConfig.preset("peakDetection")
    assert (c.resolution, c.algorithm) == (500, "peak") and WaveformConfig.from_json(c.to_json()) == c
    assert not WaveformConfig().scales and WaveformConfig.from_json("{}") == WaveformConfig()
    with pytest.raises(ConfigurationError):
        B.explode_frames(None, "t", "s", 0)
