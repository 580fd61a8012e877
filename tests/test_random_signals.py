"""Random signals in both forms against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidegauge.config import WaveformConfig
from tidegauge.functions import arrays as A
from tidegauge.operators import bins as B
from tidegauge.operators.signals import Signals, waveform_array

OF = {
    "rms": lambda x: math.sqrt(sum(v * v for v in x) / len(x)) if x else 0.0,
    "peak": lambda x: max(map(abs, x), default=0.0),
    "average": lambda x: sum(map(abs, x)) / len(x) if x else 0.0,
    "median": lambda x: statistics.median(map(abs, x)) if x else 0.0,
}


def waveform(samples, c, channels=1):
    n = len(samples) // channels
    mono = [sum(samples[f * channels : f * channels + channels]) / channels for f in range(n)]
    if n <= c.resolution:
        out = list(samples)
    else:
        s = n / c.resolution
        out = [OF[c.algorithm](mono[math.floor(i * s) : min(math.floor((i + 1) * s), n)]) for i in range(c.resolution)]
    if c.smooth and len(out) > 1:
        h = c.window // 2
        out = [sum(out[max(0, i - h) : i + h + 1]) / len(out[max(0, i - h) : i + h + 1]) for i in range(len(out))]
    if c.normalize and out:
        by = max(out) if c.normalization == "peak" else OF["rms"](out)
        out = [x / by if by else 0.0 for x in out]
    if c.scales:
        shape = {"linear": lambda x: x, "logarithmic": lambda x: math.log(1 + 9 * x) / math.log(10) if x > 0 else 0.0, "exponential": lambda x: x * x, "sqrt": lambda x: math.sqrt(x)}[c.curve]
        out = [min(1.0, max(0.0, shape(x) * c.factor)) for x in out]
    return out


CONFIGS = [
    WaveformConfig(7, algorithm="rms", smooth=True, window=3), WaveformConfig(10, algorithm="peak", normalization="rms"), WaveformConfig(49, algorithm="average", curve="logarithmic", factor=1.3),
    WaveformConfig(13, algorithm="median", curve="exponential", smooth=True, window=5), WaveformConfig(5, curve="sqrt", normalize=False, factor=0.5),
]


@pytest.fixture(scope="module")
def signals():
    r = random.Random(11)
    return [(k, [r.uniform(0, 1) if k % 2 else abs(math.sin(k * i)) for i in range(r.choice([12, 54, 119, 128, 301]))]) for k in range(40)]


@pytest.mark.parametrize("c", CONFIGS)
@pytest.mark.parametrize("channels", [1, 2])
def test_array_form(spark, signals, c, channels):
    df = spark.createDataFrame(signals, "k int, a array<double>")
    got = {r.k: r.x for r in df.select("k", waveform_array(F.col("a"), c, channels).alias("x")).collect()}
    for k, a in signals:
        assert got[k] == pytest.approx(waveform(a, c, channels), abs=1e-9)


@pytest.mark.parametrize("c", CONFIGS)
def test_long_form(spark, signals, c):
    df = spark.createDataFrame(signals, "k int, a array<double>")
    rows = B.collect(Signals.arrays(df, "k", "a").waveform(c).bins).collect()
    got = {r.track: r.amplitudes for r in rows}
    for k, a in signals:
        want = waveform(a, c)
        n = len(a)
        # A bin without frames has no row in the long form; the array form holds a 0 there.
        full = want if n <= c.resolution else [x for i, x in enumerate(want)]
        if n > c.resolution:
            assert got[k] == pytest.approx(full, abs=1e-9)


@pytest.mark.parametrize("target", [1, 3, 10, 11, 40, 100])
def test_resampling(spark, target):
    r = random.Random(target)
    rows = [(k, [r.uniform(-1, 1) for _ in range(r.randint(1, 60))]) for k in range(30)]
    df = spark.createDataFrame(rows, "k int, a array<double>")
    got = {x.k: (x.m, x.v) for x in df.select("k", A.resample(F.col("a"), target).alias("m"), A.resample(F.col("a"), target, "average", "repeat").alias("v")).collect()}
    for k, a in rows:
        n = len(a)
        if n == target:
            want = (a, a)
        elif n > target:
            g = n / target
            groups = [a[math.floor(i * g) : min(math.ceil((i + 1) * g), n)] for i in range(target)]
            want = [max(x) for x in groups], [sum(x) / len(x) for x in groups]
        else:
            step = (n - 1) / max(1, target - 1)
            line = []
            for i in range(target):
                lo = min(math.floor(i * step), n - 1)
                hi = min(lo + 1, n - 1)
                line.append(a[lo] + (a[hi] - a[lo]) * (i * step - lo))
            want = line, [a[math.floor(i * n / target)] for i in range(target)]
        assert got[k][0] == pytest.approx(want[0]) and got[k][1] == pytest.approx(want[1])
