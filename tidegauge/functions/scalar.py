"""Column functions of one value: curves, clamps, and the bin of a frame."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigurationError


def clamp01(x: Column) -> Column:
    """``x`` within [0, 1]; NaN stays NaN, which least and greatest alone would turn into 1."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def curve(x: Column, name: str = "linear", factor: float | Column = 1.0) -> Column:
    """An amplitude on a curve, times ``factor``, within [0, 1]."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    shaped = {
        "linear": lambda: x * f,
        "logarithmic": lambda: F.when(x > 0, F.ln(1 + 9 * x) / math.log(10) * f).otherwise(F.lit(0.0)),
        "exponential": lambda: x * x * f,
        "sqrt": lambda: F.sqrt(x) * f,
    }
    if name not in shaped:
        raise ConfigurationError(f"unknown curve {name!r}")
    return clamp01(shaped[name]())


def bin_of(frame: Column, frames: Column, resolution: int | Column) -> Column:
    """The bin of a frame, null if it is in none; the resolution may be a column.

    Bin i holds the frames from floor(i * s) up to floor((i + 1) * s) with s = frames / resolution in
    double arithmetic. Integer division gives the bin but for rounding of those products, which shifts an
    edge by one frame at most; the last frame can fall behind the last edge.
    """
    r = F.lit(resolution).cast("long")
    s = frames.cast("double") / r.cast("double")
    k = F.floor(((frame + 1) * r - 1).cast("double") / frames.cast("double"))
    edge = lambda i: F.floor(i * s)
    k = F.when(frame < edge(k), k - 1).when(frame >= edge(k + 1), k + 1).otherwise(k)
    return F.when(k < r, k)


def display_resolution(width: Column, kind: str, bar: float = 3.0, gap: float = 1.0, density: float | None = None) -> Column:
    """How many points a drawing of ``width`` pixels shows."""
    if kind == "bars":
        n = F.greatest(F.lit(1).cast("long"), F.floor(width / (bar + gap)))
    elif kind in ("line", "filled"):
        per = density if density is not None else (1.0 if kind == "line" else 0.5)
        n = F.greatest(F.lit(1).cast("long"), F.round(width * per / 100 if kind == "line" else width * per).cast("long"))
    else:
        raise ConfigurationError(f"unknown kind {kind!r}")
    return F.when(width > 0, n).otherwise(F.lit(0).cast("long"))


def seek_position(x: Column, width: Column) -> Column:
    """Where in [0, 1] a touch at ``x`` points; 0 on a drawing without width."""
    return F.when(width > 0, clamp01(x / width)).otherwise(F.lit(0.0))


def duration_ms(samples: Column, rate: Column, channels: Column) -> Column:
    """Whole milliseconds of ``samples`` interleaved samples, truncated."""
    return F.expr("1L") * F.floor(samples.cast("long") * 1000 / (rate * channels).cast("double"))


def duration_us(samples: Column, rate: Column, channels: Column) -> Column:
    """Microseconds of ``samples`` interleaved samples, rounded."""
    return F.round(samples.cast("double") / rate * 1e6 / channels).cast("long")


def _tenths(n: Column, bits: int) -> Column:
    """n / 2**bits with one decimal; ties go to the even digit, where format_string would round them up."""
    unit = 1 << bits
    whole, rest = F.shiftright(n, bits), n % unit * 10
    digit, left = F.shiftright(rest, bits), rest % unit * 2
    up = F.when((left > unit) | (left == unit) & (digit % 2 == 1), 1).otherwise(0)
    tenths = digit + up
    return F.concat((whole + F.floor(tenths / 10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def size_text(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal; null of null."""
    n = size.cast("long")
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
        .when(n < 1 << 20, F.concat(_tenths(n, 10), F.lit("KB")))
        .when(n < 1 << 30, F.concat(_tenths(n, 20), F.lit("MB")))
        .otherwise(F.concat(_tenths(n, 30), F.lit("GB")))
    )


def duration_text(us: Column) -> Column:
    """Microseconds as hours:minutes:seconds with six decimals; negative ones with a sign before."""
    x = F.abs(us.cast("long"))
    part = lambda unit, of: F.floor(x / unit) % of if of else F.floor(x / unit)
    text = F.format_string("%d:%02d:%02d.%06d", part(3_600_000_000, 0), part(60_000_000, 60), part(1_000_000, 60), x % 1_000_000)
    return F.when(us < 0, F.concat(F.lit("-"), text)).when(us >= 0, text)


def progress_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)
