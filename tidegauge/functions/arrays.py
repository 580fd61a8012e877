"""Column functions of whole signals held as arrays: no shuffle, for signals that fit a row.

Spark evaluates what a lambda refers to outside itself anew for each element. Whatever is used inside a
lambda is therefore bound to a name first (``let``), so that every step runs once a signal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from .scalar import curve


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _empty() -> Column:
    return F.array().cast("array<double>")


def _sum(a: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + of(x))


def rms(a: Column) -> Column:
    """Root of the mean square; 0 of nothing."""
    return let(a, lambda a: F.when(F.size(a) > 0, F.sqrt(_sum(a, lambda x: x * x) / F.size(a))).otherwise(F.lit(0.0)))


def peak(a: Column) -> Column:
    """Largest absolute value; NaN does not count, nothing is 0."""
    return F.coalesce(F.aggregate(a, F.lit(0.0), lambda m, x: F.when(F.isnan(x), m).otherwise(F.greatest(m, F.abs(x)))), F.lit(0.0))


def average(a: Column) -> Column:
    return let(a, lambda a: F.when(F.size(a) > 0, _sum(a, F.abs) / F.size(a)).otherwise(F.lit(0.0)))


def median(a: Column) -> Column:
    """Middle absolute value, or the mean of the two middle ones."""
    def middle(s: Column) -> Column:
        n, half = F.size(s), F.floor(F.size(s) / 2).cast("int")
        return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, F.element_at(s, half + 1)).otherwise((F.element_at(s, F.greatest(half, F.lit(1))) + F.element_at(s, half + 1)) / 2)
    return let(F.sort_array(F.transform(a, lambda x: F.abs(x))), middle)


OF = {"rms": rms, "peak": peak, "average": average, "median": median}


def doubles(samples: Column) -> Column:
    return samples.cast("array<double>")


def mixdown(samples: Column, channels: int | Column) -> Column:
    """Mean of a frame's channels, whose number may be a column; an incomplete last frame is ignored."""
    if isinstance(channels, Column):
        per = lambda a, n: F.when(n == 1, a).when(F.size(a) < n, _empty()).otherwise(
            F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / n).cast("int") - 1), lambda f: _sum(F.slice(a, f * n + 1, n)) / n))
        return let(doubles(samples), lambda a: let(channels, lambda n: per(a, n)))
    if channels < 1:
        raise ConfigurationError("channels must be positive")
    if channels == 1:
        return doubles(samples)
    def mixed(a: Column) -> Column:
        frames = F.floor(F.size(a) / channels).cast("int")
        each = F.transform(F.sequence(F.lit(0), frames - 1), lambda f: sum((F.get(a, f * channels + c) for c in range(1, channels)), F.get(a, f * channels)) / channels)
        return F.when(frames > 0, each).otherwise(_empty())
    return let(doubles(samples), mixed)


def downsample(samples: Column, resolution: int, algorithm: str = "rms", channels: int | Column = 1, short: str = "passthrough") -> Column:
    """``resolution`` bins of a signal; a signal of no more frames than bins is passed through as it is, unmixed and signed, or zero filled."""
    if resolution < 1:
        raise ConfigurationError("resolution must be positive")
    if algorithm not in OF:
        raise ConfigurationError(f"unknown algorithm {algorithm!r}")

    def binned(mono: Column) -> Column:
        n = F.size(mono).cast("long")
        step = n.cast("double") / float(resolution)
        def one(i: Column) -> Column:
            low, high = F.floor(i * step), F.least(F.floor((i + 1) * step), n)
            return F.when(high > low, OF[algorithm](F.slice(mono, (low + 1).cast("int"), (high - low).cast("int")))).otherwise(F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(resolution - 1)), one)

    bins = let(mixdown(samples, channels), binned)
    return F.when(F.floor(F.size(samples) / channels) <= resolution, doubles(samples)).otherwise(bins) if short == "passthrough" else bins


def normalize(a: Column, method: str = "peak") -> Column:
    """Amplitudes by their (signed) maximum or their root mean square; all 0 where that is 0."""
    divided = lambda a, by: F.when(F.size(a) == 0, a).when(by == 0, F.transform(a, lambda x: F.lit(0.0))).otherwise(F.transform(a, lambda x: x / by))
    return let(a, lambda a: let(F.array_max(a) if method == "peak" else rms(a), lambda by: divided(a, by)))


def scale(a: Column, name: str = "linear", factor: float = 1.0) -> Column:
    return F.transform(a, lambda x: curve(x, name, factor))


def smooth(a: Column, window: int | Column = 3) -> Column:
    """Centred moving average that is cut at the ends; an even or too small window, or a null one, changes nothing. The window may be a column."""
    if isinstance(window, Column):
        turned = let(F.greatest(F.coalesce(window.cast("int"), F.lit(1)), F.lit(1)), lambda w: _smooth(a, F.floor(w / 2).cast("int")))
        return F.when((window >= 3) & (window % 2 == 1), turned).otherwise(a)
    return a if window < 3 or window % 2 == 0 else _smooth(a, window // 2)


def _smooth(a: Column, half: int | Column) -> Column:
    def averaged(a: Column) -> Column:
        n = F.size(a)
        def one(_: Column, i: Column) -> Column:
            low, high = F.greatest(i - half, F.lit(0)), F.least(i + half, n - 1)
            return _sum(F.slice(a, low + 1, high - low + 1)) / (high - low + 1)
        return F.when(n <= 1, a).otherwise(F.transform(a, one))

    return let(a, averaged)


def peaks(a: Column, threshold: float = 0.1, apart: int = 1) -> Column:
    """Places of strict local maxima above ``threshold``, from the left, each ``apart`` or more behind the last one taken.

    What was taken is copied at each step: ``operators.bins.spaced_peaks`` is for signals with many thousands of maxima.
    """
    none = F.array().cast("array<int>")

    def tops(a: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(a) - 2, F.lit(1)))
        return F.when(F.size(a) < 3, none).otherwise(F.filter(at, lambda i: (F.get(a, i) > threshold) & (F.get(a, i) > F.get(a, i - 1)) & (F.get(a, i) > F.get(a, i + 1))))

    found = let(a, tops)
    if apart <= 2:  # two maxima are never closer
        return found
    state = lambda last, taken: F.struct(last.alias("last"), taken.alias("taken"))
    far = lambda s, i: F.when(s["last"].isNull() | (i - s["last"] >= apart), state(i, F.concat(s["taken"], F.array(i)))).otherwise(s)
    return F.aggregate(found, state(F.lit(None).cast("int"), none), far, lambda s: s["taken"])


def _groups(a: Column, count: Column, of) -> Column:
    group = F.size(a).cast("double") / count
    def one(i: Column) -> Column:
        low, high = F.floor(i * group), F.least(F.ceil((i + 1) * group), F.size(a).cast("long"))
        return of(F.slice(a, (low + 1).cast("int"), (high - low).cast("int")))
    return F.transform(F.sequence(F.lit(0), count - 1), one)


_DOWN = {
    "max": F.array_max,
    "minMax": F.array_max,
    "rms": rms,
    "average": lambda s: let(s, lambda s: _sum(s) / F.size(s)),
}


def _between(a: Column, count: Column) -> Column:
    """``count`` points on the lines between neighbours, ends kept."""
    step = (F.size(a) - 1).cast("double") / F.greatest(count - 1, F.lit(1))
    def one(i: Column) -> Column:
        at = i * step
        low = F.least(F.floor(at).cast("int"), F.size(a) - 1)
        high = F.least(low + 1, F.size(a) - 1)
        return F.get(a, low) + (F.get(a, high) - F.get(a, low)) * (at - low)
    return F.transform(F.sequence(F.lit(0), count - 1), one)


def _repeated(a: Column, count: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(a, F.floor(i * F.size(a) / count.cast("double")).cast("int")))


def resample(a: Column, count: Column | int, down: str = "max", up: str = "linear") -> Column:
    """Amplitudes for ``count`` places on a display: grouped if there are more, interpolated if there are fewer. ``cubic`` is linear."""
    if down not in _DOWN or up not in ("linear", "repeat", "cubic"):
        raise ConfigurationError(f"unknown method {down!r} or {up!r}")
    t = F.lit(count) if isinstance(count, int) else count.cast("int")

    def drawn(a: Column) -> Column:
        safe = F.greatest(t, F.lit(1))
        more = _repeated(a, safe) if up == "repeat" else _between(a, safe)
        return F.when((F.size(a) == 0) | (t <= 0), _empty()).when(F.size(a) == t, a).when(F.size(a) > t, _groups(a, safe, _DOWN[down])).otherwise(more)

    return let(a, drawn)


def section(a: Column, start: Column, end: Column, total: Column) -> Column:
    """The part of the amplitudes between two times of ``total``, half open."""
    n = F.size(a)
    at = lambda t: F.greatest(F.lit(0), F.least(n, F.round(t.cast("double") / total * n).cast("int")))
    low, high = at(start), at(end)
    return F.when(high > low, F.slice(a, low + 1, high - low)).otherwise(_empty())

