"""Bins of long signals: one row a frame, partial aggregation before the shuffle, windows over bins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import ConfigurationError
from ..functions.scalar import bin_of
from .ordered import KEYS, PIECE_ROWS, Ordered
from .spaced import WIDTH, spaced


def rms(x: Column) -> Column:
    return F.coalesce(F.sqrt(F.avg(x * x)), F.lit(0.0))


def peak(x: Column) -> Column:
    """NaN does not count."""
    return F.coalesce(F.max(F.when(~F.isnan(x), F.abs(x))), F.lit(0.0))


def average(x: Column) -> Column:
    return F.coalesce(F.avg(F.abs(x)), F.lit(0.0))


def median(x: Column) -> Column:
    return F.coalesce(F.median(F.abs(x)), F.lit(0.0))


OF = {"rms": rms, "peak": peak, "average": average, "median": median}


def frames(rows: DataFrame, track: str, order: list[str], value: Column | str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """track, frame, frames, v of rows in order, for tracks of any length: see ``ordered``."""
    v = F.col(value) if isinstance(value, str) else value
    named = rows.select(F.col(track).alias("track"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], v.cast("double").alias("v"))
    o = Ordered(named, "track", [f"_o{k}" for k in range(len(order))], piece_rows)
    out = o.numbered().select("track", "frame", "frames", "v")
    out.longest = o.longest
    return out


def exact_median(rows: DataFrame, keys: list[str], value: Column | str, name: str = "median", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """keys, ``name``: the exact median of each group, for groups of any size: null where a group has no value.

    Equal values are counted before the shuffle, so a group with one value for all is one row; a group's distinct
    values are ordered in pieces, and the piece in which the middle ranks fall is known from the counts of those
    before it. No task holds a group. An even group gives the mean of its two middle values.
    """
    v = F.col(value) if isinstance(value, str) else value
    counted = rows.select(F.struct(*keys).alias("group"), v.cast("double").alias("v")).groupBy("group", "v").agg(F.count("v").alias("n"))
    o = Ordered(counted, "group", ["v"], piece_rows)
    inside = o.rows.withColumn("_upto", F.sum("n").over(o.upto))
    if o.whole:
        placed = inside.withColumn("_before", F.lit(0)).withColumn("_all", F.sum("n").over(W.partitionBy(*KEYS)))
    else:
        table = o.pieces(F.sum("n").alias("_sum"))
        table = table.select(*KEYS, F.coalesce(F.sum("_sum").over(o.before), F.lit(0)).alias("_before"), F.sum("_sum").over(W.partitionBy("_t", "_none")).alias("_all"))
        placed = inside.join(table, KEYS)
    end = F.col("_before") + F.col("_upto")
    at = lambda rank: F.max(F.when((end - F.col("n") <= rank) & (rank < end), F.col("v")))
    low, high = at(F.floor((F.col("_all") - 1) / 2)), at(F.floor(F.col("_all") / 2))
    return placed.groupBy("group").agg(((low + high) / 2).alias(name)).select("group.*", name)


def short_frames(rows: DataFrame, track: str, order: list, value: Column | str) -> DataFrame:
    """The same for tracks that are known to be short: one window a track, which a task sorts and holds."""
    w = W.partitionBy(track)
    v = F.col(value) if isinstance(value, str) else value
    return rows.select(
        F.col(track).alias("track"),
        (F.row_number().over(w.orderBy(*order)) - 1).cast("long").alias("frame"),
        F.count(F.lit(1)).over(w).alias("frames"),
        v.cast("double").alias("v"),
    )


def downsample(framed: DataFrame, resolution: int, algorithm: str = "rms", short: str = "passthrough", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """track, bin, amp: ``resolution`` bins of each track.

    A track of no more frames than bins keeps its values (``passthrough``), or has empty bins of 0
    (``zero_fill``). Frames behind the last edge are in no bin. Medians of bins that may have more than
    ``piece_rows`` frames are found by ``exact_median``; the result is the same.
    """
    if algorithm not in OF:
        raise ConfigurationError(f"unknown algorithm {algorithm!r}")
    if resolution < 1:
        raise ConfigurationError("resolution must be positive")
    whole = F.lit(False) if short == "zero_fill" else F.col("frames") <= resolution
    at = F.when(whole, F.col("frame")).otherwise(bin_of(F.col("frame"), F.col("frames"), resolution)).cast("long")
    rows = framed.withColumn("whole", whole).withColumn("bin", at).filter(F.col("bin").isNotNull())
    if algorithm == "median" and getattr(framed, "longest", float("inf")) > resolution * piece_rows:
        wide = exact_median(rows.filter(~F.col("whole")), ["track", "bin"], F.abs("v"), "amp", piece_rows).select("track", "bin", F.coalesce("amp", F.lit(0.0)).alias("amp"))
        made = wide.unionByName(rows.filter("whole").select("track", "bin", F.col("v").alias("amp")))
        return made if short != "zero_fill" else _filled(framed, made, resolution)
    made = rows.groupBy("track", "bin").agg(OF[algorithm](F.col("v")).alias("binned"), F.first("v").alias("own"), F.first("whole").alias("whole"))
    made = made.select("track", "bin", F.when(F.col("whole"), F.col("own")).otherwise(F.col("binned")).alias("amp"))
    return made if short != "zero_fill" else _filled(framed, made, resolution)


def _filled(framed: DataFrame, made: DataFrame, resolution: int) -> DataFrame:
    grid = framed.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resolution - 1).cast("long"))).alias("bin"))
    return grid.join(made, ["track", "bin"], "left").select("track", "bin", F.coalesce("amp", F.lit(0.0)).alias("amp"))


def explode_frames(signals: DataFrame, track: str, samples: str, channels: int = 1) -> DataFrame:
    """track, frame, frames, v of signals held as arrays, channels mixed to their mean."""
    if channels < 1:
        raise ConfigurationError("channels must be positive")
    n = F.floor(F.size(samples) / channels).cast("long")
    rows = signals.select(F.col(track).alias("track"), n.alias("frames"), F.posexplode(F.col(samples).cast("array<double>")).alias("i", "x"))
    rows = rows.withColumn("frame", F.floor(F.col("i") / channels).cast("long")).filter(F.col("frame") < F.col("frames"))
    out = rows.select("track", "frame", "frames", F.col("x").alias("v")) if channels == 1 else rows.groupBy("track", "frame", "frames").agg(F.avg("x").alias("v"))
    out.longest = 0  # whole signals fit a row, and so do their bins
    return out


def normalize(bins: DataFrame, method: str = "peak") -> DataFrame:
    """Amplitudes by their track's (signed) maximum or root mean square; all 0 where that is 0."""
    w = W.partitionBy("track")
    by = F.max("amp").over(w) if method == "peak" else F.sqrt(F.avg(F.col("amp") * F.col("amp")).over(w))
    return bins.withColumn("_by", by).withColumn("amp", F.when(F.col("_by") == 0, F.lit(0.0)).otherwise(F.try_divide("amp", "_by"))).drop("_by")


def smooth(bins: DataFrame, window: int = 3) -> DataFrame:
    """Centred moving average over bins, cut at the ends; an even or too small window changes nothing."""
    if window < 3 or window % 2 == 0:
        return bins
    half = window // 2
    return bins.withColumn("amp", F.avg("amp").over(W.partitionBy("track").orderBy("bin").rowsBetween(-half, half)))


def peaks(bins: DataFrame, threshold: float = 0.1) -> DataFrame:
    """track, bin, amp of strict local maxima above ``threshold``. A window holds a track's bins, of which there are as many as the resolution."""
    w = W.partitionBy("track").orderBy("bin")
    return bins.withColumn("_p", F.lag("amp").over(w)).withColumn("_n", F.lead("amp").over(w)).filter(
        (F.col("amp") > threshold) & (F.col("amp") > F.col("_p")) & (F.col("amp") > F.col("_n"))
    ).drop("_p", "_n")


def spaced_peaks(bins: DataFrame, threshold: float = 0.1, apart: int = 1, width: int = WIDTH) -> DataFrame:
    """track, bin of strict local maxima above ``threshold``, from the left, each ``apart`` or more behind the last one taken: for signals of any length."""
    found = peaks(bins, threshold)
    return found.select("track", "bin") if apart <= 2 else spaced(found.select("track", F.col("bin").alias("at")), apart, width).withColumnRenamed("at", "bin")


def collect(bins: DataFrame) -> DataFrame:
    """track, amplitudes: a row a track, bins in order. A track has as many as the resolution."""
    return bins.groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "amp"))), lambda x: x["amp"]).alias("amplitudes"))


def section(bins: DataFrame, start: float, end: float, total: float) -> DataFrame:
    """The bins between two times of ``total``, half open."""
    n = F.count(F.lit(1)).over(W.partitionBy("track"))
    rows = bins.withColumn("_n", n)
    at = lambda t: F.greatest(F.lit(0), F.least(F.col("_n"), F.round(t / total * F.col("_n")).cast("long")))
    return rows.filter((F.col("bin") >= at(start)) & (F.col("bin") < at(end))).drop("_n")
