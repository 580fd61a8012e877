"""Waveforms of many tracks, each after its own configuration, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.scalar import bin_of, curve
from . import bins as B

#: The columns of a table of configurations, beside ``track``.
COLUMNS = ["resolution", "algorithm", "window", "normalization", "curve", "factor"]
CURVES = ("linear", "logarithmic", "exponential", "sqrt")


def problem(resolution: Column, algorithm: Column, window: Column, normalization: Column, shape: Column, factor: Column) -> Column:
    """The first column of a configuration that is not as ``WaveformConfig`` wants it, null if all are: for tables of configurations."""
    among = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    return (
        F.when(~F.coalesce(resolution > 0, F.lit(False)), "resolution").when(~among(algorithm, B.OF), "algorithm").when((window < 3) | (window % 2 == 0), "window")
        .when(~F.coalesce(normalization.isin("peak", "rms"), F.lit(True)), "normalization").when(~F.coalesce(shape.isin(*CURVES), F.lit(True)), "curve").when(~F.coalesce(factor >= 0, F.lit(False)), "factor")
    )


#: A configuration as JSON: missing entries are null, unknown ones are passed over.
JSON = "resolution int, algorithm string, window int, normalization string, curve string, factor double"


def to_json(configs: DataFrame) -> DataFrame:
    """track, json of a table of configurations; entries that are null are left out."""
    return configs.select("track", F.to_json(F.struct(*COLUMNS)).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """The table of configurations again; what is no JSON gives nulls only."""
    return rows.select("track", F.from_json("json", JSON).alias("c")).select("track", "c.*")


def waveforms(framed: DataFrame, configs: DataFrame) -> DataFrame:
    """track, bin, amp: ``framed`` (track, frame, frames, v) after the configuration that ``configs`` has on its track.

    ``window`` null does not smooth, ``normalization`` null does not normalise, ``curve`` null does not scale (nor clamp). A
    track of no more frames than bins keeps its values. Tracks without a configuration, or with another ``problem``, are left out, as those of a null track; a track with several configurations is an error of the table.
    """
    sound = problem(*[F.col(c) for c in COLUMNS]).isNull()
    known = configs.filter(sound).select("track", *COLUMNS)
    rows = framed.join(known, "track")  # the smaller side is broadcast if Spark finds it small
    whole = F.col("frames") <= F.col("resolution")
    at = F.when(whole, F.col("frame")).otherwise(bin_of(F.col("frame"), F.col("frames"), F.col("resolution"))).cast("long")
    rows = rows.withColumn("whole", whole).withColumn("bin", at).filter(F.col("bin").isNotNull())
    # Each algorithm sees the values of its own tracks only.
    of = {k: f(F.when(F.col("algorithm") == k, F.col("v"))) for k, f in B.OF.items()}
    own = F.first(F.struct("whole", "v", *COLUMNS)).alias("own")
    bins = rows.groupBy("track", "bin").agg(own, *[c.alias(k) for k, c in of.items()])
    amp = F.coalesce(*[F.when(F.col("own.algorithm") == k, F.col(k)) for k in B.OF])
    bins = bins.select("track", "bin", "own", F.when(F.col("own.whole"), F.col("own.v")).otherwise(amp).alias("amp"))
    # From here on a track is a row: it has as many bins as its resolution at most.
    tracks = bins.groupBy("track").agg(F.first("own").alias("own"), F.array_sort(F.collect_list(F.struct("bin", "amp"))).alias("bins"))
    tracks = tracks.select("track", "own.*", F.col("bins.bin").alias("bins"), F.col("bins.amp").alias("a"))
    tracks = tracks.withColumn("a", A.smooth(F.col("a"), F.col("window")))
    normal = F.when(F.col("normalization") == "peak", A.normalize(F.col("a"), "peak")).when(F.col("normalization") == "rms", A.normalize(F.col("a"), "rms")).otherwise(F.col("a"))
    tracks = tracks.withColumn("a", normal)
    rows = tracks.select("track", "curve", "factor", F.explode(F.arrays_zip(F.col("bins").alias("bin"), F.col("a").alias("amp"))).alias("x")).select("track", "curve", "factor", "x.bin", "x.amp")
    shaped = F.coalesce(*[F.when(F.col("curve") == k, curve(F.col("amp"), k, F.col("factor"))) for k in CURVES], F.when(F.col("curve").isNull(), F.col("amp")))
    return rows.select("track", "bin", shaped.alias("amp"))
