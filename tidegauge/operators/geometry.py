"""What a drawing of amplitudes needs: bars, and the points of lines and filled shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalar import clamp01
from .ordered import Ordered


def played_width(width: float, position: float, animation: float = 1.0) -> float:
    return width * position * animation


def bars(bins: DataFrame, height: float, played: float, left: float = 0.0, bar: float = 3.0, gap: float = 1.0, scale: float = 1.0, least: float = 2.0, most: float | None = None) -> DataFrame:
    """track, bin, x, top, h, played."""
    h = clamp01(F.col("amp") * scale) * (height / 2)
    h = F.least(F.lit(float(height if most is None else most)), F.greatest(F.lit(least), h))
    x = F.lit(left) + F.col("bin") * (bar + gap)
    return bins.select("track", "bin", x.alias("x"), (F.lit(height / 2) - h / 2).alias("top"), h.alias("h"), (x - left < played).alias("played"))


def points(bins: DataFrame, width: float, height: float, left: float = 0.0, scale: float = 1.0) -> DataFrame:
    """track, bin, x, y and n, the track's number of bins."""
    rows = bins.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("track")))
    x = F.when(F.col("n") > 1, left + F.col("bin") / F.greatest(F.col("n") - 1, F.lit(1)) * width).otherwise(F.lit(left))
    return rows.select("track", "bin", "n", x.alias("x"), (F.lit(height / 2) - clamp01(F.col("amp") * scale) * (height / 2)).alias("y"))


def line(bins: DataFrame, width: float, height: float, played: float, left: float = 0.0, scale: float = 1.0) -> DataFrame:
    """track, bin, x, y, played, cut_x, cut_y: points of a line; the first one behind the playhead also has the place where the line crosses it. Tracks of one bin have no line."""
    w = W.partitionBy("track").orderBy("bin")
    rows = points(bins, width, height, left, scale).filter("n >= 2").withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    inside = F.col("x") - left <= played
    cut = ~inside & F.col("px").isNotNull() & (F.col("px") - left <= played)
    at = (left + played - F.col("px")) / (F.col("x") - F.col("px"))
    return rows.select("track", "bin", "x", "y", inside.alias("played"), F.when(cut, F.lit(left + played)).alias("cut_x"), F.when(cut, F.col("py") + (F.col("y") - F.col("py")) * at).alias("cut_y"))


def filled(bins: DataFrame, width: float, height: float, played: float, left: float = 0.0, scale: float = 1.0) -> DataFrame:
    """track, bin, x, y, played: the upper edge of a closed shape on the middle line."""
    return points(bins, width, height, left, scale).select("track", "bin", "x", "y", (F.col("x") - left <= played).alias("played"))


def changes(positions: DataFrame) -> DataFrame:
    """track, seq, position: positions within [0, 1], where they differ from the one before."""
    rows = positions.withColumn("position", clamp01(F.col("position")))
    return Ordered(rows, "track", ["seq"]).neighbour("position", "_b").filter(F.col("_b").isNull() | (F.col("_b") != F.col("position"))).drop("_b")
