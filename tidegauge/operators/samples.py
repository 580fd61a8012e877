"""Sample tables of containers: track, seq, offset, size, ts_us, is_key, a row a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import PIECE_ROWS, Ordered

ORDER = ["ts_us", "seq"]


def durations(samples: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """track, seq, end_offset, us: where each sample ends, and the time to the next one of its track; null for the last."""
    rows = Ordered(samples, "track", ORDER, piece_rows).neighbour("ts_us", "next_us", ahead=True)
    return rows.select("track", "seq", (F.col("offset") + F.col("size")).alias("end_offset"), (F.col("next_us") - F.col("ts_us")).alias("us"))


def seek(samples: DataFrame, asks: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """track, q, seq, key: for each ask (track, q, ts_us) the sample that holds its time, and the last keyframe at or before it.

    Asks are put among the samples, behind those of the same time, and one ordered pass carries both
    forward: no range join. Null where there is none.
    """
    both = samples.select("track", "ts_us", "seq", F.col("seq").alias("at"), F.when(F.col("is_key"), F.col("seq")).alias("key"), F.lit(None).cast("int").alias("q"))
    none = F.lit(None).cast("long")
    both = both.unionByName(asks.select("track", "ts_us", F.lit(2**63 - 1).alias("seq"), none.alias("at"), none.alias("key"), F.col("q").cast("int").alias("q")))
    found = Ordered(both, "track", ORDER, piece_rows).latest(held=F.col("at"), key_at=F.col("key"))
    return found.filter("q is not null").select("track", "q", F.col("held").alias("seq"), F.col("key_at").alias("key"))


def facts(samples: DataFrame) -> DataFrame:
    """track, samples, us: their number, and the time from the first one to the last."""
    return samples.groupBy("track").agg(F.count("*").alias("samples"), (F.max("ts_us") - F.min("ts_us")).alias("us"))
