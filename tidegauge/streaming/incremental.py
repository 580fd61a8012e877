"""Bins of a growing stream of values: an addition of ours to what the batch side does."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.ordered import shared_path


def windowed(stream: DataFrame, time: str, track: str, value: str, width: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """track, start, n, rms, peak, average of each window of event time; state of windows older than ``late`` is dropped."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    v = F.col(value)
    made = rows.groupBy(F.window(time, width).alias("w"), F.col(track).alias("track")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.when(~F.isnan(v), F.abs(v))).alias("peak"), F.avg(F.abs(v)).alias("average"),
    )
    return made.select("track", F.col("w.start").alias("start"), "n", "rms", "peak", "average")


USED = "track string, seq long, time timestamp, kind string, used long, level string, checks long"


def level_of(used: int, limit: int) -> str:
    return "critical" if used / limit > 0.9 else "high" if used / limit > 0.8 else "normal"


def memory(stream: DataFrame, limit: int, every: float = 5.0, late: str = "1 minute") -> DataFrame:
    """Memory in use, kept as state of each track: a row for each change, as in ``stats.memory_curve``, and rows for checks.

    ``stream`` has track, seq, time, change. Changes count in the order of seq within a batch and of batches among each
    other; memory is never below 0. Every ``every`` seconds of event time pressure is looked at: where it was high or
    critical at such times, one row of kind ``check`` says how often, up to the next change or, where none comes,
    as far as the watermark has got. Rows that come more than ``late`` behind the newest time are dropped, as Spark does
    with event times. State is one row a track; a task holds a batch's rows of a track.
    """
    tick, names = round(every * 1e6), [c.split()[0] for c in USED.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, seen, seq = state.get if state.exists else (0, None, None)
        out = []

        def looked(until: int) -> None:
            """Checks between the last change and a later time."""
            nonlocal seen
            if seen is not None and until > seen:
                n = until // tick - seen // tick
                if n and (level := level_of(used, limit)) != "normal":
                    out.append((key[0], seq, (seen // tick + 1) * tick, "check", used, level, n))
                seen = until

        if state.hasTimedOut:
            looked(state.getCurrentWatermarkMs() * 1000)
        else:
            held = list(parts)  # most groups are a few rows: columns are taken as arrays, which costs least
            column = lambda c, kind: np.concatenate([x[c].to_numpy().astype(kind) for x in held])
            seqs, times, changes = column("seq", "int64"), column("time", "datetime64[us]").astype("int64"), column("change", "int64")
            order = np.argsort(seqs, kind="stable")
            for seq_, at, change in zip(seqs[order].tolist(), times[order].tolist(), changes[order].tolist(), strict=True):
                looked(at)
                used, seen, seq = max(0, used + change), at if seen is None else max(seen, at), seq_
                out.append((key[0], seq, at, "change", used, level_of(used, limit), 0))
        state.update((used, seen, seq))
        if level_of(used, limit) != "normal":
            state.setTimeoutTimestamp(max((seen // tick + 1) * tick // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            made = dict(zip(names, zip(*out), strict=True))
            yield pd.DataFrame({**made, "time": np.array(made["time"], "datetime64[us]")})

    rows = stream.select(F.col("track").cast("string").alias("track"), F.col("seq").cast("long").alias("seq"), F.col("time").cast("timestamp").alias("time"), F.col("change").cast("long").alias("change"))
    return rows.withWatermark("time", late).groupBy("track").applyInPandasWithState(run, USED, "used long, seen long, seq long", "append", "EventTimeTimeout")


def read(spark: SparkSession, folder: str, name: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files called ``name`` in ``folder``, ``files`` to a batch."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)


def settle(stream: DataFrame, mode: str = "complete", base: str | None = None) -> DataFrame:
    """What the stream gives on all there is now: each batch is written to the shared folder, the last one (or, appending, all) is read back.

    A stream that is settled in the same folder ``base`` again goes on from where it was.
    """
    spark = stream.sparkSession
    base = base or shared_path(spark, "stream")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    # Spark lists the files of each batch again, by a task a file unless it is told otherwise.
    listers, before = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.conf.set(listers, min(int(before), 2 * spark.sparkContext.defaultParallelism))
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        spark.conf.set(listers, before)
    out = spark.read.schema(schema).option("recursiveFileLookup", "true")
    return out.parquet(f"{base}/out")
