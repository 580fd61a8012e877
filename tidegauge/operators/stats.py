"""Statistics of timed operations: name, duration_ms, success, memory_bytes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordered import KEYS, PIECE_ROWS, Ordered

SLOW_MS, HEAVY_BYTES, HISTORY = 1000, 10 << 20, 100


def statistics(ops: DataFrame) -> DataFrame:
    """A row a name: counts, failure rate, durations in whole milliseconds, memory."""
    ms = F.floor("duration_ms").cast("long")
    n, ok = F.count(F.lit(1)), F.count_if(F.col("success"))
    return ops.groupBy("name").agg(
        n.alias("n"), ok.alias("ok"), ((n - ok) / n).alias("failure_rate"), F.avg(ms).alias("avg_ms"), F.median(ms).alias("median_ms"),
        F.sum(ms).alias("sum_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.stddev_pop(ms).alias("stddev_ms"), F.avg("memory_bytes").alias("avg_memory"), F.sum("memory_bytes").alias("sum_memory"),
    )


def bottlenecks(ops: DataFrame) -> DataFrame:
    """name, slow, heavy of the names that are either on average."""
    s = statistics(ops).select("name", (F.col("avg_ms") > SLOW_MS).alias("slow"), (F.col("avg_memory") > HEAVY_BYTES).alias("heavy"))
    return s.filter("slow or heavy")


def report(ops: DataFrame) -> DataFrame:
    """One row: totals (operations, failures, milliseconds, bytes), failure rate (NaN without operations), names that are slow or heavy, sorted."""
    s = statistics(ops)
    total, failed = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - F.col("ok")), F.lit(0))
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    return s.agg(
        total.alias("total"), failed.alias("failed"), F.when(total == 0, F.lit(float("nan"))).otherwise(F.try_divide(failed, total)).alias("failure_rate"),
        F.coalesce(F.sum("sum_ms"), F.lit(0)).alias("total_ms"), F.coalesce(F.sum("sum_memory"), F.lit(0)).alias("total_memory"),
        F.count(F.lit(1)).alias("names"), names(F.col("avg_ms") > SLOW_MS).alias("slow"), names(F.col("avg_memory") > HEAVY_BYTES).alias("heavy"),
    )


def recommendations(*parts: DataFrame) -> DataFrame:
    """Lists of advice as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def newest(ops: DataFrame, order: str, keep: int = HISTORY) -> DataFrame:
    """The newest ``keep`` rows of each name; what is older is dropped before the shuffle already."""
    return ops.withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy(F.desc(order)))).filter(F.col("_r") <= keep).drop("_r")


def best(ops: DataFrame) -> DataFrame:
    """One row: the fastest, the lightest and the most reliable name."""
    s = statistics(ops)
    return s.agg(F.min_by("name", F.struct("avg_ms", "name")).alias("fastest"), F.min_by("name", F.struct("avg_memory", "name")).alias("lightest"), F.min_by("name", F.struct("failure_rate", "name")).alias("most_reliable"))


def benchmark(results: DataFrame, key: str = "results") -> DataFrame:
    """name, avg, min, max of a column map<string, array<double>>."""
    rows = results.select(F.explode(key).alias("name", "xs")).select("name", F.explode("xs").alias("x"))
    return rows.groupBy("name").agg(F.avg("x").alias("avg"), F.min("x").alias("min"), F.max("x").alias("max"))


def memory_curve(changes: DataFrame, limit: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """track, seq, used, level: memory after each change (never below 0), and whether it is normal, high (over 80 %) or critical (over 90 %)."""
    # A sum that is held at 0 is the plain sum less the lowest that it has been below 0.
    o = Ordered(changes, "track", ["seq"], piece_rows)
    rows = o.rows.withColumn("_s", F.sum("change").over(o.upto)).withColumn("_low", F.min("_s").over(o.upto))
    if o.whole:
        return _levels(o.given(rows).select("track", "seq", (F.col("_s") - F.least(F.lit(0), "_low")).cast("long").alias("used")), limit)
    past = o.pieces(F.sum("change").alias("_sum"), F.min("_s").alias("_least"), rows=rows).withColumn("_from", F.coalesce(F.sum("_sum").over(o.before), F.lit(0)))
    past = past.select(*KEYS, "_from", F.least(F.lit(0), F.min(F.col("_from") + F.col("_least")).over(o.before)).alias("_floor"))
    rows = o.given(rows, past)
    low = F.least("_floor", F.col("_from") + F.col("_low"))
    return _levels(rows.select("track", "seq", (F.col("_from") + F.col("_s") - low).cast("long").alias("used")), limit)


def _levels(rows: DataFrame, limit: int) -> DataFrame:
    share = F.col("used") / limit
    return rows.withColumn("level", F.when(share > 0.9, "critical").when(share > 0.8, "high").otherwise("normal"))


class Profiler:
    """Times functions on the driver; its rows feed the functions above. Memory is not measured and counts 0."""

    SCHEMA = "seq long, name string, duration_ms double, memory_bytes long, start_time timestamp, end_time timestamp, success boolean, error string, metadata map<string,string>"

    def __init__(self, enabled: bool = True) -> None:
        self.enabled, self.records = enabled, []

    @contextmanager
    def timed(self, name: str, **metadata: str) -> Iterator[None]:
        if not self.enabled:
            yield
            return
        start, began, error = datetime.now(timezone.utc), time.perf_counter(), None
        try:
            yield
        except Exception as e:
            error = str(e)
            raise
        finally:
            ms = (time.perf_counter() - began) * 1000
            self.records.append((len(self.records), name, ms, 0, start, datetime.now(timezone.utc), error is None, error, {k: str(v) for k, v in metadata.items()}))

    def profile(self, name: str, function: Callable, *args, **kwargs):
        with self.timed(name):
            return function(*args, **kwargs)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, self.SCHEMA)

    def export(self, spark: SparkSession) -> DataFrame:
        """operation: each record as JSON."""
        return self.frame(spark).select(F.to_json(F.struct("*")).alias("operation"))
