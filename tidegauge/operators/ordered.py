"""The order of rows in tracks of any length.

A window over a whole track sorts it in one task, however long it is. So tracks are counted first, and
where the longest one is more than a piece, the order of all rows is cut into pieces of about equal numbers
of rows: ranges of track and all order columns, which Spark draws from a sample of the rows, so that neither
outliers nor bursts nor one time for all make a piece longer. Windows run inside pieces, and what a
piece needs to know of those before it (counts, sums, last values) comes from a table with a row a piece.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..errors import ConfigurationError

#: Rows of a piece, about. A track of no more than these is one piece.
PIECE_ROWS = 1_000_000
KEYS = ["_t", "_none", "_piece"]
#: The part of Spark's increasing ids that counts inside a partition.
_INSIDE = (1 << 33) - 1


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own where it is unset, which only a local master allows."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)  # what is not there yet is not deleted either
    files.deleteOnExit(place)
    return path


class Ordered:
    """``rows`` of tracks in the order of ``order``, with the columns of KEYS: track without nulls, whether it was null, piece.

    Two aggregates run when this is made, and longer tracks are written once, in pieces of about ``piece_rows`` rows.
    Rows that are equal in all columns cannot be told apart and stay in one piece.
    """

    def __init__(self, rows: DataFrame, track: str, order: list[str], piece_rows: int = PIECE_ROWS) -> None:
        kind = rows.schema[track].dataType
        none = F.col(track).isNull()
        if isinstance(kind, (T.StringType, T.NumericType)):  # a null track is a track; joins need a key that is not null
            t = F.coalesce(F.col(track), F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind))
        else:
            t = F.struct(track)
        rows = rows.withColumn("_t", t).withColumn("_none", none)
        counts = rows.groupBy("_t", "_none").agg(F.count(F.lit(1)).alias("n"))
        self.longest, total = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()  # one row
        self.whole = self.longest <= piece_rows
        self.order = list(order)
        if self.whole:
            self.rows = rows.withColumn("_piece", F.lit(0))
        else:
            self.rows = self._cut(rows, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // piece_rows)))
        self.inside = W.partitionBy(*KEYS).orderBy(*self.order)
        self.upto = self.inside.rowsBetween(W.unboundedPreceding, W.currentRow)
        self.across = W.partitionBy("_t", "_none").orderBy("_piece")
        self.before = self.across.rowsBetween(W.unboundedPreceding, -1)

    def _cut(self, rows: DataFrame, n: int) -> DataFrame:
        """The rows in n ranges, sorted; rows that no order column tells apart are told apart by all they hold."""
        rows = rows.withColumn("_tie", F.xxhash64(*[f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]))
        self.order.append("_tie")
        keys = ["_t", "_none", *self.order]
        laid = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        laid = laid.withColumn("_piece", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_INSIDE)))
        # The bounds of ranges are drawn anew on every run, so the ranges are written once.
        path = shared_path(rows.sparkSession, "ordered")
        laid.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(laid.schema).parquet(path)

    def pieces(self, *aggregates: Column, rows: DataFrame | None = None) -> DataFrame:
        """A row a piece with ``aggregates`` of its rows."""
        return (self.rows if rows is None else rows).groupBy(*KEYS).agg(*aggregates)

    def given(self, rows: DataFrame, table: DataFrame | None = None) -> DataFrame:
        """``rows`` with what ``table`` has on their piece, without the columns of ours."""
        return (rows if table is None else rows.join(table, KEYS)).drop(*KEYS, "_tie", "_at")

    def numbered(self) -> DataFrame:
        """The rows with ``frame`` (from 0) and ``frames``, the track's number of rows."""
        if self.whole:
            rows = self.rows.withColumn("frame", (F.row_number().over(self.inside) - 1).cast("long"))
            return self.given(rows.withColumn("frames", F.count(F.lit(1)).over(W.partitionBy(*KEYS))))
        # A range is sorted, so a row's place in it tells its number: no window over rows.
        counts = self.pieces(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        before = F.coalesce(F.sum("_n").over(self.before), F.lit(0)) - F.col("_first")
        counts = counts.select(*KEYS, before.alias("_from"), F.sum("_n").over(W.partitionBy("_t", "_none")).alias("frames"))
        rows = self.rows.join(counts, KEYS).withColumn("frame", (F.col("_from") + F.col("_at")).cast("long"))
        return self.given(rows).drop("_from")

    def neighbour(self, column: str, name: str, ahead: bool = False) -> DataFrame:
        """The rows with ``name``: ``column`` of the row before or, with ``ahead``, after in the track; null where there is none."""
        pick, step = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
        if self.whole:
            return self.given(self.rows.withColumn(name, step(column).over(self.inside)))
        value = F.struct(F.col(column).alias("v"))
        edge = self.pieces(pick(value, F.struct(*self.order)).alias("_edge"))
        edge = edge.select(*KEYS, step("_edge").over(self.across).alias("_edge"))
        rows = self.given(self.rows.withColumn("_near", step(value).over(self.inside)), edge)
        return rows.withColumn(name, F.coalesce("_near", "_edge")["v"]).drop("_near", "_edge")

    def latest(self, **columns: Column) -> DataFrame:
        """The rows with each of ``columns`` as the last value that was not null, up to the row itself."""
        if self.whole:
            return self.given(self.rows.select("*", *[F.last(c, True).over(self.upto).alias(k) for k, c in columns.items()]))
        inside = self.rows.select("*", *[F.last(c, True).over(self.upto).alias(f"_in_{k}") for k, c in columns.items()])
        ends = self.pieces(*[F.max_by(c, F.when(c.isNotNull(), F.struct(*self.order))).alias(k) for k, c in columns.items()])
        ends = ends.select(*KEYS, *[F.last(k, True).over(self.before).alias(f"_past_{k}") for k in columns])
        rows = self.given(inside, ends)
        return rows.withColumns({k: F.coalesce(f"_in_{k}", f"_past_{k}") for k in columns}).drop(*[f"{p}_{k}" for k in columns for p in ("_in", "_past")])
