"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own where it is unset, which only a local master allows."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: its lineage ends there, and a lost executor costs no earlier work.

    The files go with ``discard``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that ``cut`` gave and nothing reads any more."""
    for t in tables:
        if (path := getattr(t, "cut_path", None)) is not None:
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def words(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*parts: Column) -> Column:
    """A double in (0, 1) from the hash of ``parts``: the same on every run and every retry."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(2**53))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of the batches in which texts travel to Python workers: at some kilobytes a text, a few megabytes.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows, unless they have been set to something else than Spark's default.

    A batch is held several times on its way to a worker and back, and Spark's 10,000 rows of whole texts are tens of
    megabytes each time.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, BATCH_ROWS)
