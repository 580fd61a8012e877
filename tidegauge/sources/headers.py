"""Facts from the first bytes of audio files, signatures, pattern counts, and listings of a folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.spaced import WIDTH, spaced
from ..plans.files import extension

#: Bytes that a count moves on by after a hit.
FRAME_STEP, PAGE_STEP = 417, 4096


def byte(content: Column, at: int) -> Column:
    """The byte at place ``at`` (from 0) as a number, null behind the end."""
    return F.conv(F.when(F.octet_length(content) > at, F.hex(F.substring(content, at + 1, 1))), 16, 10).cast("int")


def signature_matches(content: Column, fmt: Column) -> Column:
    """Whether content begins as files of the format do; only wav, mp3, flac and ogg can."""
    head = lambda at, n: F.hex(F.substring(content, at, n))
    sync = (byte(content, 0) == 0xFF) & (byte(content, 1).bitwiseAND(F.lit(0xE0)) == 0xE0)
    f = F.lower(fmt)
    found = (
        F.when(f == "wav", (head(1, 4) == "52494646") & (head(9, 4) == "57415645"))
        .when(f == "mp3", sync).when(f == "flac", head(1, 4) == "664C6143").when(f == "ogg", head(1, 4) == "4F676753")
    )
    return F.coalesce(found, F.lit(False))


def mp3_header(content: Column) -> Column:
    """struct of a frame header's bit fields; null if there are fewer than four bytes."""
    h = F.shiftleft(byte(content, 0).cast("long"), 24) + F.shiftleft(byte(content, 1), 16) + F.shiftleft(byte(content, 2), 8) + byte(content, 3)
    field = lambda shift, mask, name: F.shiftright(h, shift).bitwiseAND(F.lit(mask)).cast("int").alias(name)
    return F.when(F.octet_length(content) >= 4, F.struct(field(19, 3, "version"), field(17, 3, "layer"), field(12, 15, "bitrate_index"), field(10, 3, "sample_rate_index"), field(6, 3, "channel_mode")))


def flac_header(content: Column) -> Column:
    big = lambda at: byte(content, at) * 256 + byte(content, at + 1)
    return F.when(F.octet_length(content) >= 42, F.struct(big(8).alias("min_block"), big(10).alias("max_block"), (byte(content, 4) == 0).alias("has_stream_info")))


def ogg_header(content: Column) -> Column:
    return F.when(F.octet_length(content) >= 27, F.struct(byte(content, 4).alias("version"), byte(content, 5).alias("header_type")))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Sets the session's Arrow batches to ``rows`` rows, where it is Spark's 10,000: whole contents are held several times on their way to a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, rows)


def count_patterns(files: DataFrame) -> DataFrame:
    """path, mp3_frames, ogg_pages: hits of the sync word and the page mark, after each of which the count jumps ahead (an estimate)."""

    def jump(data: bytes, first: bytes, hit, step: int) -> int:
        n, at = 0, data.find(first)
        while at >= 0 and at + 1 < len(data):
            if hit(data, at):
                n, at = n + 1, data.find(first, at + step)
            else:
                at = data.find(first, at + 1)
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frames, pages = [], []
            for c in b.column(1):  # one content at a time is a copy
                x = c.as_py() or b""
                frames.append(jump(x, b"\xff", lambda d, k: d[k + 1] & 0xE0 == 0xE0, FRAME_STEP))
                pages.append(jump(x, b"OggS", lambda d, k: True, PAGE_STEP))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(frames, pa.int64()), pa.array(pages, pa.int64())], names=["path", "mp3_frames", "ogg_pages"])

    small_batches(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, mp3_frames long, ogg_pages long")


MARKS = {"mp3_frames": (b"\xff", 2, FRAME_STEP), "ogg_pages": (b"OggS", 4, PAGE_STEP)}


def count_in_chunks(chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """The counts of ``count_patterns`` from chunks (path, idx, offset, content) of files of any size.

    A chunk names the places at which marks begin in it, with a few bytes of the next one; counting with jumps is then
    keeping those that are a jump apart. A path without content is counted 0 and 0.
    """
    far = max(n for _, n, _ in MARKS.values()) - 1
    w = W.partitionBy("path").orderBy("idx")
    rows = chunks.withColumn("_next", F.lead(F.substring("content", 1, far)).over(w))  # heads of chunks only
    rows = rows.select("path", "offset", F.octet_length("content").alias("n"), F.concat("content", F.coalesce("_next", F.lit(b""))).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, marks, found = [], [], []
            for path, offset, n, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                x = content.as_py() or b""
                for name, (mark, _, _) in MARKS.items():
                    at = x.find(mark, 0, n + len(mark) - 1)
                    while 0 <= at < n:
                        if name != "mp3_frames" or at + 1 < len(x) and x[at + 1] & 0xE0 == 0xE0:
                            paths.append(path)
                            marks.append(name)
                            found.append(offset + at)
                        at = x.find(mark, at + 1, n + len(mark) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(marks, pa.string()), pa.array(found, pa.int64())], names=["path", "mark", "at"])

    places = rows.mapInArrow(run, "path string, mark string, at long")
    counts = [spaced(places.filter(F.col("mark") == name).select(F.col("path").alias("track"), "at"), step, width).select(F.col("track").alias("path"), F.lit(name).alias("mark")) for name, (_, _, step) in MARKS.items()]
    both = counts[0].unionByName(counts[1]).unionByName(chunks.select("path", F.lit("").alias("mark")).distinct())
    return both.groupBy("path").agg(*[F.count_if(F.col("mark") == name).alias(name) for name in MARKS])


def listing(files: DataFrame) -> DataFrame:
    """path, name, extension, size_tag: a row a file; the tag stands between the last two underscores of the name."""
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), extension(F.col("path")).alias("extension"), F.regexp_extract(name, r"_([a-z]+)_[^_]*$", 1).alias("size_tag"))


def listed(files: DataFrame) -> DataFrame:
    """extension, size_tag, n."""
    return listing(files).groupBy("extension", "size_tag").agg(F.count(F.lit(1)).alias("n"))


def damaged(files: DataFrame) -> DataFrame:
    """Files whose names say that they are broken on purpose."""
    return files.filter(F.substring_index("path", "/", -1).rlike("corrupted|invalid|truncated|empty|mismatched"))
