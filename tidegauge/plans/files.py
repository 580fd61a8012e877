"""Formats, file checks, chunks, and estimates of memory: what is decided before anything is decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KB, MB = 1 << 10, 1 << 20
#: Format, display name, extensions, decoded bytes for each encoded one, divisor of the size that gives a chunk, whether it is read in chunks.
FORMATS = [
    ("mp3", "MP3", ["mp3"], 10, 100, True),
    ("wav", "WAV", ["wav"], 1, 50, True),
    ("flac", "FLAC", ["flac"], 2, 80, True),
    ("ogg", "OGG Vorbis", ["ogg"], 8, 120, True),
    ("opus", "Opus", ["opus"], 12, 150, True),
    ("mp4", "MP4/AAC", ["mp4", "m4a"], 12, 100, True),
]
CHUNK, LEAST_FILE, IN_MEMORY, DECODE_LIMIT = 10 * MB, 12, 50 * MB, 100 * MB


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, name string, extensions array<string>, ratio int, divisor int, chunked boolean")


def extensions(spark: SparkSession) -> DataFrame:
    return formats(spark).select(F.explode("extensions").alias("extension"), "format")


def _by_format(fmt: Column, k: int, other) -> Column:
    out = F.when(fmt == FORMATS[0][0], F.lit(FORMATS[0][k]))
    for f in FORMATS[1:]:
        out = out.when(fmt == f[0], F.lit(f[k]))
    return out.otherwise(F.lit(other))


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path in lower case; empty without a dot."""
    return F.when(F.instr(path, ".") > 0, F.lower(F.substring_index(path, ".", -1))).otherwise(F.lit(""))


def format_of(path: Column) -> Column:
    """The format by extension, or ``unknown``."""
    e, out = extension(path), None
    for name, _, exts, *_ in FORMATS:
        out = F.when(e.isin(exts), name) if out is None else out.when(e.isin(exts), name)
    return out.otherwise("unknown")


def extension_supported(text: Column) -> Column:
    """Whether an extension, with a leading dot or without, is known."""
    return F.regexp_replace(F.lower(text), r"^\.", "").isin([e for f in FORMATS for e in f[2]])


def format_of_content(content: Column) -> Column:
    """The format by the first bytes; an Ogg page with an Opus head is opus."""
    head = lambda at, n: F.hex(F.substring(content, at, n))
    sync = (F.conv(head(1, 1), 16, 10) == 255) & (F.conv(head(2, 1), 16, 10).cast("int").bitwiseAND(F.lit(0xE0)) == 0xE0)
    page = F.hex(F.substring(content, 1, 512))
    return (
        F.when((head(1, 4) == "52494646") & (head(9, 4) == "57415645"), "wav")
        .when((head(1, 3) == "494433") | F.coalesce(sync, F.lit(False)), "mp3")
        .when(head(1, 4) == "664C6143", "flac")
        .when((head(1, 4) == "4F676753") & (F.instr(page, "4F70757348656164") > 0), "opus")
        .when(head(1, 4) == "4F676753", "ogg")
        .when(head(5, 4) == "66747970", "mp4")
        .otherwise("unknown")
    )


def status(size: Column) -> Column:
    """ok, or why a file cannot be decoded; null size: there is none."""
    return F.when(size.isNull(), "not_found").when(size == 0, "empty").when(size < LEAST_FILE, "too_small").otherwise("ok")


def strategy(size: Column) -> Column:
    return F.when(size <= IN_MEMORY, "in_memory").otherwise("streaming")


def chunk_count(size: Column, chunk: int = CHUNK) -> Column:
    return F.ceil(size / chunk).cast("long")


def chunks(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, idx, offset, length, is_last, total, progress: a row a chunk; empty files have none. Content is not read."""
    n = chunk_count(F.col("size"), chunk)
    rows = files.filter("size > 0").select("path", "size", n.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("idx"))
    offset = F.col("idx") * chunk
    return rows.select(
        "path", "idx", offset.alias("offset"), F.least(F.lit(chunk), F.col("size") - offset).cast("long").alias("length"),
        (F.col("idx") == F.col("total") - 1).alias("is_last"), "total", ((F.col("idx") + 1) / F.col("total")).alias("progress"),
    )


def with_content(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``chunks`` with their bytes: each file's content is cut where it is and travels once, in its parts."""
    n = F.octet_length("content")
    at = lambda i: F.substring(F.col("content"), (i * chunk + 1).cast("int"), F.lit(chunk))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), chunk_count(n, chunk) - 1), lambda i: F.struct(i.alias("idx"), at(i).alias("content")))
    rows = files.filter(n > 0).select("path", n.cast("long").alias("size"), chunk_count(n, chunk).alias("total"), F.explode(parts).alias("p"))
    return rows.select("path", "p.idx", (F.col("p.idx") * chunk).alias("offset"), F.octet_length("p.content").cast("long").alias("length"), (F.col("p.idx") == F.col("total") - 1).alias("is_last"), "total", F.col("p.content").alias("content"))


def reassemble(parts: DataFrame) -> DataFrame:
    """path, content: a file's chunks in order. A file has to fit a row; it is put together once, from its sorted chunks."""
    whole = F.array_sort(F.collect_list(F.struct("idx", F.hex("content").alias("digits"))))
    return parts.groupBy("path").agg(F.unhex(F.array_join(F.transform(whole, lambda c: c["digits"]), "")).alias("content"))


def decoded_bytes(size: Column, fmt: Column) -> Column:
    """Estimate of the memory that decoding takes."""
    return size * _by_format(fmt, 3, 10)


def over_limit(size: Column, fmt: Column, limit: int = DECODE_LIMIT) -> Column:
    return decoded_bytes(size, fmt) > limit


def chunk_size(size: Column, fmt: Column) -> Column:
    return F.floor(size / _by_format(fmt, 4, 100)).cast("long")


def mp4_chunk_size(size: Column) -> Column:
    small = F.round(F.greatest(F.lit(8192.0), F.least(F.lit(512.0 * KB), size * 0.4)))
    return F.when(size < 2 * MB, small).when(size < 100 * MB, 4.0 * MB).otherwise(8.0 * MB).cast("long")


def chunk_advice(size: Column, kind: str, memory: int | None = None) -> Column:
    """Bytes of a chunk for small files, large files, or a memory of so many bytes."""
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.round(x))).cast("long")
    if kind == "small":
        return clamp(size * 0.25, KB, MB)
    if kind == "large":
        return F.lit(10 * MB).cast("long")
    return clamp(F.lit(memory) * 0.1, KB, 10 * MB)


def waveform_bytes(points: Column) -> Column:
    return points * 8 + 1024


def audio_bytes(samples: Column) -> Column:
    return samples * 8 + 2048


def pressure(share: Column) -> Column:
    return F.when(share > 0.9, "critical").when(share > 0.8, "high").otherwise("normal")


def quality_advice(share: Column) -> Column:
    """struct<factor, streaming>: by how much to lower the resolution at a share of used memory; null if not."""
    make = lambda f, s: F.struct(F.lit(f).alias("factor"), F.lit(s).alias("streaming"))
    return F.when(share > 0.9, make(0.25, True)).when(share > 0.8, make(0.5, True)).when(share > 0.7, make(0.75, False))
