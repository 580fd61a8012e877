"""PCM audio in RIFF/WAVE files: header facts from a few bytes, decoding in tasks, a writer, a decoder registry."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import ConfigurationError, CorruptedFile, DecodingError, SignalError, UnsupportedFormat
from ..functions.arrays import mixdown
from ..operators.ordered import shared_path
from ..plans.files import FORMATS, format_of
from . import flac

SIGNALS = "path string, samples array<float>, sample_rate int, channels int, duration_us long, error string"


def encode(samples: np.ndarray, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """A WAVE file of interleaved samples; integer widths round and then clamp, 32 bits are floats."""
    x = np.asarray(samples, np.float64)
    if bits == 32:
        data, kind = x.astype("<f4").tobytes(), 3
    elif bits in (16, 24):
        top = 1 << (bits - 1)
        v = np.clip(np.round(x * (top - 1)), -top, top - 1).astype("<i4")
        data = v.astype("<i2").tobytes() if bits == 16 else v.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        kind = 1
    else:
        raise ConfigurationError("bits must be 16, 24 or 32")
    block = channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, channels, rate, rate * block, block, bits) + b"data" + struct.pack("<I", len(data)) + data


@dataclass(frozen=True)
class Facts:
    """What a WAVE file's chunks say: PCM kind, channels, rate, bits, where its data begins and how many bytes of it there are."""

    kind: int
    channels: int
    rate: int
    bits: int
    data_at: int
    data_bytes: int

    @property
    def block(self) -> int:
        return max(1, self.channels * (self.bits // 8))


def facts(file: BinaryIO, length: int) -> Facts:
    """Facts of a file of ``length`` bytes, read by walking its chunks; a data chunk that promises more than there is has what there is."""
    head = file.read(12)
    if not head:
        raise DecodingError("no data")
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise CorruptedFile("no RIFF/WAVE header")
    at, fmt = 12, None
    while at + 8 <= length:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            body = file.read(min(size, 40))
            if len(body) < 16:
                raise CorruptedFile("format chunk is too short")
            fmt = struct.unpack_from("<HHIIHH", body)
            if fmt[0] == 0xFFFE and len(body) >= 26:
                fmt = (struct.unpack_from("<H", body, 24)[0], *fmt[1:])
        elif name == b"data":
            if fmt is None:
                raise CorruptedFile("data before format")
            if not fmt[1] or not fmt[2]:
                raise CorruptedFile("no channels or no rate")
            return Facts(fmt[0], fmt[1], fmt[2], fmt[5], at + 8, min(size, length - at - 8))
        at += 8 + size + size % 2
    raise CorruptedFile("no data chunk")


def pcm(raw: bytes, kind: int, bits: int) -> np.ndarray:
    """Float samples of PCM bytes; an incomplete last sample is ignored."""
    raw = raw[: len(raw) - len(raw) % max(1, bits // 8)]
    if (kind, bits) == (1, 16):
        return np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    if (kind, bits) == (1, 8):
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if (kind, bits) == (1, 24):
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    if (kind, bits) == (1, 32):
        return (np.frombuffer(raw, "<i4") / float(1 << 31)).astype(np.float32)
    if (kind, bits) == (3, 32):
        return np.frombuffer(raw, "<f4")
    raise DecodingError(f"PCM kind {kind} with {bits} bits")


def decode(content: bytes) -> tuple[np.ndarray, int, int]:
    """Interleaved float samples, rate, channels of a whole file."""
    f = facts(io.BytesIO(content), len(content))
    return pcm(content[f.data_at : f.data_at + f.data_bytes], f.kind, f.bits), f.rate, f.channels


#: Decoders by format; more are added with ``register``.
DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, int, int]]] = {"wav": decode, "flac": flac.decode}


def register(fmt: str, decoder: Callable[[bytes], tuple[np.ndarray, int, int]]) -> None:
    """Adds a decoder: bytes to interleaved samples, rate, channels. It travels to the tasks with the job."""
    DECODERS[fmt] = decoder


def decoder_for(fmt: str) -> Callable[[bytes], tuple[np.ndarray, int, int]]:
    if fmt not in DECODERS:
        raise UnsupportedFormat(fmt)
    return DECODERS[fmt]


def decode_files(files: DataFrame, trim: int = 0) -> DataFrame:
    """path, samples, sample_rate, channels, duration_us, error of files with path and content.

    A file that cannot be decoded has null samples and the code of its error, so it does not end the
    job. ``trim`` frames of encoder delay are dropped from the start. Files of any size are decoded, each
    in one task, so a file and its samples have to fit a row.
    """
    decoders = dict(DECODERS)

    fields = pa.schema([("path", pa.string()), ("samples", pa.list_(pa.float32())), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("duration_us", pa.int64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for path, fmt, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                samples = rate = channels = us = error = None
                try:
                    raw = content.as_py()
                    if fmt not in decoders:
                        raise UnsupportedFormat(fmt)
                    samples, rate, channels = decoders[fmt](raw or b"")
                    samples = np.asarray(samples[trim * channels :], np.float32)
                    us = round(len(samples) / rate * 1e6 / channels)
                    held += samples.nbytes
                except SignalError as e:
                    error = e.code
                except Exception:  # whatever a registered decoder does
                    samples = rate = channels = us = None
                    error = DecodingError.code
                rows.append((path, samples, rate, channels, us, error))
                if held >= BATCH_BYTES or len(rows) >= BATCH_CHUNKS:
                    yield _columns(rows, fields)
                    rows, held = [], 0
        if rows:
            yield _columns(rows, fields)

    return files.select("path", format_of(F.col("path")).alias("format"), "content").mapInArrow(run, SIGNALS)


#: Names of audio files, as a pattern of Spark's reader.
AUDIO = "*.{" + ",".join(e for f in FORMATS for x in f[2] for e in (x, x.upper())) + "}"


FILE = "path string, modificationTime timestamp, length long, content binary"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def create_file(path: str) -> BinaryIO:
    """A new file on any file system that Arrow knows."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return system.open_output_stream(at)


def write_files(files: DataFrame, folder: str, opener: Callable[[str], BinaryIO] = create_file) -> int:
    """Writes each row's ``content`` to ``path`` below ``folder``, which has to be there, and says how many there are. A task that runs again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with opener(f"{folder}/{path}") as out:
                    out.write(content.as_py() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0  # one row


def read_signals(spark: SparkSession, path: str, pattern: str = AUDIO, least: int = 0, most: int | None = None) -> DataFrame:
    """Decoded signals of the files below ``path`` of ``least`` to ``most`` bytes; Spark's reader lists no empty files, so those are missing."""
    files = _files(spark, path, pattern).filter(F.col("length") >= least)
    files = files if most is None else files.filter(F.col("length") <= most)
    return decode_files(files.select("path", "content"))


CHUNKS = "path string, idx int, is_last boolean, first long, frames long, sample_rate int, channels int, samples array<float>, error string"
PLANNED = "path string, idx int, is_last boolean, first long, frames long, sample_rate int, channels int, kind int, bits int, at long, size long, length long, error string"
#: The kind of planned chunks of FLAC files, beside those of PCM.
FLAC = -1
#: Bytes of samples and rows of an Arrow batch of chunks, about.
BATCH_BYTES, BATCH_CHUNKS = 1 << 20, 1000


def open_file(path: str) -> BinaryIO:
    """A seekable file on any file system that Arrow knows."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return system.open_input_file(at)


def _columns(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def _planned(name: str, length: int, chunk_frames: int, opener: Callable[[str], BinaryIO]) -> list[tuple]:
    with opener(name) as file:
        if name.lower().endswith(".flac"):
            of = flac.info(file, length)
            n, step = flac.length_of(file, of, length), max(1, chunk_frames * of.channels * of.bits // 8)
            starts = range(of.data_at, max(of.data_at + 1, length), step)
            return [(name, k, at + step >= length, None, n, of.rate, of.channels, FLAC, of.bits, at, min(step, length - at), length, None) for k, at in enumerate(starts)]
        f = facts(file, length)
    n = f.data_bytes // f.block
    starts = range(0, max(1, n), chunk_frames)
    return [(name, k, at + chunk_frames >= n, at, n, f.rate, f.channels, f.kind, f.bits, f.data_at + at * f.block, min(chunk_frames, n - at) * f.block, length, None) for k, at in enumerate(starts)]


def plan_chunks(spark: SparkSession, path: str, chunk_frames: int = 1 << 20, pattern: str = "*.{wav,WAV,flac,FLAC}", least: int = 0, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """What ``read_planned`` is to read: a row a chunk. Spark lists names and sizes, and a task reads a file's headers."""
    return _plan(_files(spark, path, pattern).filter(F.col("length") >= least), chunk_frames, opener)


def _plan(files: DataFrame, chunk_frames: int, opener: Callable[[str], BinaryIO]) -> DataFrame:
    listed = files.select("path", "length")  # contents are not read
    fields = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for c, t in (x.split() for x in PLANNED.split(", "))])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for name, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += _planned(name, length, chunk_frames, opener)
                except SignalError as e:
                    rows.append((name, 0, True, 0, 0, *[None] * 6, length, e.code))
                if len(rows) >= BATCH_CHUNKS:
                    yield _columns(rows, fields)
                    rows = []
            if rows:
                yield _columns(rows, fields)

    return listed.mapInArrow(plan, PLANNED)


def planned_once(planned: DataFrame) -> DataFrame:
    """A plan that is used more than once, written to the shared folder: files are listed and their headers read this one time."""
    path = shared_path(planned.sparkSession, "planned")
    _dealt(planned).write.mode("overwrite").parquet(path)
    return planned.sparkSession.read.schema(planned.schema).parquet(path)


def _dealt(planned: DataFrame) -> DataFrame:
    """Chunks over all tasks. Rows of a plan are small and the work behind them is not, so Spark must not merge partitions by their bytes: their number is given."""
    return planned.repartition(int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "idx")


def read_planned(planned: DataFrame, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """The chunks of a plan: see ``read_chunks``. They leave a task in batches of about BATCH_BYTES."""
    fields = pa.schema([
        ("path", pa.string()), ("idx", pa.int32()), ("is_last", pa.bool_()), ("first", pa.int64()), ("frames", pa.int64()), ("sample_rate", pa.int32()), ("channels", pa.int32()),
        ("samples", pa.list_(pa.float32())), ("error", pa.string()),
    ])

    def one(r: dict) -> tuple[int, np.ndarray]:
        with opener(r["path"]) as file:
            if r["kind"] == FLAC:
                of = flac.info(file, r["length"])
                first, x = flac.between(file, of, r["at"], r["at"] + r["size"])
                return first, flac.floats(x, of.bits)
            file.seek(r["at"])
            return r["first"], pcm(file.read(r["size"]), r["kind"], r["bits"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                samples, error = None, r["error"]
                if error is None:
                    try:
                        r["first"], samples = one(r)
                        held += samples.nbytes
                    except SignalError as e:
                        error = e.code
                rows.append((*[r[c] for c in fields.names[:7]], samples, error))
                if held >= BATCH_BYTES or len(rows) >= BATCH_CHUNKS:
                    yield _columns(rows, fields)
                    rows, held = [], 0
        if rows:
            yield _columns(rows, fields)

    return _dealt(planned).mapInArrow(read, CHUNKS)


def index(planned: DataFrame, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """A plan in which every chunk says its first frame, FLAC chunks, too: the header of the first frame of each range is read.

    Written as a table beside the files it is what ``seek_chunks`` needs. A range in which no frame begins has the
    first frame of the range after it, or the file's number of frames.
    """
    schema = planned.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                if r["kind"] == FLAC and r["error"] is None:
                    with opener(r["path"]) as file:
                        r["first"] = flac.first_of(file, flac.info(file, r["length"]), r["at"], r["at"] + r["size"])
            yield pa.RecordBatch.from_pylist(rows, b.schema)

    found = _dealt(planned).mapInArrow(run, schema)
    w = W.partitionBy("path").orderBy("idx").rowsBetween(W.currentRow, W.unboundedFollowing)
    return found.withColumn("first", F.coalesce(F.first("first", True).over(w), "frames"))  # a row a chunk


def seek_chunks(indexed: DataFrame, ms: int | Column, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """The chunks of an index from a time on, the first one cut to it; a time past the end gives the last 100 ms. Chunks before it are not read."""
    begin = F.floor(F.lit(ms) * F.col("sample_rate") / 1000).cast("long")
    begin = F.when(begin >= F.col("frames"), F.greatest(F.lit(0), F.col("frames") - F.floor(F.col("sample_rate") / 10))).otherwise(begin).cast("long")
    after = F.lead("first").over(W.partitionBy("path").orderBy("idx"))
    left = indexed.withColumn("_from", begin).withColumn("_after", F.coalesce(after, "frames")).filter(F.col("error").isNotNull() | (F.col("_after") > F.col("_from")))
    rows = read_planned(left.select(*indexed.columns), opener).join(left.select(F.col("path").alias("_path"), F.col("idx").alias("_idx"), "_from"), (F.col("path") == F.col("_path")) & (F.col("idx") == F.col("_idx")))
    over = F.greatest(F.lit(0).cast("long"), F.col("_from") - F.col("first"))
    cut = F.when(over > 0, F.slice("samples", (over * F.col("channels") + 1).cast("int"), F.size("samples"))).otherwise(F.col("samples"))
    return rows.select("path", "idx", "is_last", (F.col("first") + over).alias("first"), "frames", "sample_rate", "channels", cut.alias("samples"), "error")


def read_chunks(spark: SparkSession, path: str, chunk_frames: int = 1 << 20, pattern: str = "*.{wav,WAV}", least: int = 0, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """path, idx, is_last, first, frames, sample_rate, channels, samples, error: PCM and FLAC files in chunks, for files of any size.

    A range of ``chunk_frames`` whole frames is read by whichever task it falls to; of a FLAC file, a range of
    as many bytes as these would be as PCM, and the frames of the codec that begin in it. ``samples`` are interleaved,
    ``first`` is the chunk's first frame of ``frames``. A file that cannot be read is one row with its
    error, a damaged range a chunk with its own; a file without frames is one empty chunk. ``opener`` gives a seekable file for a path.
    """
    return read_planned(plan_chunks(spark, path, chunk_frames, pattern, least, opener), opener)


def files_of(total: int, least: int = 64, most: int = 10_000, batches: int = 16) -> int:
    """Files to a batch of a stream over ``total`` files: about ``batches`` batches, but none of fewer than ``least`` or more than ``most`` files, whose names the driver holds."""
    return max(least, min(most, -(-total // batches)))


def stream_chunks(spark: SparkSession, path: str, chunk_frames: int = 1 << 20, pattern: str = "*.{wav,WAV,flac,FLAC}", files: int = 1000, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """The same as a stream: files that come to the folder are read, ``files`` to a batch, each one to its end (``is_last``).

    Spark's checkpoint knows which files a query has read, so a query that goes on from its checkpoint reads each
    file once. Files have to be moved into the folder when they are complete. A batch costs about a second whatever is in
    it, so many small files that are there already go in few batches: ``files_of`` says how many to a batch.
    """
    stream = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files)
    return read_planned(_plan(stream.load(path), chunk_frames, opener), opener)


def chunk_frames(chunks: DataFrame) -> DataFrame:
    """track, frame, frames, v of chunks: a row a frame, channels mixed to their mean where the chunk is, as it holds whole frames."""
    rows = chunks.filter("error is null and frames > 0")
    mixed = mixdown(F.col("samples"), F.col("channels"))
    return rows.select(F.col("path").alias("track"), "first", "frames", F.posexplode(mixed).alias("i", "v")).select("track", (F.col("first") + F.col("i")).alias("frame"), "frames", "v")


def header(files: DataFrame) -> DataFrame:
    """path, kind, channels, sample_rate, bits, data_bytes, data_at, duration_ms: facts by walking a file's chunks, without decoding; null where there are none."""
    names = ["path", "kind", "channels", "sample_rate", "bits", "data_bytes", "data_at", "duration_ms"]

    def one(content: bytes | None) -> tuple:
        try:
            f = facts(io.BytesIO(content or b""), len(content or b""))
        except SignalError:
            return (None,) * 7
        return f.kind, f.channels, f.rate, f.bits, f.data_bytes, f.data_at, f.data_bytes * 8000 // (f.rate * f.channels * f.bits) if f.bits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(c.as_py()) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, " + ", ".join(f"{c} long" for c in names[1:]))


def checksum_of_all(checksums: Column) -> Column:
    """The checksum of many contents one after another, from theirs: the sum modulo 2**32 again."""
    total = F.sum(F.conv(checksums, 16, 10).cast("decimal(38,0)")) % F.lit(1 << 32)
    return F.lpad(F.lower(F.hex(F.coalesce(total, F.lit(0)).cast("long"))), 8, "0")


def checksum(content: Column) -> Column:
    """Sum of all bytes modulo 2**32 as eight hex digits; null of null."""

    @F.pandas_udf("string")
    def summed(held: pd.Series) -> pd.Series:
        return held.map(lambda b: None if b is None else f"{int(np.frombuffer(b, np.uint8).sum(dtype=np.uint64)) % (1 << 32):08x}")

    return summed(content)


def seek(frames: DataFrame, ms: int, rate: int) -> DataFrame:
    """Frames from a time on; a time past the end gives the last 100 ms."""
    first = F.least(F.lit(ms * rate // 1000), F.greatest(F.lit(0), F.col("frames") - rate // 10))
    return frames.filter(F.col("frame") >= F.when(F.lit(ms * rate // 1000) >= F.col("frames"), first).otherwise(F.lit(ms * rate // 1000)))


def concatenate(chunks: DataFrame) -> DataFrame:
    """path, samples, sample_rate, channels of chunk rows (idx, samples); chunks that disagree on rate or channels fail the query."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.raise_error(F.lit(f"chunks disagree on {c}")))
    parts = F.array_sort(F.collect_list(F.struct("idx", "samples")))
    return chunks.groupBy("path").agg(F.flatten(F.transform(parts, lambda p: p["samples"])).alias("samples"), one("sample_rate").alias("sample_rate"), one("channels").alias("channels"))


def tones(spark: SparkSession, tracks: int, seconds: float, rate: int, channels: int = 1) -> DataFrame:
    """path, frame, channel, v: 0.5 (1 + 0.3 sin 2t) sin(2 pi (440 + 220 channel) t), the louder the higher the track's number."""
    n = int(seconds * rate)
    t = F.col("frame") / rate
    v = 0.5 * (1 + 0.3 * F.sin(2 * t)) * F.sin(2 * np.pi * (440 + 220 * F.col("channel")) * t) * (F.col("track") + 1) / tracks
    rows = spark.range(tracks * n * channels).select(F.floor(F.col("id") / (n * channels)).alias("track"), F.floor(F.col("id") / channels % n).alias("frame"), (F.col("id") % channels).alias("channel"))
    return rows.select(F.format_string("tone_%03d.wav", "track").alias("path"), "frame", "channel", v.alias("v"))


def harmonics(frame: Column, channel: Column, rate: int) -> Column:
    """A tone of three partials with a slow swell, within [-1, 1]."""
    t = frame / rate
    f = 2 * np.pi * (440 + 220 * channel) * t
    v = (0.5 * F.sin(f) + 0.25 * F.sin(2 * f) + 0.125 * F.sin(3 * f)) * (1 + 0.3 * F.sin(2 * t)) * 0.7
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))


def encode_rows(rows: DataFrame, rate: int, channels: int, bits: int = 16) -> DataFrame:
    """path, content: a file of each path's rows (frame, channel, v within [-1, 1]), FLAC where the path says so, else WAVE. A file is one row, so it is gathered whole."""
    each = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "channel", "v"))), lambda x: x["v"]).alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = []
            for path, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x, top = np.array(v.as_py(), np.float64), 1 << (bits - 1)
                whole = path.lower().endswith(".flac")
                files.append(flac.encode(np.clip(np.round(x * (top - 1)), -top, top - 1), rate, channels, bits) if whole else encode(x, rate, channels, bits))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.binary())], names=["path", "content"])

    return each.mapInArrow(run, "path string, content binary")
