import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.errors import CorruptedFile, DecodingError, UnsupportedFormat
from tidegauge.functions import arrays, serde
from tidegauge.operators import geometry, stats
from tidegauge.plans import files as P
from tidegauge.sources import wav


@pytest.mark.parametrize("path,expected", [("audio.xyz", "unknown"), ("", "unknown"), ("filename", "unknown"), ("/path/to/filename", "unknown"), ("my.audio.file.mp3", "mp3"), ("version.1.0.wav", "wav"), ("/path.with.dots/audio.mp3", "mp3"), ("A.FLAC", "flac"), ("x.m4a", "mp4"), ("x.", "unknown")])
def test_format_by_path(spark, path, expected):
    assert spark.createDataFrame([(path,)], "p string").select(P.format_of(F.col("p"))).first()[0] == expected


@pytest.mark.parametrize("content,expected", [
    (b"RIFF\0\0\0\0WAVEfmt ", "wav"), (b"\xff\xfb\x90\x00" + b"\0" * 12, "mp3"), (b"ID3\x03" + b"\0" * 12, "mp3"), (b"fLaC" + b"\0" * 12, "flac"), (b"OggS" + b"\0" * 24 + b"\x01vorbis", "ogg"),
    (b"OggS" + b"\0" * 24 + b"OpusHead", "opus"), (b"\0\0\0\x20ftypisom", "mp4"), (b"\x12\x34\x56\x78" * 4, "unknown"), (b"", "unknown"),
])
def test_format_by_content(spark, content, expected):
    assert spark.createDataFrame([(content,)], "c binary").select(P.format_of_content(F.col("c"))).first()[0] == expected


@pytest.mark.parametrize("size,chunk,lengths", [(1024, 10240, [1024]), (25600, 10240, [10240, 10240, 5120]), (10240, 10240, [10240]), (20480, 10240, [10240, 10240]), (0, 10240, [])])
def test_chunks(spark, size, chunk, lengths):
    rows = P.chunks(spark.createDataFrame([("a", size)], "path string, size long"), chunk).orderBy("idx").collect()
    assert [r.length for r in rows] == lengths and [r.is_last for r in rows] == [k == len(lengths) - 1 for k in range(len(lengths))]


def test_chunks_come_back(spark):
    data = bytes(range(256))
    f = spark.createDataFrame([("a", data, 256)], "path string, content binary, size long")
    assert bytes(P.reassemble(P.with_content(f, 100)).first().content) == data
    assert P.chunk_count(F.lit(0)) is not None


@pytest.mark.parametrize("bits,tol", [(16, 1e-4), (24, 1e-6), (32, 1e-7)])
def test_wav_round_trip(spark, tmp_path, bits, tol):
    x = np.sin(np.arange(2000) * 0.05) * 0.9
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 8000, 2, bits))
    (tmp_path / "b.wav").write_bytes(b"RIFF....")
    rows = {r.path.rsplit("/", 1)[1]: r for r in wav.read_signals(spark, str(tmp_path)).collect()}
    a = rows["a.wav"]
    assert np.allclose(a.samples, x, atol=tol) and (a.sample_rate, a.channels, a.duration_us, a.error) == (8000, 2, 125000, None)
    assert rows["b.wav"].error == "corrupted"
    odd = spark.createDataFrame([("c.wav", b""), ("d.wav", None), ("e.xyz", b"text")], "path string, content binary")
    assert {r.path: r.error for r in wav.decode_files(odd).collect()} == {"c.wav": "decoding", "d.wav": "decoding", "e.xyz": "unsupported_format"}


def test_decoder_errors():
    with pytest.raises(DecodingError):
        wav.decode(b"")
    with pytest.raises(CorruptedFile):
        wav.decode(b"RIFX" + b"\0" * 60)
    with pytest.raises(UnsupportedFormat):
        wav.decoder_for("mp3")
    whole = wav.encode([0.1] * 100, 8000)
    assert len(wav.decode(whole[:-50])[0]) == 75


def test_header_checksum_and_concatenation(spark):
    c = wav.encode([0.0] * 800, 8000, 1, 16)
    h = wav.header(spark.createDataFrame([("a", c)], "path string, content binary")).first()
    assert (h.channels, h.sample_rate, h.bits, h.data_bytes, h.duration_ms) == (1, 8000, 16, 1600, 100)
    s = spark.createDataFrame([(b"\x01\x02\xff",)], "c binary").select(wav.checksum(F.col("c"))).first()[0]
    assert s == "00000102"
    parts = spark.createDataFrame([("a", 1, [0.3], 8000, 1), ("a", 0, [0.1, 0.2], 8000, 1)], "path string, idx int, samples array<double>, sample_rate int, channels int")
    assert wav.concatenate(parts).first().samples == [0.1, 0.2, 0.3]
    with pytest.raises(Exception, match="disagree"):
        wav.concatenate(parts.withColumn("sample_rate", F.col("idx") + 8000)).collect()


def test_large_file_is_decoded(spark, tmp_path):
    n = P.DECODE_LIMIT // 4 + 1000
    x = np.zeros((n, 2))
    x[-1] = 0.5, -0.5
    (tmp_path / "long.wav").write_bytes(wav.encode(x.ravel(), 44100, 2, 16))
    del x
    r = wav.read_signals(spark, str(tmp_path)).select("error", "channels", F.size("samples").alias("n"), F.slice("samples", -2, 2).alias("end")).first()
    assert (r.error, r.channels, r.n) == (None, 2, 2 * n) and np.allclose(r.end, [0.5, -0.5], atol=1e-4)


def test_checksum_of_whole_texts(spark, tmp_path):
    from tidegauge import queries

    texts = ["a" * 5000, "é漢😀" * 300, "", None, "z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.path: r.checksum for r in queries.QUERIES["byte_checksum"](spark, str(tmp_path)).collect()}
    assert got == {str(k): f"{sum((t or '').encode()):08x}" for k, t in enumerate(texts)}


def test_checksums_of_every_document_and_of_sources(spark, tmp_path):
    from tidegauge import queries

    texts = ["a" * 500, "é漢😀", "", None, "z", "a" * 500]
    rows = [(k, t, "xy"[k % 2]) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    of = lambda *ts: f"{sum(sum((t or '').encode()) for t in ts):08x}"
    assert {r.path: r.checksum for r in queries.QUERIES["byte_checksum_all"](spark, str(tmp_path)).collect()} == {str(k): of(t) for k, t in enumerate(texts)}
    assert {r.source: r.checksum for r in queries.QUERIES["byte_checksum_sources"](spark, str(tmp_path)).collect()} == {"x": of(*texts[::2]), "y": of(*texts[1::2])}


def test_checksums_of_documents_with_those_of_their_sources(spark, tmp_path):
    import duckdb

    from tidegauge import queries

    texts = ["a" * 500, "é漢😀", "", None, "z", "a" * 500, "y", "b"]
    sources = ["x", "y", "x", "y", None, "x", None, "only"]
    spark.createDataFrame(list(zip(range(8), texts, sources, strict=True)), "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    of = lambda *ts: f"{sum(sum((t or '').encode()) for t in ts):08x}"
    want = {(str(k), of(t), u, of(*[v for v, w in zip(texts, sources, strict=True) if w == u])) for k, (t, u) in enumerate(zip(texts, sources, strict=True))}
    rows = [(r.path, r.checksum, r.source, r.source_checksum) for r in queries.QUERIES["byte_checksum_all"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(queries.ORACLES["byte_checksum_all"])
    assert [c[0] for c in sql.description] == ["path", "checksum", "source", "source_checksum"]
    assert len(rows) == 8 and set(rows) == want == set(sql.fetchall())


def test_json(spark):
    row = spark.createDataFrame([([0.1, 0.5], "[0.1, 0.5, 0.8]", "no list")], "a array<double>, t string, u string")
    w = row.select(serde.waveform_from_json(serde.waveform_to_json(serde.waveform(F.col("a"), kind="odd"))).alias("w")).first().w
    assert w.amplitudes == [0.1, 0.5] and (w.duration, w.sampleRate, w.metadata.type, w.metadata.normalized) == (1_000_000, 44100, "bars", True)
    assert row.select(serde.amplitudes_from_text(F.col("t"))).first()[0] == [0.1, 0.5, 0.8]
    c = spark.createDataFrame([({"duration": "5"},)], "m map<string,string>").select(serde.container(F.col("m")).alias("c")).first().c
    assert tuple(c) == (5, 0, 0, "Unknown", 1)
    r = spark.sql("select 3L as n, 46000L as us, 128000L as b, 192000L as m, 0L as z").select(serde.sample_rate_estimate(F.col("n"), F.col("us")).alias("a"), serde.sample_rate_estimate(F.col("n"), F.col("z")).alias("b"), serde.bitrate_ratio(F.col("b"), F.col("m")).alias("c"), serde.bitrate_ratio(F.col("z"), F.col("m")).alias("d")).first()
    assert (round(r.a, 1), r.b, r.c, r.d) == (65.2, 0.0, 1.5, 1.0)


def test_statistics_and_profiler(spark):
    p = stats.Profiler()
    p.profile("fine", lambda: 1)
    with pytest.raises(ValueError):
        p.profile("broken", lambda: (_ for _ in ()).throw(ValueError("no")))
    rows = {r.name: r for r in stats.statistics(p.frame(spark)).collect()}
    assert (rows["fine"].n, rows["fine"].ok, rows["broken"].failure_rate) == (1, 1, 1.0)
    empty = stats.report(p.frame(spark).filter("false")).first()
    assert empty.total == 0 and math.isnan(empty.failure_rate) and p.export(spark).count() == 2


def test_memory_never_falls_below_zero(spark):
    rows = spark.createDataFrame([("a", 0, 50), ("a", 1, -80), ("a", 2, 95)], "track string, seq int, change long")
    assert [(r.used, r.level) for r in stats.memory_curve(rows, 100).orderBy("seq").collect()] == [(50, "normal"), (0, "normal"), (95, "critical")]


def test_geometry_edges(spark):
    lone = spark.sql("select 'a' as track, 0L as bin, 0.5D as amp")
    assert geometry.line(lone, 100, 50, 10).count() == 0 and geometry.filled(lone, 100, 50, 10).first().y == 12.5
    bar = geometry.bars(lone, 100, 0.0).first()
    assert (bar.h, bar.top, bar.played) == (25.0, 37.5, False)
    assert arrays.OF.keys() == {"rms", "peak", "average", "median"}


def test_chunks_of_samples(spark, tmp_path):
    x = np.sin(np.arange(5000) * 0.01) * 0.9
    for bits in (16, 24, 32):
        (tmp_path / f"{bits}.wav").write_bytes(wav.encode(x, 8000, 2, bits))
    extra = wav.encode(x, 8000, 2, 16)
    (tmp_path / "list.wav").write_bytes(extra[:36] + b"LIST" + (5).to_bytes(4, "little") + b"words\0" + extra[36:])
    (tmp_path / "none.wav").write_bytes(wav.encode([], 8000, 2))
    (tmp_path / "bad.wav").write_bytes(b"RIFF" + b"\0" * 60)
    rows = wav.read_chunks(spark, str(tmp_path), chunk_frames=700).orderBy("path", "idx").collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    for name in ("16.wav", "24.wav", "32.wav", "list.wav"):
        held = by[name]
        assert [r["first"] for r in held] == [0, 700, 1400, 2100] and [r.is_last for r in held] == [False] * 3 + [True] and {r.frames for r in held} == {2500}
        assert np.allclose(np.concatenate([r.samples for r in held]), x, atol=1e-4)
    assert by["bad.wav"][0].error == "corrupted" and by["none.wav"][0].samples == [] and by["none.wav"][0].is_last
    whole = {r.path: r.samples for r in wav.concatenate(wav.read_chunks(spark, str(tmp_path), 700, "16.wav")).collect()}
    assert np.allclose(*whole.values(), x, atol=1e-4)


def test_container_maps_come_back(spark):
    rows = [({"durationMicros": "7", "bitrate": "2", "audioTrackId": "3", "codecName": "aac"},), ({"duration": "5", "trackId": "4"},), ({},)]
    c = spark.createDataFrame(rows, "m map<string,string>").select(serde.container(F.col("m")).alias("c"))
    got = c.select("c", serde.container(serde.container_to_map(F.col("c"))).alias("again"), serde.container_to_map(F.col("c")).alias("m")).collect()
    assert [tuple(r.c) for r in got] == [(7, 2, 0, "aac", 3), (5, 0, 0, "Unknown", 4), (0, 0, 0, "Unknown", 1)] and all(r.c == r.again for r in got)
    assert got[0].m == {"durationMicros": "7", "bitrate": "2", "maxBitrate": "0", "codecName": "aac", "audioTrackId": "3"}


def test_duration_texts(spark):
    from tidegauge.functions.scalar import duration_text

    got = spark.createDataFrame([(0,), (225_000_001,), (36_000_000_000,), (-61_000_000,), (None,)], "us long").select(duration_text(F.col("us")).alias("t")).collect()
    assert [r.t for r in got] == ["0:00:00.000000", "0:03:45.000001", "10:00:00.000000", "-0:01:01.000000", None]


def test_size_texts_round_ties_to_even(spark):
    from tidegauge.functions.scalar import size_text

    sizes = [0, 1023, 1024, 6400, 6912, 7424, 1048575, 1048576 * 5 // 4, 1048576 * 7 // 4, (1 << 30) * 9 // 4, (1 << 53) + 1, *range(1024, 30_000, 77), *range(1 << 20, 1 << 22, 99_991), None]
    unit = lambda n: (1, "B") if n < 1 << 10 else (1 << 10, "KB") if n < 1 << 20 else (1 << 20, "MB") if n < 1 << 30 else (1 << 30, "GB")
    want = [None if n is None else f"{n}B" if n < 1024 else f"{n / unit(n)[0]:.1f}{unit(n)[1]}" for n in sizes]  # Python rounds ties of doubles to even
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "k int, n long").select("k", size_text(F.col("n")).alias("t")).collect()
    assert [t for _, t in sorted((r.k, r.t) for r in rows)] == want
    assert want[3:6] == ["6.2KB", "6.8KB", "7.2KB"]


def test_pattern_counts_take_contents_in_small_batches(spark):
    from tidegauge.sources import headers

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10_000)
    try:
        rows = spark.range(3000, numPartitions=1).selectExpr("cast(id as string) as path", "concat(X'FFFB', cast(repeat('x', cast(id % 900 as int)) as binary), X'FFFB') as content")
        got = {int(r.path): (r.mp3_frames, r.ogg_pages) for r in headers.count_patterns(rows).collect()}
        assert got == {k: (2 if k % 900 + 2 >= headers.FRAME_STEP else 1, 0) for k in range(3000)} and spark.conf.get(name) == "500"
    finally:
        spark.conf.set(name, before)
