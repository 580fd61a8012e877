import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.config import WaveformConfig
from tidegauge.engine import Engine, format_code, format_name
from tidegauge.errors import BY_CODE, Disposed, SignalError, UnsupportedFormat, from_code
from tidegauge.sources import flac, headers, wav


def test_waveforms_of_files(spark, tmp_path):
    x = np.sin(np.arange(8000) * 0.1) * np.linspace(0, 1, 8000)
    (tmp_path / "up.wav").write_bytes(wav.encode(x, 8000))
    (tmp_path / "stereo.wav").write_bytes(wav.encode(x, 8000, 2))
    (tmp_path / "none.wav").write_bytes(wav.encode([], 8000))
    (tmp_path / "song.MP3").write_bytes(b"ID3" + b"\0" * 60)
    (tmp_path / "bad.wav").write_bytes(b"RIFF" + b"\0" * 60)
    with Engine(spark, WaveformConfig(20)) as e:
        rows = {r.path.rsplit("/", 1)[1]: r for r in e.waveforms(str(tmp_path)).collect()}
        up = rows["up.wav"].amplitudes
        assert len(up) == 20 and up[-1] == 1.0 and up == sorted(up)
        assert (rows["stereo.wav"].error, rows["none.wav"].error, rows["bad.wav"].error, rows["song.MP3"].error) == (None, "invalid_waveform", "corrupted", "unsupported_format")
        two = x.reshape(-1, 2).mean(1)
        want = np.array([np.sqrt(np.mean(two[k * 200 : k * 200 + 200] ** 2)) for k in range(20)])
        assert np.allclose(rows["stereo.wav"].amplitudes, want / want.max(), atol=1e-3)
        assert e.waveforms_json(str(tmp_path)).count() == 2
        # Files read in ranges give what whole ones give.
        ranged = {r.path.rsplit("/", 1)[1]: r for r in e.waveforms(str(tmp_path), large=0).collect()}
        assert ranged.keys() == rows.keys()
        for name, r in rows.items():
            assert (ranged[name].error, ranged[name].duration_us, ranged[name].sample_rate) == (r.error, r.duration_us, r.sample_rate)
            assert r.amplitudes is None or np.allclose(ranged[name].amplitudes, r.amplitudes, atol=1e-9)
        assert e.is_supported("a.b.MP3") and not e.is_supported("a")
        with pytest.raises(UnsupportedFormat):
            e.waveforms("/x/y.xyz")
        assert e.environment().count() == 5 and e.formats().count() == 6
    with pytest.raises(Disposed):
        e.formats()


def test_pressure_callbacks_never_break(spark):
    heard = []
    e = Engine(spark)
    e.on_pressure(lambda level: 1 / 0)
    e.on_pressure(heard.append)
    assert [e.check_memory(x, 100) for x in (50, 85, 95)] == ["normal", "high", "critical"] and heard == ["high", "critical"]


def test_codes():
    assert all(format_name(format_code(f)) == f for f in ("mp3", "wav", "mp4")) and format_name(99) == "unknown"
    assert isinstance(from_code("corrupted"), BY_CODE["corrupted"]) and type(from_code("new")) is SignalError


def test_headers(spark):
    rows = [("a_small_x.mp3", b"\xff\xfb\x90\x64" + b"\0" * 413 + b"\xff\xfb"), ("corrupted_b.ogg", b"OggS\0\2" + b"\0" * 5000 + b"OggS"), ("c", b"\xff"), ("d", None)]
    f = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.mp3_frames, r.ogg_pages) for r in headers.count_patterns(f).collect()}
    assert got == {"a_small_x.mp3": (2, 0), "corrupted_b.ogg": (0, 2), "c": (0, 0), "d": (0, 0)}
    m = {r.path: r.m for r in f.select("path", headers.mp3_header(F.col("content")).alias("m")).collect()}
    assert (m["a_small_x.mp3"].version, m["a_small_x.mp3"].layer, m["a_small_x.mp3"].bitrate_index) == (3, 1, 9) and m["c"] is None and m["d"] is None
    assert headers.damaged(f).first().path == "corrupted_b.ogg"
    assert {r.size_tag for r in headers.listing(f).collect()} == {"small", ""} and sum(r.n for r in headers.listed(f).collect()) == 4
    x = f.select("path", headers.signature_matches(F.col("content"), F.lit("MP3")).alias("s")).collect()
    assert {r.path: r.s for r in x} == {"a_small_x.mp3": True, "corrupted_b.ogg": False, "c": False, "d": False}


def test_seek_past_the_end(spark):
    frames = spark.range(1000).selectExpr("'a' as track", "id as frame", "1000L as frames", "0D as v")
    assert wav.seek(frames, 500, 1000).count() == 500 and wav.seek(frames, 5000, 1000).count() == 100


def test_files_are_listed_once_for_all_parts(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.wav").write_bytes(wav.encode(np.sin(np.arange(900 + k)), 8000))
        (tmp_path / f"{k}.flac").write_bytes(flac.encode(np.arange(900) % 77 + k, 8000))
    e, c = Engine(spark), WaveformConfig(20)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("binaryFile")
    whole, streamed = e.waveforms(str(tmp_path), c), e.waveforms(str(tmp_path), c, large=0)
    assert scans(whole) <= 2 and scans(streamed) <= 1  # what is read in ranges was planned before
    of = lambda df: {r.path: ([round(a, 6) for a in r.amplitudes], r.duration_us, r.error) for r in df.collect()}
    assert len(of(whole)) == 6 and of(whole) == of(streamed)
