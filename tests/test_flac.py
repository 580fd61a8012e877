"""FLAC: a published example, exact round trips, ranges, damage; and whole against streamed files."""

import hashlib
import io
import struct

import numpy as np
import pytest

from tidegauge.config import WaveformConfig
from tidegauge.engine import Engine
from tidegauge.errors import ConfigurationError, CorruptedFile, DecodingError
from tidegauge.sources import flac, wav

#: The first example file of the format's standard (RFC 9639, appendix D), with one sample of two channels.
EXAMPLE = bytes.fromhex("664c6143800000221000100000000f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a")


def test_published_example():
    of = flac.info(io.BytesIO(EXAMPLE), len(EXAMPLE))
    (f,) = flac.frames(EXAMPLE, of, of.data_at, len(EXAMPLE), whole=True)
    x = flac.samples(f)
    assert (of.rate, of.channels, of.bits, of.total) == (44100, 2, 16, 1)
    # The file has an MD5 of what it decodes to.
    assert hashlib.md5(struct.pack("<2h", *x[0])).digest() == EXAMPLE[26:42]


def signals():
    r = np.random.default_rng(1)
    t = np.arange(10_000)
    return {
        "sine": (np.sin(t * 0.05) * 20_000 + r.normal(0, 20, len(t))).astype(int), "noise": r.integers(-32768, 32768, len(t)), "zero": np.zeros(len(t), int),
        "even": r.integers(-100, 100, len(t)) * 8, "ramp": t % 3000 - 1000, "spike": np.where(t % 997 == 0, 30_000, 0),
    }


@pytest.mark.parametrize("name", signals())
@pytest.mark.parametrize("order", [0, 8, 32])
def test_round_trips(name, order):
    x = signals()[name]
    for channels, mode in ((1, None), (2, None), (2, 8), (2, 9), (2, 10), (3, None)):
        for bits, y in ((16, x), (24, x * 200), (8, x >> 8)):
            file = flac.encode(y, 44100, channels, bits, block=1152 if bits == 24 else 4096, order=order, mode=mode)
            got, rate, n = flac.decode(file)
            want = y[: len(y) // channels * channels] / float(1 << (bits - 1))
            assert (rate, n) == (44100, channels) and np.array_equal(got, want.astype(np.float32))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 15, 16, 17, 4096, 4097])
def test_lengths(n):
    assert np.array_equal(flac.decode(flac.encode(np.arange(n), 8000))[0], (np.arange(n) / 32768).astype(np.float32))


def test_many_frames_have_numbers_of_several_bytes():
    x = np.arange(16 * 3000) % 100
    assert np.array_equal(flac.decode(flac.encode(x, 8000, block=16))[0], (x / 32768).astype(np.float32))


def test_ranges_give_what_the_whole_gives():
    x = signals()["sine"]
    file = flac.encode(x, 44100, 2, 16, block=256, order=8)
    of = flac.info(io.BytesIO(file), len(file))
    for step in (100, 777, 5000, 10**6):
        parts = [flac.between(io.BytesIO(file), of, at, min(len(file), at + step)) for at in range(of.data_at, len(file), step)]
        at = 0
        for first, rows in parts:
            assert not len(rows) or first == at
            at += len(rows)
        assert np.array_equal(np.concatenate([rows for _, rows in parts]).ravel(), x)


def test_damage_is_found_in_the_range_that_has_it():
    x = signals()["sine"]
    file = flac.encode(x, 44100, 1, 16, block=256)
    of = flac.info(io.BytesIO(file), len(file))
    found = flac.frames(file, of, of.data_at, len(file), whole=True)
    for k in (0, 3, 20, len(found) - 1):
        bad = bytearray(file)
        bad[(found[k].at + found[k].end) // 2] ^= 4
        bad = bytes(bad)
        with pytest.raises(CorruptedFile):
            flac.decode(bad)
        for step in (300, 1500, 7000):
            errors = 0
            for at in range(of.data_at, len(bad), step):
                try:
                    flac.between(io.BytesIO(bad), of, at, min(len(bad), at + step))
                except CorruptedFile:
                    errors += 1
            assert errors >= 1, (k, step)
    for broken, error in ((b"", DecodingError), (b"fLaX" + bytes(50), CorruptedFile), (file[:30], CorruptedFile), (file[:-9], CorruptedFile), (b"fLaC\x84\0\0\0", CorruptedFile)):
        with pytest.raises(error):
            flac.decode(broken)
    with pytest.raises(ConfigurationError):
        flac.encode([1], 8000, 9)


def names(rows):
    return {r.path.rsplit("/", 1)[1]: r for r in rows}


def test_chunks_of_flac_files(spark, tmp_path):
    x = signals()["sine"]
    (tmp_path / "a.flac").write_bytes(flac.encode(x, 8000, 2, 16, block=128))
    (tmp_path / "b.FLAC").write_bytes(b"fLaC" + bytes(60))
    (tmp_path / "c.wav").write_bytes(wav.encode(x / 32767, 8000, 2))
    rows = wav.read_chunks(spark, str(tmp_path), 600, "*.{flac,FLAC,wav}").orderBy("path", "idx").collect()
    a = [r for r in rows if r.path.endswith("a.flac")]
    assert len(a) > 5 and [r.is_last for r in a] == [False] * (len(a) - 1) + [True] and {r.frames for r in a} == {5000}
    assert np.array_equal(np.concatenate([r.samples for r in a]), (x / 32768).astype(np.float32))
    assert [r.first for r in a if r.samples] == np.concatenate(([0], np.cumsum([len(r.samples) // 2 for r in a if r.samples])[:-1])).tolist()
    assert [r.error for r in rows if r.path.endswith("b.FLAC")] == ["corrupted"]
    framed = wav.chunk_frames(wav.read_chunks(spark, str(tmp_path), 600, "*.{flac,wav}"))
    assert framed.groupBy("frame", "v").count().filter("count <> 2").count() == 0
    assert framed.groupBy("track").count().collect()[0]["count"] == 5000


@pytest.mark.parametrize("config", [WaveformConfig(1000), WaveformConfig(1000, short="zero_fill"), WaveformConfig(40, smooth=True, window=5, curve="sqrt"), WaveformConfig(7, algorithm="median", normalization="rms")])
def test_whole_and_streamed_files_are_alike(spark, tmp_path, config):
    """Files of fewer, as many and more frames than bins, of one channel and of two, of both formats."""
    r = np.random.default_rng(2)
    for n in (1, 7, 40, 999, 1000, 1001, 5000):
        for channels in (1, 2):
            x = r.integers(-20_000, 20_000, n * channels)
            (tmp_path / f"w{n}_{channels}.wav").write_bytes(wav.encode(x / 32767, 8000, channels))
            (tmp_path / f"f{n}_{channels}.flac").write_bytes(flac.encode(x, 8000, channels, block=256))
    (tmp_path / "none.flac").write_bytes(flac.encode([], 8000))
    bad = bytearray(flac.encode(r.integers(-9, 9, 5000), 8000))
    bad[len(bad) // 2] ^= 1
    (tmp_path / "bad.flac").write_bytes(bytes(bad))
    e = Engine(spark, config)
    whole, streamed = names(e.waveforms(str(tmp_path)).collect()), names(e.waveforms(str(tmp_path), large=0).collect())
    assert len(whole) == 30 and whole.keys() == streamed.keys()
    for name, w in whole.items():
        s = streamed[name]
        assert (w.error, w.duration_us, w.sample_rate) == (s.error, s.duration_us, s.sample_rate), name
        assert (w.amplitudes is None) == (s.amplitudes is None) and (w.amplitudes is None or np.allclose(w.amplitudes, s.amplitudes, atol=1e-9, equal_nan=True)), name  # roots of signed samples
    assert whole["bad.flac"].error == "corrupted" and whole["none.flac"].error == "invalid_waveform"


def test_a_failing_decoder_is_a_row(spark):
    wav.register("mp3", lambda content: 1 / 0)
    try:
        rows = wav.decode_files(spark.createDataFrame([("a.mp3", b"x")], "path string, content binary")).collect()
    finally:
        del wav.DECODERS["mp3"]
    assert [(r.samples, r.error) for r in rows] == [(None, "decoding")]


class Counted(io.BytesIO):
    """A file that counts the bytes that are read."""

    read_bytes = 0

    def read(self, *a):
        out = super().read(*a)
        Counted.read_bytes += len(out)
        return out


def test_frames_are_found_without_what_is_before():
    x = signals()["sine"]
    file = flac.encode(np.tile(x, 10), 44100, 1, 16, block=256)
    of = flac.info(io.BytesIO(file), len(file))
    found = flac.frames(file, of, of.data_at, len(file), whole=True)
    for start, stop in ((of.data_at, len(file)), (5000, 9000), (len(file) - 300, len(file)), (found[5].at, found[5].at + 1), (found[5].at + 1, found[5].at + 3)):
        want = next((f.first for f in found if start <= f.at < stop), None)
        Counted.read_bytes = 0
        assert flac.first_of(Counted(file), of, start, stop) == want
        assert Counted.read_bytes < 5 * of.largest


@pytest.mark.parametrize("ms", [0, 3, 77, 600, 10_000])
def test_seeking_reads_the_tail_only(spark, tmp_path, ms):
    x = signals()["sine"]
    for n in (40, 9_000, 10_000):
        (tmp_path / f"a{n}.flac").write_bytes(flac.encode(x[:n], 8000, 2, 16, block=64))
        (tmp_path / f"b{n}.wav").write_bytes(wav.encode(x[:n] / 32767, 8000, 2))
    (tmp_path / "bad.flac").write_bytes(b"fLaC" + bytes(60))
    opened = spark.sparkContext.accumulator(0)

    def opener(path):
        file = wav.open_file(path)
        opened.add(1)
        return file

    indexed = wav.index(wav.plan_chunks(spark, str(tmp_path), 300))
    total = indexed.count()
    rows = wav.seek_chunks(indexed, ms, opener).collect()
    assert [r.error for r in rows if r.path.endswith("bad.flac")] == ["corrupted"]
    for n in (40, 9_000, 10_000):
        frames, begin = n // 2, ms * 8
        begin = max(0, frames - 800) if begin >= frames else begin
        for name in (f"a{n}.flac", f"b{n}.wav"):
            own = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.idx)
            assert np.array_equal(np.concatenate([r.samples for r in own]), (x[2 * begin : n] / 32768).astype(np.float32)), name
            assert own[0].first == begin and own[-1].is_last
    assert ms or opened.value == total - 1
    assert ms < 500 or opened.value < total / 2


def test_marks_over_chunks(spark):
    import random

    from tidegauge.plans import files as P
    from tidegauge.sources import headers

    r = random.Random(3)
    pieces = [b"\xff\xfb", b"\xff", b"\xff\xe0", b"OggS", b"Og", b"gS", b"x" * 50, b"y" * 413, b"z" * 4000]
    rows = [(f"f{k}", b"".join(r.choice(pieces) for _ in range(r.randrange(80)))) for k in range(30)] + [("none", b"plain")]
    files = spark.createDataFrame(rows, "path string, content binary")
    want = {tuple(x) for x in headers.count_patterns(files.filter("octet_length(content) > 0")).collect()}
    for size in (3, 100, 5000):
        assert {tuple(x) for x in headers.count_in_chunks(P.with_content(files, size), 1000 if size == 3 else 1 << 20).collect()} == want


def test_bytes_of_texts_as_samples(spark):
    texts = ["", "a", "some words, é漢😀 " * 400, "x" * 9000]
    files = spark.createDataFrame([(f"{k}.flac", k % 2 + 1, t.encode()) for k, t in enumerate(texts)], "path string, channels int, content binary")
    got = {r.path: r for r in wav.decode_files(flac.encode_bytes(files)).collect()}
    for k, t in enumerate(texts):
        x = np.frombuffer(t.encode(), np.uint8).astype(int) - 128
        assert got[f"{k}.flac"].samples == [v / 128 for v in x[: len(x) // (k % 2 + 1) * (k % 2 + 1)].tolist()]
