"""FLAC: frames found and decoded wherever a byte range begins, and a writer.

Frames say themselves which samples they hold and end in a checksum, so a range of a file can be decoded
without what is before it: a task looks for the first sound frame of its range and goes on from there.
Residuals are unfolded per partition, fixed predictors are cumulative sums, and linear ones run over all
subframes of a batch at once.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import ConfigurationError, CorruptedFile, DecodingError

#: Fixed values of the format: block sizes, rates and sample widths by code; codes that are missing are read from the header's end or from the file's.
BLOCKS = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: Fixed predictors by order: what is subtracted from a sample, newest first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Bytes of the blocks in which the checksum of a frame is taken.
PART = 4096
#: Fewer subframes than these are predicted one by one.
FEW = 8


class Damaged(Exception):
    """No sound frame begins here."""


@dataclass(frozen=True)
class Info:
    """What a file says of its stream; ``total`` samples of each channel (0: unknown), where frames begin, bytes of the largest frame."""

    rate: int
    channels: int
    bits: int
    total: int
    block: int
    data_at: int
    largest: int


def info(file, length: int) -> Info:
    """The facts of a file of ``length`` bytes, by walking its metadata."""
    if not (head := file.read(4)):
        raise DecodingError("no data")
    if head != b"fLaC":
        raise CorruptedFile("no FLAC header")
    at, said = 4, None
    while at + 4 <= length:
        file.seek(at)
        kind, *size = file.read(4)
        size = int.from_bytes(bytes(size), "big")
        if kind & 127 == 0:
            body = file.read(34)
            if len(body) < 34:
                break
            packed = int.from_bytes(body[10:18], "big")
            said = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, int.from_bytes(body[2:4], "big"), int.from_bytes(body[7:10], "big"))
        at += 4 + size
        if kind & 128:
            if said is None or not said[0]:
                raise CorruptedFile("no stream information")
            rate, channels, bits, total, block, largest = said
            return Info(rate, channels, bits, total, block, at, largest or 64 + channels * (max(block, 16) * (bits + 1) // 8 + 8))
    raise CorruptedFile("metadata has no end")


@cache
def _sums() -> tuple[np.ndarray, np.ndarray]:
    """CRC-8 of a byte; what a byte adds to a CRC-16 that many bytes before the end."""
    def table(top: int, poly: int, shift: int) -> np.ndarray:
        x = np.arange(256, dtype=np.int64) << shift
        for _ in range(8):
            x = np.where(x & top, x << 1 ^ poly, x << 1) & (2 * top - 1)
        return x
    one = table(0x8000, 0x8005, 8).astype(np.uint16)
    far = np.empty((PART, 256), np.uint16)
    far[0] = one
    for k in range(1, PART):
        far[k] = far[k - 1] << 8 ^ one[far[k - 1] >> 8]
    return table(0x80, 0x07, 0), far


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_sums()[0][c ^ b])
    return c


def crc16(data: bytes) -> int:
    far, c = _sums()[1], 0
    for at in range(0, len(data), PART):
        part = np.frombuffer(data[at : at + PART], np.uint8)
        if len(part) == 1:
            c = (c << 8 & 0xFFFF) ^ int(far[0, part[0] ^ c >> 8])
            continue
        part = part.copy()
        part[:2] ^= np.array([c >> 8, c & 255], np.uint8)
        c = int(np.bitwise_xor.reduce(far[np.arange(len(part) - 1, -1, -1), part]))
    return c


class Bits:
    """Some bytes as bits, from the first one on."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        place = np.where(bits, np.arange(len(bits)), len(bits))
        self.next = memoryview(np.ascontiguousarray(np.minimum.accumulate(place[::-1])[::-1]))  # the first bit that is set, from each on
        self.padded = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(8, np.uint8))).astype(np.uint64)

    def take(self, n: int, signed: bool = False) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise Damaged("data ends")
        v = int.from_bytes(self.data[self.at >> 3 : end + 7 >> 3], "big") >> (-end & 7) & (1 << n) - 1
        self.at = end
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    def fields(self, places: np.ndarray, n: int) -> np.ndarray:
        """``n`` bits (32 at most) at each of ``places``."""
        at, shift = places >> 3, (places & 7).astype(np.uint64)
        v = np.zeros(len(places), np.uint64)
        for k in range(5):
            v = v << np.uint64(8) | self.padded[at + k]
        return (v >> (np.uint64(40 - n) - shift) & np.uint64((1 << n) - 1)).astype(np.int64)

    def many(self, count: int, n: int, signed: bool = True) -> np.ndarray:
        """``count`` numbers of ``n`` bits."""
        if self.at + count * n > 8 * len(self.data):
            raise Damaged("data ends")
        v = self.fields(self.at + n * np.arange(count), n) if n else np.zeros(count, np.int64)
        self.at += count * n
        return np.where(v >> max(0, n - 1) & 1, v - (1 << n), v) if signed and n else v

    def rice(self, count: int, k: int) -> np.ndarray:
        """``count`` numbers: zeros up to a one for the upper bits, ``k`` lower bits, signs folded in."""
        ends, p, after, top = [0] * count, self.at, self.next, len(self.next)
        try:
            for i in range(count):
                z = after[p]
                ends[i] = z
                p = z + 1 + k
        except IndexError:
            raise Damaged("data ends") from None
        if p > top:
            raise Damaged("data ends")
        ends = np.array(ends, np.int64)
        upper = ends - np.concatenate(([self.at], ends[:-1] + 1 + k)) if count else ends
        folded = upper << k | (self.fields(ends + 1, k) if k else 0)
        self.at = p
        return folded >> 1 ^ -(folded & 1)


@dataclass
class Subframe:
    order: int
    shift: int
    weights: tuple[int, ...]
    first: np.ndarray
    rest: np.ndarray
    wasted: int
    samples: np.ndarray | None = None


def _subframe(bits: Bits, block: int, width: int) -> Subframe:
    if bits.take(1):
        raise Damaged("a subframe begins with a one")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.next[bits.at] - bits.at + 1 if bits.at < len(bits.next) else 99
        bits.at += wasted
        width -= wasted
    if width < 1 or width > 32 + 1:
        raise Damaged("no such width")
    wide = lambda n: bits.many(n, width) if width <= 32 else np.array([bits.take(width, True) for _ in range(n)], np.int64)
    none = np.zeros(0, np.int64)
    if kind == 0:
        return Subframe(0, 0, (), none, none, wasted, np.full(block, wide(1)[0]))
    if kind == 1:
        return Subframe(0, 0, (), none, none, wasted, wide(block))
    if 8 <= kind <= 12:
        order, shift, weights = kind - 8, 0, FIXED[kind - 8]
    elif kind >= 32:
        order = kind - 31
    else:
        raise Damaged("no such subframe")
    if order > block:
        raise Damaged("order beyond block")
    first = wide(order)
    if kind >= 32:
        precision, shift = bits.take(4) + 1, bits.take(5, True)
        if precision == 16 or shift < 0:
            raise Damaged("no such predictor")
        weights = tuple(bits.take(precision, True) for _ in range(order))
    method, parts = bits.take(2), bits.take(4)
    if method > 1 or block % (1 << parts) or (block >> parts) < order:
        raise Damaged("no such residual")
    rest = []
    for k in range(1 << parts):
        n = (block >> parts) - (order if k == 0 else 0)
        low = bits.take(4 + method)
        rest.append(bits.many(n, bits.take(5)) if low == (15, 31)[method] else bits.rice(n, low))
    out = Subframe(order, shift, weights, first, np.concatenate(rest), wasted)
    if kind < 32:
        out.samples = _summed(first, out.rest)
    return out


def _summed(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Samples of which the first ones and the differences of that order are known."""
    heads, level = [], first
    for _ in range(len(first)):
        heads.append(level[0])
        level = np.diff(level)
    for head in reversed(heads):
        rest = head + np.concatenate(([0], np.cumsum(rest)))
    return rest


def predicted(subframes: list[Subframe]) -> None:
    """Fills in the samples of subframes with linear predictors, all of them side by side."""
    todo = [s for s in subframes if s.samples is None]
    if len(todo) < FEW:
        for s in todo:
            x, weights = s.first.tolist(), s.weights[::-1]
            for r in s.rest.tolist():
                x.append(r + (sum(map(mul, weights, x[-s.order :])) >> s.shift))
            s.samples = np.array(x, np.int64)
        return
    order, n = max(s.order for s in todo), max(s.order + len(s.rest) for s in todo)
    weights = np.array([[*s.weights[::-1]] if s.order == order else [0] * (order - s.order) + [*s.weights[::-1]] for s in todo], np.int64)
    shift, own = np.array([s.shift for s in todo]), np.array([s.order for s in todo])
    held = np.zeros((n + order, len(todo)), np.int64)  # a row a sample, behind as many empty ones as the order
    for k, s in enumerate(todo):
        held[order : order + s.order + len(s.rest), k] = np.concatenate((s.first, s.rest))
    weights = weights.T.copy()
    for i in range(n):
        guess = (weights * held[i : i + order]).sum(0) >> shift
        held[order + i] += guess if i >= order else np.where(i >= own, guess, 0)
    for k, s in enumerate(todo):
        s.samples = held[order : order + s.order + len(s.rest), k].copy()


@dataclass
class Frame:
    at: int
    first: int
    block: int
    mode: int
    bits: int
    parts: list[Subframe]
    end: int


def frame(data: bytes, at: int, of: Info, near: int = 0) -> Frame:
    """The frame that begins at byte ``at``; ``Damaged`` if none does. If it may have ``near`` bytes only, no more are looked at before that fails."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise Damaged("no mark")
    size, rate, mode, width = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    if size == 0 or rate == 15 or mode > 10 or width == 3 or head[3] & 1:
        raise Damaged("no such header")
    lead = head[4]
    more = 0 if lead < 0x80 else next((k for k in range(1, 7) if lead >> (6 - k) & 1 == 0), 99)
    if more == 99 or 0x80 <= lead < 0xC0 or len(head) < 6 + more:
        raise Damaged("no such number")
    number = lead if not more else lead & (1 << (6 - more)) - 1
    for b in head[5 : 5 + more]:
        if b & 0xC0 != 0x80:
            raise Damaged("no such number")
        number = number << 6 | b & 63
    p = 5 + more
    if size in (6, 7):
        block = int.from_bytes(head[p : p + size - 5], "big") + 1
        p += size - 5
    else:
        block = BLOCKS[size]
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if len(head) <= p or crc8(head[:p]) != head[p]:
        raise Damaged("header does not add up")
    bits = WIDTHS.get(width, of.bits)
    channels = mode + 1 if mode < 8 else 2
    if channels != of.channels or bits != of.bits:
        raise Damaged("another stream")
    most = max(of.largest, 64 + channels * (block * (bits + 1) // 8 + 8))
    side = {8: 1, 9: 0, 10: 1}.get(mode)
    for some in (near, most) if 0 < near < most else (most,):
        try:
            reader = Bits(data[at + p + 1 : at + some + 2])
            parts = [_subframe(reader, block, bits + (c == side)) for c in range(channels)]
            break
        except Damaged:
            if some == most:
                raise
    end = at + p + 1 + (reader.at + 7 >> 3)
    if end + 2 > len(data) or crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise Damaged("frame does not add up")
    return Frame(at, number if head[1] & 1 else number * of.block, block, mode, bits, parts, end + 2)


def samples(f: Frame) -> np.ndarray:
    """Whole numbers, a row a sample, a column a channel."""
    x = [s.samples << s.wasted for s in f.parts]
    if f.mode == 8:
        x[1] = x[0] - x[1]
    elif f.mode == 9:
        x[0] = x[0] + x[1]
    elif f.mode == 10:
        middle = x[0] << 1 | x[1] & 1
        x = [middle + x[1] >> 1, middle - x[1] >> 1]
    return np.stack(x, axis=1)


def frames(data: bytes, of: Info, begin: int, stop: int, whole: bool = False) -> list[Frame]:
    """The frames of ``data`` that begin from byte ``begin`` on and before ``stop``.

    Unless ``begin`` is known to be a frame's (``whole``), the first sound one is looked for. From there on frames
    have to follow one another without a gap.
    """
    out, at = [], begin
    while at < min(stop, len(data)):
        try:
            found = frame(data, at, of, (out[-1].end - out[-1].at) * 5 // 4 + 64 if out else 0)
            if out and found.first != out[-1].first + out[-1].block:
                raise Damaged("samples are missing")
            out.append(found)
            at = found.end
        except Damaged as e:
            if whole or out:
                raise CorruptedFile(f"byte {at}: {e}") from e
            at = next(_marks(data, at + 1, stop), stop)
    predicted([s for f in out for s in f.parts])
    return out


def between(file, of: Info, start: int, stop: int) -> tuple[int, np.ndarray]:
    """The first sample and all samples of the frames that begin in a range of bytes.

    The frame before the range is read as well: what follows it without a gap is complete.
    """
    at = max(of.data_at, start - of.largest)
    file.seek(at)
    data = file.read(stop - at + of.largest + 2)
    found = frames(data, of, 0, stop - at, whole=at == of.data_at)
    own = [f for f in found if at + f.at >= start]
    return (own[0].first if own else 0), (np.concatenate([samples(f) for f in own]) if own else np.zeros((0, of.channels), np.int64))


def first_of(file, of: Info, start: int, stop: int) -> int | None:
    """The first sample of the first frame that begins in a range of bytes; None if none does."""
    at = start
    while at < stop:
        file.seek(at)
        end = min(stop, at + of.largest)  # where a frame has to begin
        data = file.read(end - at + of.largest + 2)
        for k in [*([0] if at == of.data_at else []), *_marks(data, 0, end - at)]:
            try:
                return frame(data, k, of).first
            except Damaged:
                continue
        at = end
    return None


def length_of(file, of: Info, length: int) -> int:
    """Samples of a channel; where the file does not say so, its last frame does."""
    if of.total:
        return of.total
    at = max(of.data_at, length - 2 * of.largest)
    file.seek(at)
    data = file.read(length - at)
    last = frames(data, of, 0, len(data), whole=at == of.data_at)[-1:]
    return last[0].first + last[0].block if last else 0


def _marks(data: bytes, at: int, stop: int) -> Iterator[int]:
    while 0 <= (at := data.find(b"\xff", at, stop)):
        if at + 1 < len(data) and data[at + 1] & 0xFE == 0xF8:
            yield at
        at += 1


def floats(x: np.ndarray, bits: int) -> np.ndarray:
    """Interleaved samples within [-1, 1]."""
    return (x.ravel() / float(1 << (bits - 1))).astype(np.float32)


def decode(content: bytes) -> tuple[np.ndarray, int, int]:
    """Interleaved float samples, rate, channels of a whole file, every frame of which has to be sound."""
    of = info(io.BytesIO(content), len(content))
    found = frames(content, of, of.data_at, len(content), whole=True)
    x = np.concatenate([samples(f) for f in found]) if found else np.zeros((0, of.channels), np.int64)
    if of.total and len(x) != of.total:
        raise CorruptedFile(f"{len(x)} samples of {of.total}")
    return floats(x, of.bits), of.rate, of.channels


# --- writing


def _bits(values: np.ndarray | list[int], n: int) -> np.ndarray:
    """The lowest ``n`` bits of each value."""
    v = np.asarray(values, np.int64)[:, None]
    return (v >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8).ravel()


def _riced(x: np.ndarray, k: int) -> np.ndarray:
    folded = np.where(x < 0, -2 * x - 1, 2 * x)
    upper = folded >> k
    ends = np.cumsum(upper + 1 + k) - 1 - k
    out = np.zeros(int(ends[-1]) + 1 + k if len(x) else 0, np.uint8)
    out[ends] = 1
    for j in range(k):
        out[ends + 1 + j] = folded >> (k - 1 - j) & 1
    return out


def _residual(rest: np.ndarray, order: int, block: int) -> np.ndarray:
    parts = next(p for p in range(4, -1, -1) if block % (1 << p) == 0 and block >> p > order)
    cuts = np.split(rest, [(block >> parts) * k - order for k in range(1, 1 << parts)])
    out = [_bits([1], 2), _bits([parts], 4)]
    for c in cuts:
        mean = float(np.abs(c).mean()) if len(c) else 0.0
        k = max(0, int(np.log2(mean + 1)))
        if k > 29 or (len(c) and int(np.abs(c).max()) >> k > 1 << 16):  # too far apart for codes: plain numbers
            out += [_bits([31], 5), _bits([min(31, int(np.abs(c).max()).bit_length() + 1)], 5), _bits(c, min(31, int(np.abs(c).max()).bit_length() + 1))]
        else:
            out += [_bits([k], 5), _riced(c, k)]
    return np.concatenate(out)


def _linear(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, int]:
    """Weights of a linear predictor, newest sample first, as whole numbers, and their shift."""
    f = x.astype(float)
    lag = np.array([f[: len(f) - k] @ f[k:] for k in range(order + 1)])
    lag[0] = lag[0] * (1 + 1e-9) + 1e-9
    w = np.linalg.solve(lag[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))], lag[1:])
    shift = int(np.clip(precision - 1 - np.ceil(np.log2(np.abs(w).max() + 1e-12) + 1e-9), 0, 15))
    top = 1 << (precision - 1)
    return np.clip(np.round(w * (1 << shift)), -top, top - 1).astype(np.int64), shift


def _coded(x: np.ndarray, width: int, order: int) -> np.ndarray:
    """A subframe: constant or plain where that is less, else fixed orders 0 to 4, or a linear predictor of ``order``."""
    wasted = 0
    if x.any():
        while not (x & 1).any():
            x, wasted = x >> 1, wasted + 1
    width -= wasted
    tail = _bits([1], 1) if not wasted else None
    mark = lambda kind: np.concatenate((_bits([kind], 7), np.zeros(1, np.uint8) if tail is not None else np.concatenate((np.ones(1, np.uint8), _bits([1], wasted)))))
    if (x == x[0]).all():
        return np.concatenate((mark(0), _bits(x[:1], width)))
    plain = np.concatenate((mark(1), _bits(x, width)))
    if order > 4 and len(x) > 2 * order:
        w, shift = _linear(x, order)
        ahead = np.lib.stride_tricks.sliding_window_view(x, order)[:-1] @ w[::-1]
        rest = x[order:] - (ahead >> shift)
        made = [mark(31 + order), _bits(x[:order], width), _bits([11], 4), _bits([shift], 5), _bits(w, 12), _residual(rest, order, len(x))]
    else:
        near = [np.diff(x, k) for k in range(min(5, len(x)))]
        best = min(range(len(near)), key=lambda k: float(np.abs(near[k]).mean()) if len(near[k]) else float("inf"))
        made = [mark(8 + best), _bits(x[:best], width), _residual(near[best], best, len(x))]
    made = np.concatenate(made)
    return made if len(made) < len(plain) else plain


def encode(values: np.ndarray, rate: int, channels: int = 1, bits: int = 16, block: int = 4096, order: int = 0, mode: int | None = None) -> bytes:
    """A FLAC file of interleaved whole samples. ``order`` above 4 asks for linear predictors; ``mode`` 8, 9 or 10 codes a difference of two channels."""
    if bits not in WIDTHS.values() or not 1 <= channels <= 8 or order > 32 or (mode is not None and channels != 2) or not 0 < rate < 1 << 16 or not 16 <= block <= 1 << 16:
        raise ConfigurationError("no such stream")
    x = np.asarray(values, np.int64)
    x = x[: len(x) // channels * channels].reshape(-1, channels)
    mode = channels - 1 if mode is None else mode
    packed = rate << 44 | channels - 1 << 41 | bits - 1 << 36 | len(x)
    size = max(16, min(block, 1 << 16 - 1))
    out = [b"fLaC\x80\0\0\x22", size.to_bytes(2, "big") * 2, bytes(6), packed.to_bytes(8, "big"), bytes(16)]
    for number, at in enumerate(range(0, len(x), block)):
        part = x[at : at + block]
        rows = [part[:, c] for c in range(channels)]
        side = {8: 1, 9: 0, 10: 1}.get(mode)
        if mode >= 8:
            left, right = rows
            rows = {8: [left, left - right], 9: [left - right, right], 10: [left + right >> 1, left - right]}[mode]
        coded = [number] if number < 0x80 else None
        if coded is None:
            n = next(k for k in range(1, 7) if number < 1 << (5 * k + 6))
            coded = [(0xFF << (7 - n) & 0xFF) | number >> 6 * n, *[0x80 | number >> 6 * k & 63 for k in range(n - 1, -1, -1)]]
        head = bytes([0xFF, 0xF8, 7 << 4 | 13, mode << 4 | next(k for k, w in WIDTHS.items() if w == bits) << 1, *coded]) + (len(part) - 1).to_bytes(2, "big") + rate.to_bytes(2, "big")
        head += bytes([crc8(head)])
        body = head + np.packbits(np.concatenate([_coded(r, bits + (c == side), order) for c, r in enumerate(rows)])).tobytes()
        out.append(body + crc16(body).to_bytes(2, "big"))
    return b"".join(out)


def encode_bytes(files: DataFrame, rate: int = 8000, order: int = 8) -> DataFrame:
    """path, content: FLAC files of contents whose bytes are samples of 8 bits without sign, of as many channels as the column says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode(np.frombuffer(x.as_py() or b"", np.uint8).astype(np.int64) - 128, rate, c, 8, order=order) for c, x in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return files.select("path", "channels", "content").mapInArrow(run, "path string, content binary")
