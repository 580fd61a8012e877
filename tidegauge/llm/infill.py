"""Fill-in-the-middle: texts cut at two places and put together anew between sentinels.

A table over bytes does the reading: its states say how many continuation bytes of a character are still
to come and how much of a sentinel has been seen, and each transition says whether it begins a unit and
whether it completes a sentinel. One scan counts both. It runs over many lanes of a text at once, from every
state in which a lane may begin; the lanes' maps from first to last state are then composed, which tells where each
really began. A second pass runs the lanes that hold the cuts again, to find the bytes at which they lie.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of the texts that are changed, and of these, percent with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of a lane, and of what is scanned at once, a multiple of it.
LANE, BLOCK = 128, 1 << 19
#: Stands behind a lane's last byte: changes no state and counts nothing.
PAD = 256


@dataclass(frozen=True)
class Table:
    """Next state, whether a unit begins (0 or 1) and the number of the sentinel completed (from 1, else 0), by symbol and state; state 0 is the first."""

    states: int
    step: np.ndarray
    begins: np.ndarray
    hit: np.ndarray


@cache
def table(sentinels: tuple[str, ...] = SENTINELS) -> Table:
    """The table of some ASCII sentinels. A byte that continues no character is a unit of its own."""
    marks = [s.encode() for s in sentinels]
    if not all(marks) or any(max(m) > 127 for m in marks) or len(set(marks)) < len(marks):
        raise ValueError("sentinels are different ASCII strings that are not empty")
    seen = sorted({m[:k] for m in marks for k in range(len(m))}, key=lambda p: (len(p), p))  # what may have been seen of a sentinel
    number = {p: k for k, p in enumerate(seen)}
    states = len(seen) + 3  # and 1 to 3 continuation bytes to come
    step, begins, hit = np.zeros((PAD + 1, states), np.int16), np.ones((PAD + 1, states), np.uint8), np.zeros((PAD + 1, states), np.uint8)
    waits = lambda k: len(seen) + k - 1
    for state in range(states):
        had = seen[state] if state < len(seen) else b""
        for byte in range(256):
            if byte >= 0xC2:
                step[byte, state] = waits(1 if byte < 0xE0 else 2 if byte < 0xF0 else 3) if byte < 0xF5 else 0
            elif 0x80 <= byte < 0xC0 and state >= len(seen):
                step[byte, state], begins[byte, state] = 0 if state == waits(1) else state - 1, 0
            elif byte < 0x80:
                now = had + bytes([byte])
                ends = [k for k, m in enumerate(marks) if now.endswith(m)]
                hit[byte, state] = ends[0] + 1 if ends else 0
                if not ends:
                    step[byte, state] = number[next(now[k:] for k in range(len(now) + 1) if now[k:] in number)]
    step[PAD], begins[PAD] = np.arange(states), 0
    return Table(states, step.ravel(), begins.ravel(), hit.ravel())


class Scan:
    """Texts read once: ``units`` of each, ``hits`` (text -> places behind sentinels, with their numbers), and what ``places`` needs to find units again."""

    def __init__(self, texts: list[bytes], of: Table) -> None:
        self.of, self.texts = of, texts
        self.units = np.zeros(len(texts), np.int64)
        self.hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.lanes: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint8))] * len(texts)  # units before each lane, its first state
        held, total = [], 0
        for k, t in enumerate(texts):
            if len(t) > BLOCK:
                self._long(k)
                continue
            held.append(k)
            total += len(t) + LANE
            if total >= BLOCK:
                self._read([(j, texts[j]) for j in held], 0)
                held, total = [], 0
        if held:
            self._read([(j, texts[j]) for j in held], 0)

    def _long(self, k: int) -> None:
        state, parts, t = 0, [], self.texts[k]
        for at in range(0, len(t), BLOCK):
            state = self._read([(k, t[at : at + BLOCK])], state, at)
            parts.append(self.lanes[k])
        self.lanes[k] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _read(self, pieces: list[tuple[int, bytes]], state: int, at: int = 0) -> int:
        """Scans pieces, of which each begins in ``state``; gives the state after the last one."""
        t, n = self.of, np.array([-(-len(p) // LANE) for _, p in pieces])
        first = np.concatenate(([0], np.cumsum(n)))
        symbols = np.full((int(first[-1]), LANE), PAD, np.int16)
        flat = symbols.ravel()
        for (_, p), f in zip(pieces, first, strict=False):
            flat[f * LANE : f * LANE + len(p)] = np.frombuffer(p, np.uint8)
        columns = np.ascontiguousarray(symbols.T) * np.int16(t.states)
        # From every state: where does a lane that begins there end?
        ends = np.broadcast_to(np.arange(t.states, dtype=np.int16), (len(symbols), t.states)).copy()
        for c in columns:
            ends = t.step[ends + c[:, None]]
        heads = first[:-1][n > 0]
        ends[heads] = ends[heads, state][:, None]
        far = 1
        while far < len(ends):
            ends[far:] = np.take_along_axis(ends[far:], ends[:-far].astype(np.int64), 1)
            far *= 2
        begin = np.concatenate(([state], ends[:-1, 0])).astype(np.int16) if len(ends) else np.zeros(0, np.int16)
        begin[heads] = state
        # From the state in which it did begin: how many units begin in a lane, and which sentinels end there?
        now, counts, found = begin.copy(), np.zeros(len(symbols), np.int64), []
        for w, c in enumerate(columns):
            i = now + c
            counts += t.begins[i]
            if (h := t.hit[i]).any():
                found += [(int(lane), w, int(h[lane])) for lane in np.flatnonzero(h)]
            now = t.step[i]
        before = np.concatenate(([0], np.cumsum(counts)))
        for (k, _), f, z in zip(pieces, first, first[1:], strict=False):
            self.lanes[k] = (before[f:z] - before[f] + self.units[k], begin[f:z].astype(np.uint8))
        for (k, _), f, z in zip(pieces, first, first[1:], strict=False):
            self.units[k] += before[z] - before[f]
        owner = np.searchsorted(first, [lane for lane, _, _ in found], "right") - 1 if found else []
        for (lane, w, mark), j in sorted(zip(found, owner, strict=True)):
            self.hits[pieces[j][0]].append((at + (lane - int(first[j])) * LANE + w + 1, mark))
        return int(ends[-1, 0]) if len(ends) else state

    def places(self, asks: list[tuple[int, int]]) -> list[int]:
        """The byte at which unit ``u`` of text ``k`` begins, for each (k, u); a text's length behind its last unit."""
        t, out = self.of, [len(self.texts[k]) for k, _ in asks]
        within = [j for j, (k, u) in enumerate(asks) if u < self.units[k]]
        for some in (within[j : j + 4096] for j in range(0, len(within), 4096)):
            lane = [int(np.searchsorted(self.lanes[asks[j][0]][0], asks[j][1], "right")) - 1 for j in some]
            symbols = np.full((len(some), LANE), PAD, np.int16)
            for row, j, x in zip(symbols, some, lane, strict=True):
                p = self.texts[asks[j][0]][x * LANE : (x + 1) * LANE]
                row[: len(p)] = np.frombuffer(p, np.uint8)
            now = np.array([self.lanes[asks[j][0]][1][x] for j, x in zip(some, lane, strict=True)], np.int16)
            left = np.array([asks[j][1] - self.lanes[asks[j][0]][0][x] for j, x in zip(some, lane, strict=True)])
            for w, c in enumerate(np.ascontiguousarray(symbols.T) * np.int16(t.states)):
                i = now + c
                begun = t.begins[i] > 0
                for r in np.flatnonzero(begun & (left == 0)):
                    out[some[r]] = lane[r] * LANE + w
                left -= begun
                now = t.step[i]
        return out


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, ...]:
    """Four numbers of 32 bits that hang on seed and id alone."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8))


def _cut(ids: list, texts: list[bytes], marks: tuple[str, ...], rate: int, suffix_first: int, seed: int) -> Iterator[tuple]:
    scan, asks, plans = Scan(texts, table(marks)), [], []
    for k, i in enumerate(ids):
        n, h = int(scan.units[k]), draws(i, seed)
        if not n or k in scan.hits or h[2] % 100 >= rate:
            plans.append((n, "plain", None, None))
            continue
        a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        asks += [(k, a), (k, z)]
        plans.append((n, "spm" if h[3] % 100 < suffix_first else "psm", a, z - a))
    p, s, m = (x.encode() for x in marks)
    at = iter(scan.places(asks))
    for t, (n, form, a, middle) in zip(texts, plans, strict=True):
        if form == "plain":
            yield n, form, None, None, t
            continue
        x, y = next(at), next(at)
        parts = (p, t[:x], s, t[y:], m, t[x:y]) if form == "psm" else (s, t[y:], p, t[:x], m, t[x:y])
        yield n, form, a, middle, b"".join(parts)


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def transform(docs: DataFrame, sentinels: tuple[str, ...] = SENTINELS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row a document, whatever its text's length.

    A text of n characters is cut behind the smaller and the larger of two places drawn from the id. ``form``
    is ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or ``plain``, which leaves texts as they are: those that
    are empty or null, those that hold a sentinel, and 100 - ``rate`` percent of all. ``output`` is the new text as
    bytes. Equal ids and texts give equal rows, and rows that share an id are cut at the same draws; a null
    id draws as one without digits. Bytes that are no UTF-8 count one each. No rows give no rows;
    other columns are not carried along.
    """
    table(tuple(sentinels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, held in B.slices((t.as_py() or b"" for t in b.column(1)), 1 << 20):
                rows = list(_cut(b.column(0).slice(first, len(held)).to_pylist(), held, tuple(sentinels), rate, suffix_first, seed))
                n, form, a, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), pa.array(n, pa.int64()), pa.array(form), pa.array(a, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            B.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, OUT)


def restore(cut: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """The rows of ``transform`` with ``restored``, the text before it, from ``output`` and ``form`` alone: the first of each sentinel tells the parts. Null of null."""
    p, s, m = (1 + k for k in range(3))
    marks, names = tuple(sentinels), [c for c in cut.columns if c != "restored"]
    schema = cut.select(*names, F.col("output").alias("restored")).schema

    def whole(t: bytes | None, form: str | None, hits: list[tuple[int, int]]) -> bytes | None:
        if t is None or form == "plain":
            return t
        behind = {k: at for at, k in reversed(hits)}
        before = {k: behind[k] - len(marks[k - 1]) for k in behind}
        prefix, suffix = ((p, s), (s, m)) if form == "psm" else ((p, m), (s, p))
        part = lambda x: t[behind[x[0]] : before[x[1]]]
        return part(prefix) + t[behind[m] :] + part(suffix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, held in B.slices((t.as_py() or b"" for t in b.column("output")), 1 << 20):
                part, scan = b.slice(first, len(held)), Scan(held, table(marks))
                texts = part.column("output")
                rows = [whole(None if texts[k].as_py() is None else t, f, scan.hits.get(k, [])) for k, (t, f) in enumerate(zip(held, part.column("form").to_pylist(), strict=True))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.binary())], names=[*names, "restored"])
            B.release()

    return cut.select(*names).mapInArrow(run, schema)
