"""Packing token sequences by patterns of lengths.

Documents longer than a sequence are cut; what is left is a histogram of piece lengths, at most one
entry a length whatever the corpus. On a coarse grid of lengths every pattern of a few pieces that fills a
sequence is enumerated, and non-negative least squares fits how often each pattern repeats to the
histogram. The counts are rounded and filled with real lengths, the last two of which close the sequence
exactly; small pieces and what remains are packed best fit. All of this works on counts, so its cost does
not depend on the number of documents. The plan is a table of slots (length, first rank, sequence,
offset); each piece finds its slot by its rank among the pieces of its length, and ranks come from
distributed prefix sums.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import batches as B
from .common import cut
from .ngrams import _BYTES, _powers
from .suffixes import pair

#: Pieces of less than one part in so many of a sequence take no part in patterns.
SMALL = 16
#: Steps of a sequence to which lengths are rounded when patterns are enumerated, and the most pieces of a pattern.
GRIDS = ((64, 5), (32, 6))
BUCKET_BITS = 10
#: Of a worker's table of words: slots as a power of two, of which two thirds are used at most, and ids; a full one is emptied,
#: and words that would not fit an empty one are not kept. What a slice of texts needs never depends on it.
SLOTS, POOL = 21, 1 << 23


#: Texts on which a tokenizer shows whether it encodes words on their own, in lower case, apart from stops behind them.
PROBES = (
    "Plain words, UPPER Words; and MiXed: ones! Are they? Yes.", "  two  blanks\nlines\n\n\nends \n", "caf\u00e9 CAF\u00c9. \u00dcber stra\u00dfe, \u0130stanbul \u0131 \u0178",
    "a.b,c don't stop... wait?!, 12,5 3.14 x1 1x #tag @me", "word.word Word.Word ,,, . ; :", "\u6f22\u5b57 \u6f22 kana\u304b \U0001f600! emoji\U0001f600", "e\u0301 combining A\u030a \u1e9e \ufb01n", "", " ", "\n", "<|endoftext|> </s> [CLS] word",
)


class _Table:
    """Word fingerprint -> ids, in flat arrays with open addressing: some thirty bytes a word."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << SLOTS, np.uint64)
        self.start, self.size = np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, np.int32)
        self.pool, self.used, self.held = np.zeros(1 << 18, np.uint32), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each fingerprint, -1 for one that is not there."""
        at, left = (h & np.uint64(len(self.keys) - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            key = self.keys[at[left]]
            gone, open_ = key == 0, (key != 0) & (key != h[left])
            at[left[gone]] = -1
            left = left[open_]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        return at

    def add(self, h: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Distinct new fingerprints with their ids end to end; when too much is held, all else is forgotten first, and more than fits is not kept."""
        if 3 * len(h) > 2 * len(self.keys) or len(ids) > POOL:
            return
        if 3 * (self.held + len(h)) > 2 * len(self.keys) or self.used + len(ids) > POOL:
            self.clear()
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        at, left = (h & np.uint64(len(self.keys) - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = h[free]
            left = left[self.keys[at[left]] != h[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        self.start[at], self.size[at] = self.used + begin, ends - begin
        self.used, self.held = self.used + len(ids), self.held + len(h)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots end to end, and where each one's end."""
        return _runs(self.pool, self.start[at], self.size[at].astype(np.int64))


def _runs(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``pool`` end to end, and where each one ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(start - (ends - size), size) + np.arange(total)], ends


class Encoder:
    """Texts to ids, by a table of words.

    Words are split at blanks and line ends, which the tokenizer never joins across. It lower-cases and
    splits letters from punctuation itself, so a Latin word with a tail of stops is its lower-case stem
    and its tail; what is still unknown in a slice of texts is encoded in one call. Words are told apart
    by 64-bit fingerprints.
    """

    #: A word of Latin letters (but the one whose lower case is no single letter) with stops behind it.
    LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,!?;:]*)").fullmatch

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(vocabulary), _Table()
        # Words can only be told apart so for a tokenizer that works so; any other one encodes whole texts.
        self.by_words = all(np.array_equal(x, y) for x, y in zip(self._by_words([t.encode() for t in PROBES]), self._plain([t.encode() for t in PROBES]), strict=True))
        self.words.clear()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        return self._by_words(texts) if self.by_words else self._plain(texts)

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]

    def _by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        start, stop, h = _fingerprints(data)
        distinct, first, of = np.unique(h, return_index=True, return_inverse=True)
        at = self.words.find(distinct)
        known, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        # The ids of this slice's words: copied from the table before it learns, as it may be emptied or too small for them.
        pool, ends = self.words.take(at[known])
        begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        size[known] = np.diff(ends, prepend=0)
        begin[known] = ends - size[known]
        if new.size:
            raw = data.tobytes()
            got, ends = self._learn([raw[a:z].decode() for a, z in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)], distinct[new])
            size[new] = np.diff(ends, prepend=0)
            begin[new] = len(pool) + ends - size[new]
            pool = np.concatenate((pool, got))
        ids, ends = _runs(pool, begin[of], size[of])
        ends = np.concatenate(([0], ends))
        edge = ends[np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))]
        return [ids[a:z] for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def _learn(self, words: list[str], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new words end to end, and where each one's end; the table gets them, too, if they fit."""
        parts = [(m[1].lower(), m[2]) if (m := self.LATIN(w)) else (w, "") for w in words]
        pieces = list({p for pair in parts for p in pair if p})
        data = np.frombuffer(" ".join(pieces).encode() + b" ", np.uint8)
        key = _fingerprints(data)[2]
        at = self.words.find(key)
        known = dict(zip([pieces[k] for k in np.flatnonzero(at >= 0).tolist()], np.flatnonzero(at >= 0).tolist(), strict=True))
        ids, ends = self.words.take(at[at >= 0])
        raw = ids.tobytes()
        cuts = (4 * ends).tolist()
        got = dict(zip(known, [raw[a:z] for a, z in zip([0, *cuts], cuts, strict=False)], strict=True)) | {"": b""}
        got |= self._encode([pieces[k] for k in np.flatnonzero(at < 0).tolist()])
        found = [got[a] + got[b] if b else got[a] for a, b in parts]
        # Stems are kept as the words that they are, unless they are among the new ones themselves.
        fresh = np.flatnonzero(at < 0)
        keys, one = np.unique(np.concatenate((h, key[fresh])), return_index=True)
        values = found + [got[pieces[k]] for k in fresh.tolist()]
        values = [values[k] for k in one.tolist()]
        self.words.add(keys, np.frombuffer(b"".join(values), "<u4"), np.cumsum([len(v) // 4 for v in values]))
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum([len(v) // 4 for v in found])

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Stems are one piece to the tokenizer each, so a text of them is numbered by word; other words are given one by one."""
        letters = [w for w in words if self.LATIN(w) and w[-1].isalpha()]
        found = self._cut(letters, self.tokenizer.encode(" ".join(letters), add_special_tokens=False)) if letters else {}
        rest = [w for w in words if w not in found]
        return found | self._cut(rest, self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)) if rest else found

    @staticmethod
    def _cut(words: list[str], got) -> dict[str, bytes]:
        ids, of = np.array(got.ids, dtype="<u4"), np.array(got.word_ids, dtype=np.int64)
        raw, ends = ids.tobytes(), (4 * np.searchsorted(of, np.arange(len(words)), side="right")).tolist()
        return dict(zip(words, [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)], strict=True))


def _fingerprints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and fingerprints (never 0) of the words between blanks and line ends; ``data`` ends with one."""
    space = (data == 0x20) | (data == 0x0A)
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stop = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    if not len(start):
        return start, stop, np.zeros(0, np.uint64)
    lens = stop - start
    inner = np.arange(len(data)) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(data)]))))
    value = _BYTES[data] * _powers(int(lens.max()) + 1)[np.minimum(inner, lens.max())]
    value[space] = 0
    return start, stop, pair(np.add.reduceat(value, start), lens.astype(np.uint64)) | np.uint64(1)


_loaded: dict[str, Encoder] = {}


def token_ids(texts: list[bytes], vocabulary: str) -> list[np.ndarray]:
    """The ids of each UTF-8 text without special tokens."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Encoder(vocabulary)
    return _loaded[vocabulary](texts)


def pieces(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with a closing 0, cut into pieces of ``length``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = schema.replace("doc_id long", f"doc_id {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            which, piece, start, size, crc = [], [], [], [], []
            encoded = ((first + k, got.tobytes() + b"\0\0\0\0") for first, held in B.slices(t.as_py() or b"" for t in texts.cast(pa.binary())) for k, got in enumerate(token_ids(held, vocabulary)))
            for k, got in encoded:
                for p, at in enumerate(range(0, len(got), 4 * length)):
                    part = got[at : at + 4 * length]
                    which.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(which, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
            B.release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _patterns(grid: int, depth: int) -> np.ndarray:
    """Counts by grid length (columns) of every multiset of up to ``depth`` lengths that adds up to the grid."""
    rows: list[list[int]] = []

    def extend(parts: list[int], left: int, most: int) -> None:
        if left == 0:
            rows.append(parts)
        elif len(parts) < depth:
            for x in range(min(left, most), 0, -1):
                if x * (depth - len(parts)) >= left:
                    extend([*parts, x], left - x, x)

    extend([], grid, grid)
    out = np.zeros((len(rows), grid + 1))
    for k, parts in enumerate(rows):
        np.add.at(out[k], parts, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes |a x - b| least: the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        grad = a.T @ (b - a @ x)
        grad[free] = -np.inf
        k = int(np.argmax(grad))
        if grad[k] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        free[k] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                x = s
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(histogram: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """Patterns of real lengths and how often each repeats; together they hold the histogram exactly.

    Of a few grids the plan with the fewest sequences is kept.
    """
    least, best = -(-sum(x * n for x, n in histogram.items()) // length), None
    for grid, depth in GRIDS:
        groups, _ = fit(histogram, length, grid, depth)
        n = sum(k for _, k in groups)
        if best is None or n < best[0]:
            best = n, groups
        if n == least:
            return groups
    return best[1]


def fit(histogram: dict[int, int], length: int, grid: int, depth: int) -> tuple[list[tuple[list[int], int]], int]:
    """One plan, and how many pieces of it the fitted patterns place; the rest goes best fit.

    Lengths are rounded to the nearest of ``grid`` steps, so that patterns are neither too full nor too
    empty on average. A repeat takes the longest pieces left of its steps but for the last two, which are
    chosen to fill the sequence to the end; repeats for which that cannot be are left to best fit.
    """
    left = np.zeros(length + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    step = -(-length // min(grid, length))
    grid = -(-length // step)
    cells = np.minimum(grid, (np.arange(length + 1) + step // 2) // step)
    want = np.bincount(cells, weights=left, minlength=grid + 1)
    small = grid // SMALL  # pieces of so many steps fill gaps later
    want[: small + 1] = 0
    shapes = _patterns(grid, depth)
    shapes = shapes[shapes[:, : small + 1].sum(1) == 0]
    # Cells weigh by their length: what stays over of the long pieces is the hardest to place.
    weight = np.sqrt(np.arange(grid + 1) / grid)
    repeats = np.round(nnls((shapes * weight).T, want * weight)).astype(np.int64) if want.sum() else np.zeros(len(shapes), np.int64)
    low = np.searchsorted(cells, np.arange(grid + 2))  # a cell's lengths: low[c] to low[c + 1] - 1
    groups: list[tuple[list[int], int]] = []
    placed = 0

    def longest(below: int, least: int, took: list[int]) -> int:
        """The longest length under ``below`` and from ``least`` on of which a piece is left beside those in ``took``; 0 if none."""
        for x in range(below - 1, least - 1, -1):
            if left[x] > 0 and left[x] > took.count(x):
                return x
        return 0

    def closing(gap: int, c: int, d: int, took: list[int]) -> list[int]:
        """Two lengths of the steps ``c`` and about ``d`` that fill ``gap`` exactly; a 0 if there are none."""
        near = range(max(1, int(low[max(0, d - 1)])), int(low[min(grid, d + 1) + 1]))
        for x in range(int(low[c + 1]) - 1, int(low[c]) - 1, -1):
            y = gap - x
            if y in near and left[x] > took.count(x) and left[y] > took.count(y) + (x == y):
                return [x, y]
        return [0]

    for k in np.argsort(-repeats * (shapes * np.arange(grid + 1)).max(1), kind="stable"):
        todo = int(repeats[k])
        parts = [c for c in range(grid, 0, -1) for _ in range(int(shapes[k][c]))]
        while todo > 0:
            took: list[int] = []
            for c in parts[:-2]:
                took.append(longest(int(low[c + 1]), int(low[c]), took))
            gap = length - sum(took)
            if len(parts) == 1:
                took.append(longest(length + 1, int(low[max(0, grid - 1)]), took))
            elif all(took):
                took += closing(gap, *parts[-2:], took)
            else:
                break
            if not all(took):
                break
            n = min(todo, *(int(left[x]) // took.count(x) for x in took))
            for x in took:
                left[x] -= n
            groups.append((took, n))
            placed += n * len(took)
            todo -= n
    # Best fit of the rest, longest first, over groups of sequences with the same gap.
    gaps: dict[int, list[tuple[list[int], int]]] = {}
    for took, n in groups:
        gaps.setdefault(length - sum(took), []).append((took, n))
    for x in range(length, 0, -1):
        while left[x]:
            gap = next((g for g in range(x, length) if gaps.get(g)), None)
            if gap is None:
                n = int(left[x]) if 2 * x > length else -(-int(left[x]) // (length // x))
                if n * x == 0:
                    break
                many = 1 if 2 * x > length else length // x
                full = int(left[x]) // many
                if full:
                    gaps.setdefault(length - many * x, []).append(([x] * many, full))
                if rest := int(left[x]) - full * many:
                    gaps.setdefault(length - rest * x, []).append(([x] * rest, 1))
                left[x] = 0
                break
            took, n = gaps[gap].pop()
            m = min(n, int(left[x]))
            if n > m:
                gaps[gap].append((took, n - m))
            gaps.setdefault(gap - x, []).append(([*took, x], m))
            left[x] -= m
    return [g for same in gaps.values() for g in same], placed


def slots(groups: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each length: the first rank of each run of slots, the run's first sequence, its offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for took, n in groups:
        at = 0
        for x in took:
            out.setdefault(x, []).append((used.get(x, 0), sequence, at))
            used[x] = used.get(x, 0) + n
            at += x
        sequence += n
    return {x: tuple(np.array(v, np.int64).T) for x, v in out.items()}


def pack(docs: DataFrame, vocabulary: str, length: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece.

    Every document has at least its closing 0, so empty and null texts are pieces of one token. Repeated
    rows and null ids are packed like any other; no rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    laid = cut(pieces(docs, vocabulary, length).withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int")))
    counts = laid.groupBy("length", "bucket").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `length` rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, length)))  # by patterns: bounded by the number of lengths, not of pieces
    upto = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("rank0"))
    inside = W.partitionBy("length", "bucket").orderBy("h", "doc_id", "piece")
    ranked = laid.join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank0") + F.row_number().over(inside) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for x in np.unique(size):
                own = np.flatnonzero(size == x)
                first, seq, at = table.value[int(x)]
                run = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = seq[run] + rank[own] - first[run], at[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
