"""Removal of duplicate substrings by prefix doubling.

The rank of a position's first 2h bytes is the pair of its rank for h bytes and that of the position h
further on. Ranks are kept as 64-bit fingerprints of such pairs, so the rounds below half the threshold
need nothing but a document's own bytes and run where the text is. From half the threshold on, Spark
decides what is still shared: positions whose rank is unique drop out, and only the others are doubled to
the full threshold and sorted again.

The first distributed round need not see every position. With h = threshold // 2 + 1 bytes, every
string of the threshold's length contains threshold - h + 1 positions, and the one of least rank is
chosen from the string's bytes alone; if the string occurs elsewhere, that rank does too. Sending those
leaves about one position in thirteen for 50 bytes and loses no string.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BYTES = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)


_OTHER = np.random.default_rng(51).integers(0, 2**64, 256, dtype=np.uint64)
#: An odd number and its inverse modulo 2**64.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, ``n`` of each."""
    out = []
    for x in (_BASE, _INVERSE):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from a table for lengths up to the next power of two, which the next slice can use again."""
    return _powers(1 << max(20, (n - 1).bit_length())) if n <= 1 << 22 else _powers.__wrapped__(n)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of a pair of ranks."""
    x = a * _M1
    x ^= b * _M2
    y = x >> np.uint64(31)
    x ^= y
    x *= _M3
    np.right_shift(x, np.uint64(29), out=y)
    x ^= y
    return x


def ranks(data: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the ``size`` bytes from each position, by doubling."""
    rank, have = _BYTES[data], 1
    while have < size and len(rank):
        step = min(have, size - have)
        rank, have = (pair(rank[:-step], rank[step:]) if len(rank) > step else rank[:0]), have + step
    return rank


def _least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width and len(x):
        step = min(have, width - have)
        x, have = (np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]), have + step
    return x


class Slice:
    """Some documents' bytes end to end, with the ranks of half the threshold and each string's least one."""

    def __init__(self, first: int, texts: list[bytes], length: int) -> None:
        self.half = length // 2 + 1
        self.lens = np.array([len(t) for t in texts], np.int64)
        self.data = data = np.frombuffer(b"".join(texts), np.uint8)
        end = np.repeat(np.cumsum(self.lens), self.lens)
        self.doc = np.repeat(np.arange(first, first + len(texts)), self.lens)
        self.rank = ranks(data, self.half)
        self.least = _least(self.rank, length - self.half + 1)
        n = len(self.least)
        inside = np.arange(n) + length <= end[:n]  # strings that end in their own document
        change = np.concatenate(([True], (self.least[1:] != self.least[:-1]) | (self.doc[1:n] != self.doc[: n - 1]) | (inside[1:] != inside[:-1]))) if n else np.zeros(0, bool)
        runs = np.flatnonzero(change)
        lens = np.diff(np.append(runs, n))
        own = inside[runs] if n else np.zeros(0, bool)
        self.runs, self.run_lens = runs[own], lens[own]
        self.keys, self.key_docs = self.least[self.runs], self.doc[self.runs]

    def strings(self, shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the strings in ``shared`` runs, their ranks, second fingerprints of their bytes, and their documents."""
        start, n = self.runs[shared], self.run_lens[shared]
        at = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return at, pair(self.rank[at], self.rank[at + length - self.half]), self._second(at, length), self.doc[at]

    def _second(self, at: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints that have nothing in common with the ranks: sums of byte values times powers, from prefix sums."""
        up, down = powers(len(self.data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OTHER[self.data] * up[: len(self.data)], dtype=np.uint64)))
        return pair((sums[at + length] - sums[at]) * down[at], np.full(len(at), _M3))


def _parts(texts: list[bytes], live: np.ndarray, length: int) -> list[Slice]:
    return [Slice(first, held, length) for first, held in B.slices([t if ok else b"" for t, ok in zip(texts, live, strict=True)])]


def _join(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def remove_repeats(docs: DataFrame, length: int = 50, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept`` (binary): one row a document.

    Each byte covered by a string of ``length`` bytes that also starts in a document with a smaller
    doc_id goes; strings are judged on the input. Null texts are empty. Rows with the same id are one
    document to each other and never remove anything from one another; null ids come after all others
    (and count as one). Texts shorter than ``length`` stay as they are. No rows give no rows; other
    columns are ignored.
    """
    if length < 4:
        raise ValueError("length must be at least 4")
    n = B.sizes(docs, bytes_per_key=(length - length // 2) / 2)
    packed = B.gather(docs, n)
    # Equal texts first: but for the smallest document of a group they go as a whole, and take no part.
    copies = B.told(B.copies_of(docs, n, F.octet_length(F.coalesce(F.col("text"), F.lit(""))) >= length), n)

    def opened(table: pa.Table, side: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        ids, texts = B.unpack(table)
        whole = {x for k, x in zip(side["kind"].to_pylist(), side["bits"].to_pylist(), strict=True) if k == 0}
        copied = {x[:8] for x in whole}
        hashes = ((i, t) for i, t in zip((int(i).to_bytes(8, "big", signed=True) for i in ids), texts, strict=True))
        return ids, texts, np.array([i not in copied or i + xxhash.xxh64_digest(t, seed=42) not in whole for i, t in hashes], bool)  # 42: the seed of Spark's function

    def first_round(live_ids: np.ndarray, parts: list[Slice]) -> B.Sending:
        keys, own = _join([p.keys for p in parts], np.uint64), _join([p.key_docs for p in parts], np.int64)
        return B.Sending(keys, _group(live_ids)[own] if len(own) else own, n)

    def second_round(ids: np.ndarray, parts: list[Slice], sent: B.Sending, side: pa.Table) -> tuple[list[np.ndarray], B.Sending]:
        shared = (sent.answered(B.bits_of(side, 1)) | sent.many())[sent.of]
        places, keys, more, own, at = [], [], [], [], 0
        for p in parts:
            k = len(p.keys)
            pos, key, second, doc = p.strings(shared[at : at + k], length)
            places.append(pos)
            keys.append(key)
            more.append(second)
            own.append(doc)
            at += k
        docs_of = _join(own, np.int64)
        return places, B.Sending(_join(keys, np.uint64), _group(ids)[docs_of] if len(docs_of) else docs_of, n, _join(more, np.uint64))

    def send_first(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _no_rows(B.SENT)
        ids, texts, live = opened(table, side)
        return first_round(ids, _parts(texts, live, length)).rows(table["batch"][0].as_py(), ids, exact=False, owners=False)

    def send_second(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _no_rows(B.SENT)
        ids, texts, live = opened(table, side)
        parts = _parts(texts, live, length)
        return second_round(ids, parts, first_round(ids, parts), side)[1].rows(table["batch"][0].as_py(), ids, exact=True, owners=True)

    def finish(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _no_rows(schema)
        ids, texts, live = opened(table, side)
        parts = _parts(texts, live, length)
        places, sent = second_round(ids, parts, first_round(ids, parts), side)
        # An occurrence goes if a smaller document here, or the answer, has its string.
        gone = (sent.docs > sent.first[sent.of]) | sent.answered(B.bits_of(side, 2))[sent.of] if len(sent.of) else np.zeros(0, bool)
        rows: list[tuple] = []
        at = first = 0
        for p, pos in zip(parts, places, strict=True):
            hit = pos[gone[at : at + len(pos)]]
            at += len(pos)
            depth = np.zeros(int(p.lens.sum()) + 1, np.int32)
            depth[hit] += 1
            depth[hit + length] -= 1
            covered = np.cumsum(depth[:-1]) > 0
            end = np.cumsum(p.lens)
            for k, (lo, hi) in enumerate(zip((end - p.lens).tolist(), end.tolist(), strict=True), first):
                text, cov = texts[k], covered[lo:hi]
                if not live[k]:
                    kept, removed, spans = b"", len(text), 1
                elif cov.any():
                    kept, removed = np.frombuffer(text, np.uint8)[~cov].tobytes(), int(cov.sum())
                    spans = int(cov[0]) + int(np.count_nonzero(cov[1:] & ~cov[:-1]))
                else:
                    kept, removed, spans = text, 0, 0
                rows.append((int(ids[k]), len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            first += len(p.lens)
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    by = packed.groupBy("batch")
    one = B.answer(by.cogroup(copies.groupBy("batch")).applyInArrow(B.released_both(send_first), B.SENT), n, 1, exact=False, owners=False)
    side = copies.unionByName(one)
    two = B.answer(by.cogroup(side.groupBy("batch")).applyInArrow(B.released_both(send_second), B.SENT), n, 2, exact=True, owners=True)
    found = by.cogroup(side.unionByName(two).groupBy("batch")).applyInArrow(B.released_both(finish), schema)
    return found.withColumn("doc_id", n.outside(F.col("doc_id")))


def _group(ids: np.ndarray) -> np.ndarray:
    """Ordinals of documents with repeated rows as one: the first row's."""
    if not len(ids):
        return ids
    new = np.concatenate(([True], ids[1:] != ids[:-1]))
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _no_rows(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([], kinds[k]) for _, k in fields], names=[c for c, _ in fields])
