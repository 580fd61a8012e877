"""Removal of repeated passages by content-defined chunks.

A gear rolling hash runs over a text's bytes, and a chunk ends wherever the hash is the largest of its
neighbourhood. A cut thus depends on some forty bytes before and a dozen after it alone: an insertion
moves none but those around it, and no history of earlier cuts has to fall into step. Chunks between cuts are named by a
digest; a chunk goes if a document with a smaller id holds the same one, in runs that are long enough to
be a passage and not a phrase. Digests travel once a batch of documents and are answered with a bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_GEAR[0xFF] = 0  # no UTF-8 text holds this byte
#: Bytes that the hash sees: older ones have been shifted out of its 32 bits.
SEEN = 32
#: Bytes between texts: the last of them, as many as a neighbourhood has at most, see nothing of the text before.
SILENT = 2 * SEEN


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte h = 2 h + gear[byte] of the last 32 bytes, by doubling: the sum for 2k bytes is that for k, shifted, plus that for the next k."""
    h, k = _GEAR[data], 1
    while k < SEEN:
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h, k = h + shifted, 2 * k
    return h


def chunked(texts: list[bytes], apart: int, most: int) -> list[list[int]]:
    """Ends of the chunks of each text. Texts are hashed end to end with silent bytes between, so each is hashed as if alone."""
    out: list[list[int]] = []
    for _, held in B.slices(texts):
        lens = np.array([len(t) for t in held], np.int64)
        at = np.cumsum(lens + SILENT) - lens  # after the silent bytes
        data = np.frombuffer(b"".join(b"\xff" * SILENT + t for t in held) + b"\xff" * SILENT, np.uint8)
        end = cut_points(data, apart)
        lo, hi = np.searchsorted(end, at, side="right"), np.searchsorted(end, at + lens)
        for n, a, i, j in zip(lens.tolist(), at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            ends = [*(end[i:j] - a).tolist(), n] if n else []
            if n > most and max(np.diff([0, *ends])) > most:
                ends = _split(data[a : a + n], ends, most)
            out.append(ends)
    return out


def cut_points(data: np.ndarray, apart: int) -> np.ndarray:
    """Positions after a byte whose hash exceeds those of the ``apart`` bytes before it and none of as many after it exceeds; moved to the start of a character."""
    h = gear(data)
    top, k = h, 1
    while k < apart:  # top[i]: the largest of h[i : i + apart]
        step = min(k, apart - k)
        top, k = np.maximum(top[:-step], top[step:]), k + step
    own = np.arange(apart, len(top) - 1)
    at = own[(h[own] > top[own - apart]) & (h[own] >= top[own + 1])] + 1
    for _ in range(3):
        at = at + ((data[at] & 0xC0) == 0x80)
    return at


def _split(text: np.ndarray, ends: list[int], most: int) -> list[int]:
    """``ends`` with further cuts, at characters, so that no chunk has much more than ``most`` bytes."""
    out, start = [], 0
    for z in ends:
        while z - start > most:
            start += most
            while start < z and text[start] & 0xC0 == 0x80:
                start += 1
            if start < z:
                out.append(start)
        out.append(z)
        start = z
    return out


def remove_passages(docs: DataFrame, apart: int = 12, most: int = 256, passage: int = 64) -> DataFrame:
    """doc_id, text_hash (Spark's xxhash64 of the text), n_bytes, n_chunks, n_removed, n_spans, kept_text: one row a document.

    Cuts are more than ``apart`` (at most 32) bytes from one another, about twice that on average, and a
    chunk has no more than about ``most`` bytes. A chunk is a repeat if a document with a smaller doc_id
    holds the same bytes as a chunk; runs of repeats go if they have ``passage`` bytes or are the whole
    text. A null text is empty and has no chunks. Rows with the same id never remove anything from one
    another; null ids come after all others and count as one. Cuts keep to characters, so the kept text
    is valid. No rows give no rows; other columns are ignored.
    """
    n = B.sizes(docs, bytes_per_key=2 * apart)
    by = B.gather(docs, n).groupBy("batch")

    def keyed(table: pa.Table) -> tuple[np.ndarray, list[bytes], list[list[int]], B.Sending]:
        ids, texts = B.unpack(table)
        ends = chunked(texts, apart, most)
        keys: list[bytes] = []
        for t, e in zip(texts, ends, strict=True):
            a = 0
            for z in e:
                keys.append(xxhash.xxh3_128_digest(t[a:z]))
                a = z
        digest = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        group = np.repeat(first, np.diff(np.append(first, len(ids))))
        return ids, texts, ends, B.Sending(digest[:, 0], np.repeat(group, [len(e) for e in ends]), n, digest[:, 1])

    def send(table: pa.Table) -> pa.Table:
        ids, _, _, sent = keyed(table)
        return sent.rows(table["batch"][0].as_py(), ids, exact=True, owners=True)

    def finish(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        ids, texts, ends, sent = keyed(table)
        gone = (sent.docs > sent.first[sent.of]) | sent.answered(B.bits_of(side, 1))[sent.of] if len(sent.of) else np.zeros(0, bool)
        rows, at = [], 0
        for i, t, e in zip(ids.tolist(), texts, ends, strict=True):
            hit = gone[at : at + len(e)].tolist()
            at += len(e)
            kept, removed, spans, begin, start = [], 0, 0, None, 0
            for z, h in zip([*e, None], [*hit, False], strict=True):
                if h:
                    begin = start if begin is None else begin
                elif begin is not None:
                    if start - begin >= passage or start - begin == len(t):
                        removed, spans = removed + start - begin, spans + 1
                    else:
                        kept.append(t[begin:start])
                    begin = None
                if z is not None:
                    if not h:
                        kept.append(t[start:z])
                    start = z
            hashed = int.from_bytes(xxhash.xxh64_digest(t, seed=42), "big", signed=True)  # the seed of Spark's function
            rows.append((i, hashed, len(t), len(e), removed, spans, b"".join(kept).decode()))
        return pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=names)

    names = ["doc_id", "text_hash", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept_text"]
    kinds = [pa.int64()] * 6 + [pa.string()]
    answers = B.answer(by.applyInArrow(B.released(send), B.SENT), n, 1, exact=True, owners=True)
    found = by.cogroup(answers.groupBy("batch")).applyInArrow(B.released_both(finish), "doc_id long, text_hash long, n_bytes long, n_chunks long, n_removed long, n_spans long, kept_text string")
    return found.withColumn("doc_id", n.outside(F.col("doc_id")))
