"""Exchange of content keys between batches of documents.

A batch is a set of documents of some megabytes, chosen by a hash of id and text and held as compressed rows.
A batch names its content (chunks, strings) by keys and sends each distinct key once, with the
smallest document that holds it, to the key's bucket. The bucket finds which batches' keys occur
elsewhere or belong to a smaller document, and answers every batch with one bit a key, in the order in
which the batch sent them. A frequent key thus costs a bucket at most one entry a batch, however many
documents hold it; texts and keys move as blobs, so a row is a batch's share of a bucket.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parallelism

#: Text bytes of a batch and key bytes of a bucket, on average.
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Stands for a null id inside the operators: after all others. Ids are moved by one where one of them is this number.
LAST, FIRST = 2**63 - 1, -(2**63)
#: A group of equal keys is hot from one in so many rows on; there are fewer of them than that.
HOT = 10_000

SENT = "bucket int, batch int, keys binary, docs binary, counts binary"
ANSWER = "batch int, kind int, bucket int, bits binary"


@dataclass(frozen=True)
class Sizes:
    """Numbers of batches, buckets and keys, and the free id below which ids stay as they are, if there is one to fill."""

    batches: int
    buckets: int
    n_keys: float
    gap: int | None = None

    def width(self, exact: bool) -> int:
        """Bytes that keep chance collisions below 1 in 256 for a key, or (``exact``) for all keys together.

        The bits that choose the bucket are not among those sent, so they count, too. Up to 8 bytes come
        from the first half of a key of 128 bits, more from the second.
        """
        bits = (2 if exact else 1) * math.log2(max(2.0, self.n_keys)) + 8 - math.log2(self.buckets)
        return min(12, max(4, math.ceil(bits / 8)))

    def inside(self, doc_id: Column) -> Column:
        """An id as the operators use it: null is LAST, and no other is."""
        i = doc_id.cast("long")
        return F.coalesce(i if self.gap is None else F.when(i > self.gap, i - 1).otherwise(i), F.lit(LAST))

    def outside(self, doc: Column) -> Column:
        """The id again."""
        return F.when(doc != LAST, doc if self.gap is None else F.when(doc >= self.gap, doc + 1).otherwise(doc))


def sizes(docs: DataFrame, bytes_per_key: float, batch_bytes: int = BATCH_BYTES) -> Sizes:
    i = F.col("doc_id").cast("long")
    total, least, most = docs.agg(F.sum(F.octet_length("text")), F.min(i), F.max(i)).first()
    workers, keys, gap = parallelism(docs.sparkSession), (total or 0) / bytes_per_key + 1, None
    if most == LAST:
        gap = FIRST
        if least == FIRST:  # both ends are taken: the first free id between them
            ids = docs.select(i.alias("i")).distinct()
            gap = ids.filter(F.col("i") < LAST).select((F.col("i") + 1).alias("i")).join(ids, "i", "left_anti").agg(F.min("i")).first()[0]
    return Sizes(int(max(workers, -(-(total or 0) // batch_bytes))), int(max(workers, 8 * keys // BUCKET_BYTES)), keys, gap)


def joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``table`` (a row a key, and in ``rows_of`` how many rows have it) says on their key.

    Keys with more than one in HOT of the rows are fewer than HOT, so they are broadcast and their rows stay
    where they are; no other key can weigh on the task that it is dealt to.
    """
    table = cut(table)
    total = table.agg(F.sum("rows_of")).first()[0] or 0
    hot = F.broadcast(table.filter(F.col("rows_of") * HOT > total).drop("rows_of"))
    cold = table.filter(F.col("rows_of") * HOT <= total).drop("rows_of")
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def copies_of(docs: DataFrame, n: Sizes, counts: Column) -> DataFrame:
    """doc, least, h1: documents whose text a smaller one has, among the texts for which ``counts`` holds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.filter(counts).select(n.inside(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.octet_length(text).alias("n"))
    facts, same = cut(facts), ["h1", "h2", "n"]
    least = facts.groupBy(*same).agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("rows_of")).filter("least < most").drop("most")
    return cut(joined(facts, least, same).filter("doc > least").select("doc", "least", "h1").distinct())


def told(copies: DataFrame, n: Sizes) -> DataFrame:
    """Kind 0 of a batch's answers: a copy's id and text hash, 8 bytes each, in ``bits``."""
    return copies.select(
        batch_of(F.col("doc"), F.col("h1"), n).alias("batch"), F.lit(0).alias("kind"), F.lit(0).alias("bucket"),
        F.expr("unhex(concat(lpad(hex(doc), 16, '0'), lpad(hex(h1), 16, '0')))").alias("bits"),
    )


def gather(docs: DataFrame, n: Sizes) -> DataFrame:
    """batch, docs, lens, texts: documents by batch, many to a row, texts compressed; dealt out by batch."""
    rows = docs.select(n.inside(F.col("doc_id")).alias("doc"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("batch", batch_of(F.col("doc"), F.xxhash64("text"), n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            if not b.num_rows:
                continue
            doc, text, to = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            for own in np.split(order, cuts):
                texts = [text[int(k)].as_py() for k in own]
                lens = np.array([len(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([to[own[0]]], pa.int32()), pa.array([doc[own].tobytes()], pa.binary()), pa.array([lens.tobytes()], pa.binary()), pa.array([press.compress(b"".join(texts))], pa.binary())],
                    names=["batch", "docs", "lens", "texts"],
                )
            release()

    packed = rows.select("doc", "text", "batch").mapInArrow(run, "batch int, docs binary, lens binary, texts binary")
    return packed.repartition(parallelism(docs.sparkSession), "batch")


def unpack(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """A batch's ids and texts, by id and then text: the same order on every reading."""
    ids, texts = [], []
    undo = zstandard.ZstdDecompressor()
    for d, n, t in zip(table["docs"], table["lens"], table["texts"], strict=True):
        lens = np.frombuffer(n.as_py(), np.int64)
        raw, at = undo.decompress(t.as_py(), max_output_size=max(1, int(lens.sum()))) if lens.sum() else b"", 0
        ids.extend(np.frombuffer(d.as_py(), np.int64).tolist())
        for k in lens.tolist():
            texts.append(raw[at : at + k])
            at += k
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    return np.array([ids[k] for k in order], np.int64), [texts[k] for k in order]


def batch_of(doc: Column, text_hash: Column, n: Sizes) -> Column:
    """A row's batch. The text takes part, so that rows of one id do not meet in one batch."""
    return F.pmod(F.xxhash64(doc, text_hash), F.lit(n.batches)).cast("int")


def slices(texts: Iterable[bytes], size: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``size`` bytes, with the number of texts before each."""
    first, held, total = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t)
        total += len(t)
        if total >= size:
            yield first, held
            first, held, total = k + 1, [], 0
    if held:
        yield first, held


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine; idle workers stay for the next stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def released(run):
    """A function of a table, after which memory is released."""

    def call(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return call


def released_both(run):
    """The same for a function of two tables."""

    def call(table: pa.Table, side: pa.Table) -> pa.Table:
        try:
            return run(table, side)
        finally:
            release()

    return call


class Sending:
    """A batch's distinct keys in the order in which they are sent, and the smallest document of each.

    ``keys``, ``docs`` (ordinals in the batch) and, for keys of 128 bits, ``more`` have an entry for each
    occurrence, documents ascending.
    """

    def __init__(self, keys: np.ndarray, docs: np.ndarray, n: Sizes, more: np.ndarray | None = None) -> None:
        self.n, self.docs = n, docs
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, bool)
        if more is not None and len(keys):
            second = more[order]
            if np.any(~new[1:] & (second[1:] != second[:-1])):  # equal first halves of different keys
                order = np.lexsort((more, keys))
                ranked, second = keys[order], more[order]
            new = np.concatenate(([True], (ranked[1:] != ranked[:-1]) | (second[1:] != second[:-1])))
        at = np.flatnonzero(new)
        self.of = np.empty(len(keys), np.int64)  # each occurrence's distinct key
        self.of[order] = np.cumsum(new) - 1
        self.keys, self.first = ranked[at], docs[order][at]
        self.more = None if more is None else more[order][at]
        chooses = self.keys if more is None else self.more
        bucket = ((chooses >> np.uint64(32)) * np.uint64(n.buckets) >> np.uint64(32)).astype(np.int64)
        self.sent = np.argsort(bucket * (int(docs.max()) + 1 if len(docs) else 1) + self.first, kind="stable")
        self.bucket = bucket[self.sent]
        self.cuts = np.flatnonzero(np.diff(self.bucket)) + 1

    def many(self) -> np.ndarray:
        """Of each distinct key, whether several documents of this batch hold it."""
        out = np.zeros(len(self.keys), bool)
        out[self.of[self.docs != self.first[self.of]]] = True
        return out

    def rows(self, batch: int, ids: np.ndarray, exact: bool, owners: bool) -> pa.Table:
        width = self.n.width(exact)
        raw = self.keys[self.sent].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        if width > 8 and self.more is not None:
            raw = np.hstack([raw, self.more[self.sent].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : width - 8]])
        cols: list[list] = [[], [], [], [], []]
        for own in np.split(np.arange(len(self.sent)), self.cuts) if len(self.sent) else []:
            first = self.first[self.sent[own]]
            doc, count = np.unique(first, return_counts=True) if owners else (first[:0], first[:0])
            for c, v in zip(cols, (int(self.bucket[own[0]]), batch, raw[own].tobytes(), ids[doc].tobytes(), count.astype(np.uint32).tobytes()), strict=True):
                c.append(v)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bucket", "batch", "keys", "docs", "counts"])

    def answered(self, bits: dict[int, bytes]) -> np.ndarray:
        """The bit of each distinct key."""
        out = np.zeros(len(self.keys), bool)
        for own in np.split(np.arange(len(self.sent)), self.cuts) if len(self.sent) else []:
            if (got := bits.get(int(self.bucket[own[0]]))) is not None:
                out[self.sent[own]] = np.unpackbits(np.frombuffer(got, np.uint8), count=len(own)).astype(bool)
        return out


def answer(sent: DataFrame, n: Sizes, kind: int, exact: bool, owners: bool) -> DataFrame:
    """One bit a key sent: with ``owners``, whether a smaller document of another batch holds it; else whether another batch does."""
    width = n.width(exact)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["batch"].to_pylist(), table["keys"].to_pylist(), table["docs"].to_pylist(), table["counts"].to_pylist(), strict=True), key=lambda r: r[0])
        lens = [len(r[1]) // width for r in rows]
        raw = np.zeros((sum(lens), 16), np.uint8)
        raw[:, :width] = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, width)
        halves = [np.ascontiguousarray(raw[:, k : k + 8]).view("<u8").ravel() for k in range(0, width, 8)]
        keys = halves[0]
        del raw
        if owners:
            doc = np.concatenate([np.repeat(np.frombuffer(r[2], np.int64), np.frombuffer(r[3], np.uint32)) for r in rows])
            order = np.lexsort((doc, *halves[::-1]))
        else:
            order = np.argsort(keys, kind="stable") if len(halves) == 1 else np.lexsort(halves[::-1])
        same = np.ones(len(keys) - 1, bool)
        for h in halves:
            same &= h[order[1:]] == h[order[:-1]]
        bit = np.zeros(len(keys), bool)
        if owners:
            new = np.concatenate(([True], ~same))
            least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            bit[order] = doc[order] > least
        else:
            bit[order[1:][same]] = True
            bit[order[:-1][same]] = True
        parts = np.split(bit, np.cumsum(lens)[:-1])
        keep = [k for k, p in enumerate(parts) if p.any()]  # an answer that is missing says no to all
        bucket = table["bucket"][0].as_py()
        return pa.table([
            pa.array([rows[k][0] for k in keep], pa.int32()), pa.array([kind] * len(keep), pa.int32()), pa.array([bucket] * len(keep), pa.int32()),
            pa.array([np.packbits(parts[k]).tobytes() for k in keep], pa.binary()),
        ], names=["batch", "kind", "bucket", "bits"])

    return sent.groupBy("bucket").applyInArrow(released(run), ANSWER)


def bits_of(side: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: x for k, b, x in zip(side["kind"].to_pylist(), side["bucket"].to_pylist(), side["bits"].to_pylist(), strict=True) if k == kind}
