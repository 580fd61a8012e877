"""Importance resampling towards a target distribution.

Texts are described by hashed word n-grams. A bucket's gain is the logarithm of how much more frequent it is
in the target than in the corpus, a text's weight the mean gain of its features, and a document's score its weight
plus Gumbel noise from its id, so that the highest scores are a draw without replacement by weight.

Equal texts are collapsed first: features and weights are computed once a text, the corpus's counts take
each text as often as it occurs, and weights are joined back to documents before the noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import batches as B
from .common import cut, discard, parallelism

#: Words of a feature at most, buckets, words that a document needs to be drawn, percent of those documents that are drawn.
WORDS, BUCKETS, LEAST, PERCENT = 2, 10_000, 20, 25
#: Bytes of texts that are read at once; words longer than this many bytes are hashed one by one.
SLICE, LONG = 1 << 19, 64
#: Bytes in lower case (A to Z only), and which of them are of words: digits, small letters, all beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@cache
def _crc() -> tuple[np.ndarray, np.ndarray]:
    """What one byte does to a CRC32; and what 0 to LONG zero bytes do to each byte of one."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    many = np.zeros((LONG + 1, 4, 256), np.uint32)
    many[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(LONG):
        many[k + 1] = one[many[k] & 255] ^ many[k] >> 8
    return one, many


def _behind(crc: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """CRCs of what is ``lens`` bytes longer, up to the CRC of these bytes, which is to be added."""
    many = _crc()[1]
    return many[lens, 0, crc & 255] ^ many[lens, 1, crc >> 8 & 255] ^ many[lens, 2, crc >> 16 & 255] ^ many[lens, 3, crc >> 24]


def described(texts: list[bytes], words: int = WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its number of words and of features; then text, bucket and count of all distinct buckets, by text."""
    one = _crc()[0]
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = _WORD[data]
    start = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    stop = np.flatnonzero(~inside & np.concatenate(([False], inside[:-1])))
    lens, doc = stop - start, np.searchsorted(ends, start, "right")
    n_words = np.bincount(doc, minlength=len(texts))
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-lens, kind="stable")
    order = order[np.searchsorted(-lens[order], -LONG) :]  # words of LONG bytes or fewer, longest first
    left = -lens[order]
    for j in range(int(-left[0]) if len(left) else 0):
        now = order[: np.searchsorted(left, -j)]
        c = crc[now]
        crc[now] = one[(c ^ data[start[now] + j]) & 255] ^ c >> 8
    crc = ~crc
    for k in np.flatnonzero(lens > LONG).tolist():
        crc[k] = zlib.crc32(data[start[k] : stop[k]].tobytes())
    keys, n_features, run = [doc * buckets + crc % buckets], n_words.copy(), crc
    for j in range(1, words):
        run, to = run[:-1], slice(j, None)
        raw = ~run
        spaced = ~(one[(raw ^ 32) & 255] ^ raw >> 8)
        size = lens[to]
        run = _behind(spaced, np.minimum(size, LONG)) ^ crc[to]
        for k in np.flatnonzero(size > LONG).tolist():
            run[k] = zlib.crc32(data[start[j + k] : stop[j + k]].tobytes(), int(spaced[k]))
        whole = doc[to] == doc[: len(doc) - j]
        keys.append((doc[to] * buckets + run % buckets)[whole])
        n_features += np.bincount(doc[to][whole], minlength=len(texts))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return n_words, n_features, key // buckets, key % buckets, count


FEATURES = "rows_of long, n_words long, n_features long, buckets binary, counts binary"


def features(texts: DataFrame, words: int = WORDS, buckets: int = BUCKETS, keep: str | None = None) -> DataFrame:
    """``keep``, rows_of, n_words, n_features, buckets, counts of texts (columns rows_of and text): a row a text with its distinct buckets, of which there are no more than ``buckets`` however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, held in B.slices((t.as_py() or b"" for t in b.column("text")), SLICE):
                n_words, n_features, text, bucket, count = described(held, words, buckets)
                at = np.searchsorted(text, np.arange(len(held) + 1))
                bucket, count = bucket.astype(np.int32), count.astype(np.int64)
                blobs = [[x[a:z].tobytes() for a, z in zip(at, at[1:], strict=False)] for x in (bucket, count)]
                part = b.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([*([part.column(keep)] if keep else []), part.column("rows_of"), pa.array(n_words), pa.array(n_features), *[pa.array(x, pa.binary()) for x in blobs]], names=[*([keep] if keep else []), "rows_of", "n_words", "n_features", "buckets", "counts"])
            B.release()

    head = f"{keep} {texts.schema[keep].dataType.simpleString()}, " if keep else ""
    return texts.select(*([keep] if keep else []), "rows_of", F.col("text").cast("binary").alias("text")).mapInArrow(run, head + FEATURES)


def totals(described: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, each text taken rows_of times: a task sums what it reads, so no more than ``buckets`` rows a task are shuffled and as many reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for rows, bucket, count in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                sums[np.frombuffer(bucket.as_py(), np.int32)] += rows * np.frombuffer(count.as_py(), np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in described.select("rows_of", "buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's ratio of shares, with one feature more in each bucket, rounded down."""
    n = float(len(corpus))
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weighted(described: DataFrame, gain: np.ndarray, key: str) -> DataFrame:
    """key, rows_of, n_words, n_features, weight."""
    held = described.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = [int(held.value[np.frombuffer(x.as_py(), np.int32)] @ np.frombuffer(c.as_py(), np.int64)) for x, c in zip(b.column(4), b.column(5), strict=True)]
            weight = [t // n if n else 0 for t, n in zip(total, b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(weight, pa.int64())], names=[key, "rows_of", "n_words", "n_features", "weight"])

    kind = described.schema[key].dataType.simpleString()
    return described.select(key, "rows_of", "n_words", "n_features", "buckets", "counts").mapInArrow(run, f"{key} {kind}, rows_of long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 7) -> Column:
    """A thousand times a Gumbel variable that hangs on seed and id alone, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with ``rank`` by score, the higher first, then id: ranges of scores, numbered inside, with the rows of the ranges before them."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # The bounds of ranges are drawn anew on every run, so the ranges are written once.
    laid = cut(rows.repartitionByRange(parallelism(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    counts = laid.groupBy("part").agg(F.count("*").alias("n"))  # a row a range
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part", before.alias("before"), F.floor(F.sum("n").over(W.partitionBy(F.lit(0))) * percent / 100).alias("most"))
    placed = laid.withColumn("row", F.row_number().over(W.partitionBy("part").orderBy(*order))).join(F.broadcast(counts), "part")
    at = (F.col("before") + F.col("row")).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(at <= F.col("most"), at).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1, null for documents that are not drawn): one row a document.

    Words are runs of digits, letters a to z (A to Z lower-cased) and characters beyond ASCII, so null, empty and
    wordless texts have no features and weight 0. Repeated rows are documents of their own with equal scores, of
    equal rank but for their number; ties go to smaller ids, null ids come last and draw the same noise. An empty
    target, or no documents, changes nothing but counts. ``docs`` needs doc_id and text, ``target`` text; other
    columns are not carried along.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(text, 256))
    once = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("rows_of")).withColumn("key", key)
    found = cut(features(once, words, buckets, "key"))
    wanted = features(target.select(F.lit(1).cast("long").alias("rows_of"), text.alias("text")), words, buckets)
    gain = gains(totals(found, buckets), totals(wanted, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"))
    rows = B.joined(rows, _weighted(found, gain, "key"), ["key"])
    rows = cut(rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")))
    discard(found)
    others = rows.filter(F.col("n_words") < least).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return _ranked(rows.filter(F.col("n_words") >= least).drop("n_words"), percent).unionByName(others)
