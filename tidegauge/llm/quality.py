"""Quality by weak supervision.

Heuristic labellers vote good, bad or nothing on every document; they overlap, so that most kinds of bad
text are seen by two or three of them. Expectation maximisation over the counts of vote patterns (three to
the number of labellers at most, whatever the corpus) estimates how often each labeller votes what good
documents and on each kind of bad ones, and with that the probability that a pattern's documents are good: a
labeller that stands alone against the others is taken for wrong. These probabilities are the labels of a linear
scorer on hashed features, which is fitted on a bounded sample and then decides on all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .common import small_batches
from .ngrams import _BYTES, _SPACE
from .suffixes import pair

#: Hashed features, and documents (those of the smallest id hash) on which the scorer is fitted.
FEATURES, SAMPLE = 1024, 5_000
#: Labellers: share, bad above, good below, and how many units a share has to rest on to count half.
LABELLERS = (
    ("symbols", 0.04, 0.015, 60),  # symbols of characters
    ("capitals", 0.40, 0.15, 40),  # capitals of ASCII letters
    ("shouted", 0.40, 0.10, 8),  # words of three letters or more without a small one
    ("marked", 0.10, 0.03, 8),  # words that end in two marks or more
    ("ended", 0.35, 0.25, 40),  # words that end a sentence
    ("repeated", 0.15, 0.05, 8),  # words that equal the one before
    ("again", 0.30, 0.15, 8),  # pairs of words that the text had already
    ("bare", 0.15, 0.05, 8),  # words without a letter or digit
    ("long", 0.60, 0.35, 60),  # characters in words of over 16 bytes
    ("short", 0.05, 0.025, 0),  # one in so many words: often wrong, as short texts can be good
)
#: Columns of shares of word events, beside the hashed ones: the scorer's features.
EVENTS = 5
WIDTH = FEATURES + EVENTS
_CLASS = np.zeros((4, 256), np.uint8)
_CLASS[0, list(b"%$#*&|~^<>{}[]\\@=+_!")] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, 65:91] = _CLASS[2, 97:123] = 1
_CLASS[3, list(b".?!:;")] = 1
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"%$#*&|~^<>{}[]\\@=+_!?.,:;-")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Votes that the prior of a labeller in a class is worth, halved.
PRIOR = 1.0
#: Bytes of texts that are measured at once.
SLICE = 1 << 18
#: Characters on which a text's byte pairs have to rest to count half.
HALF = 100


class Measured:
    """Measures and, if asked for, hashed features of some texts."""

    def __init__(self, texts: list[bytes], features: bool) -> None:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        starts = np.concatenate(([0], ends[:-1]))
        space = _SPACE[data]
        word = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        stop = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        of = np.searchsorted(word, np.append(starts, ends[-1]))
        self.words = np.diff(of)
        symbols, capitals, letters = (np.add.reduceat(_CLASS[k][data], starts, dtype=np.int64) for k in range(3))
        lens = stop - word

        def per_text(x: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(x)))
            return total[of[1:]] - total[of[:-1]]

        doc = np.repeat(np.arange(len(texts)), self.words)
        if len(word):
            shift = (np.arange(len(data)) - np.repeat(np.concatenate(([0], word)), np.diff(np.concatenate(([0], word, [len(data)]))))).astype(np.uint64) & np.uint64(63)
            value = _BYTES[data] << shift
            value[space] = 0
            h = np.add.reduceat(value, word) + lens.astype(np.uint64)
            again = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])))
            bare = ~np.logical_or.reduceat(_LETTER[data], word)
            ended = _CLASS[3][data[stop - 1]].astype(bool)
        else:
            again = bare = ended = np.zeros(0, bool)
        w = np.maximum(1, self.words).astype(np.float64)
        if len(word):
            marked = _MARK[data[stop - 1]] & _MARK[data[np.maximum(stop - 2, 0)]] & (lens > 2)
            small = np.logical_or.reduceat(_SMALL[data], word)
            shouted = ~small & (np.add.reduceat(_CLASS[1][data], word, dtype=np.int64) > 2)
            pairs = np.concatenate((pair(h[:-1], h[1:]), h[:1]))
            pairs[np.concatenate((doc[1:] != doc[:-1], [True]))] = 0  # a text's last word begins none
            key = pair(pairs, doc.astype(np.uint64))
            had = np.ones(len(word), bool)
            had[np.unique(key, return_index=True)[1]] = False
            had &= pairs != 0
        else:
            marked = had = shouted = again
        counts = (
            (symbols, ends - starts - 1), (capitals, letters), (per_text(shouted), self.words), (per_text(marked), self.words), (per_text(ended), self.words), (per_text(again), self.words),
            (per_text(had), self.words), (per_text(bare), self.words), (per_text(lens * (lens > 16)), ends - starts - 1),
            (np.ones(len(texts)), np.maximum(1, self.words)),
        )
        # Shares are drawn towards the middle, where a labeller says nothing, the more so the less they rest on.
        self.measures = np.stack([(x + weight * (bad + good) / 2) / (of + weight) for (x, of), (_, bad, good, weight) in zip(counts, LABELLERS, strict=True)], axis=1)
        events = (again, bare, ended, marked, had)
        if features:
            self.features = self._hashed(data, starts, ends, per_text, events, w)

    def _hashed(self, data, starts, ends, per_text, events, w) -> np.ndarray:
        """Byte pairs hashed into FEATURES counts, scaled to a text's length, and behind them the shares of word events."""
        pairs = ((data[:-1].astype(np.uint32) * 251 + data[1:]) * np.uint32(2654435761) >> np.uint32(22)).astype(np.int64)
        out = np.zeros((len(starts), WIDTH), np.float32)
        for k, (a, z) in enumerate(zip(starts.tolist(), (ends - 1).tolist(), strict=True)):
            if z - a > 1:
                out[k, :FEATURES] = np.sqrt(np.bincount(pairs[a : z - 1], minlength=FEATURES) / (z - a - 1)) * ((z - a) / (z - a + HALF))
        for j, event in enumerate(events):
            out[:, FEATURES + j] = per_text(event) / w
        return out

    def votes(self) -> np.ndarray:
        """Each text's pattern: a ternary digit a labeller, 0 nothing, 1 good, 2 bad."""
        code = np.zeros(len(self.words), np.int64)
        for k, (_, bad, good, _) in enumerate(LABELLERS):
            x = self.measures[:, k]
            code += 3**k * np.where(x > bad, 2, np.where(x < good, 1, 0))
        return code


def latent_classes(votes: np.ndarray, n: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the classes, each one's chance of a bad vote by labeller, and each pattern's posterior over the classes.

    Class 0 is good text, and there is a class of bad text for each labeller to begin with, so that kinds
    of bad text that only some labellers see need not be taken for one another's errors. Within a class
    labellers vote independently, and whether one votes at all says nothing. ``votes`` has a row a pattern.
    """
    bad, seen = (votes == 2).astype(float), (votes > 0).astype(float)
    # The start: patterns without bad votes are good, others are shared between the labellers that speak against them.
    own = np.hstack([(bad.sum(1) == 0)[:, None].astype(float), bad / np.maximum(1, bad.sum(1))[:, None]])
    for _ in range(rounds):
        weight = own * n[:, None]
        share = (weight.sum(0) + PRIOR) / (weight.sum() + PRIOR * own.shape[1])
        # Of two votes that the prior is worth, a labeller gives a bad text one against it, and a good text a quarter of one.
        begin = np.where(np.arange(own.shape[1]) == 0, 0.25, 1.0)[:, None] * PRIOR
        chance = (weight.T @ bad + begin) / (weight.T @ seen + 2 * PRIOR)
        log = np.log(share) + bad @ np.log(chance).T + (seen - bad) @ np.log(1 - chance).T
        own = np.exp(log - log.max(1, keepdims=True))
        own /= own.sum(1, keepdims=True)
    return share, chance, own


def label_model(counts: dict[int, int], labellers: int = len(LABELLERS)) -> dict[int, float]:
    """Pattern -> probability of good, by expectation maximisation over latent classes.

    A class counts as bad if two labellers or more speak against its texts more often than not: what one
    labeller alone has against texts that all others call good is taken for its own error.
    """
    codes = np.array(sorted(counts), np.int64)
    votes = np.stack([codes // 3**k % 3 for k in range(labellers)], axis=1)
    _, chance, own = latent_classes(votes, np.array([counts[c] for c in codes.tolist()], np.float64))
    good = own[:, (chance > 0.5).sum(1) < 2].sum(1)
    return dict(zip(codes.tolist(), np.clip(good, 0.0, 1.0).tolist(), strict=True))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 600, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Nesterov's gradient steps; a text that says nothing scores as the average one."""
    w = v = np.zeros(x.shape[1])
    a = b = 0.0
    step = 4 / (float(np.einsum("ij,ij->", x, x)) / len(x) + 1 + decay)
    for k in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ v.astype(x.dtype) + b, -50, 50))) - y
        new, shift = v - step * ((error.astype(x.dtype) @ x) / len(x) + decay * v), b - step * float(error.mean())
        v, w, b, a = new + k / (k + 3) * (new - w), new, shift + k / (k + 3) * (shift - a), shift
    return w, float(a)


def score(docs: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes, label, score, keep and the columns of ``docs``: one row a document.

    ``label`` is the label model's probability of good, ``score`` the scorer's; a document is kept if its
    score reaches ``threshold``. Short texts (null and empty ones, too) give labellers little to vote on. Scores depend on the text and the corpus statistics
    only, so equal texts fare alike. No rows give no rows; columns of those names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("votes", "label", "score", "keep")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, held in B.slices((t.as_py() for t in b.column(0)), SLICE):
                code, n = np.unique(Measured(held, False).votes(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["votes", "n"])
            B.release()

    counted = docs.select(text).mapInArrow(patterns, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # at most 3 ** len(LABELLERS) rows
    counts = {r["votes"]: r["n"] for r in counted}
    if not counts:
        return docs.select("doc_id", F.lit(0).cast("long").alias("votes"), F.lit(0.0).alias("label"), F.lit(0.0).alias("score"), F.lit(True).alias("keep"), *[c for c in docs.columns if c != "doc_id"])
    labels = label_model(counts)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, held in B.slices((t.as_py() for t in b.column(1)), SLICE):
                m = Measured(held, True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), pa.array(m.votes()), pa.array([r.tobytes() for r in m.features], pa.binary())], names=["h", "votes", "x"])

    # About `sample` documents by hash of the id, then exactly that many at most.
    total, grain = sum(counts.values()), 1 << 30
    h = F.xxhash64("doc_id", F.xxhash64("text"))
    drawn = docs.select(h.alias("h"), text.alias("t")).filter(F.pmod("h", F.lit(grain)) <= min(grain, 1.2 * sample * grain / total + 1))
    rows = drawn.mapInArrow(featured, "h long, votes long, x binary").orderBy("h").limit(sample).toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, WIDTH) if rows.num_rows else np.zeros((1, WIDTH), np.float32)
    y = np.array([labels[v] for v in rows["votes"].to_pylist()]) if rows.num_rows else np.full(1, 0.5)
    del rows
    model = spark.sparkContext.broadcast((*fit(x, y), labels))  # WIDTH weights and a label a pattern

    kept = [c for c in docs.columns if c != "doc_id"]
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("votes"), F.lit(0.0).alias("label"), F.lit(0.0).alias("score"), F.lit(True).alias("keep"), *kept).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, labels = model.value
        for b in batches:
            for first, held in B.slices((t.as_py() or b"" for t in b.column(0).cast(pa.binary())), SLICE):
                m = Measured(held, True)
                votes = m.votes()
                p = 1 / (1 + np.exp(-np.clip(m.features @ w + bias, -50, 50)))
                part = b.slice(first, len(held))
                new = [pa.array(votes), pa.array([labels[v] for v in votes.tolist()]), pa.array(p), pa.array(p >= threshold)]
                yield pa.RecordBatch.from_arrays([part.column(1), *new, *part.columns[2:]], names=["doc_id", "votes", "label", "score", "keep", *kept])
            B.release()

    return docs.select(F.col("text").alias("_t"), "doc_id", *kept).mapInArrow(scored, schema)
