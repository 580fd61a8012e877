"""Toxicity from subword bags.

A word is the mean of the vectors of its character n-grams, a passage of some words the mean of its words, and a
linear softmax over that says how toxic the passage is; vectors and softmax are trained jointly, in numpy, on a bounded
sample of labelled documents. A spelling that no document had shares most n-grams with one that it had.
A document is clean if all of its passages are, so its score is one minus the product of what each passage
leaves; a single word counts the same in a short text and in a book.

With two classes all that scoring needs of a vector is how far it leans to one of them, so tasks carry one number
an n-gram, and score each distinct word of a slice once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches as B

#: Characters of n-grams, vectors, their dimensions, words of a passage.
GRAMS, BUCKETS, DIM, PASSAGE = (3, 4, 5), 1 << 16, 8, 8
#: Labelled documents of the smallest hashes that are fitted on, and passages (of the smallest hashes, too) of each.
SAMPLE, PASSAGES = 12_000, 64
#: Characters of a text that are read at once.
SLICE = 1 << 17
#: What stands between words: white space, and ASCII marks but for those that stand for letters; longer runs of anything are one word.
_APART = np.zeros(0x3002, bool)
_APART[:0x21] = _APART[0x7F:0xA1] = _APART[0x2000:0x2070] = _APART[0x3000:0x3002] = True
_APART[[ord(c) for c in "\"#%&()+,-./:;<=>?[\\]^_`{|}~"]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def parts(text: str, size: int | None = None) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end between words, where words are not longer than that."""
    size, at = size or SLICE, 0
    while len(text) - at > size:
        end = next((k for k in range(at + size, at, -1) if (c := ord(text[k - 1])) < len(_APART) and _APART[c]), at + size)
        yield text[at:end]
        at = end
    yield text[at:]


class Bags:
    """Passages of some text parts, their distinct words, and those words' n-grams.

    ``owner`` is each passage's part, ``size`` its words; ``words`` are numbers of distinct words in passages one after
    another; ``grams`` are buckets of the distinct words in turn, ``of`` where each word's begin.
    """

    def __init__(self, texts: list[str]) -> None:
        chars = np.frombuffer(("\n".join(texts) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        apart = _APART[np.minimum(chars, len(_APART) - 1)]
        start = np.flatnonzero(~apart & np.concatenate(([True], apart[:-1])))
        stop = np.flatnonzero(apart & np.concatenate(([False], ~apart[:-1])))
        lens = [len(t.lower()) + 1 for t in texts]
        doc = np.searchsorted(np.cumsum(lens), start, "right")
        at = np.arange(len(start)) - np.searchsorted(doc, doc)
        new = at % PASSAGE == 0  # passages begin anew in each part
        self.owner, self.first = doc[new], np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(start)))
        place = np.arange(len(chars)) - np.repeat(np.concatenate(([0], start)), np.diff(np.concatenate(([0], start, [len(chars)]))))
        value = (chars.astype(np.uint64) + np.uint64(1)) * _MIX
        value = (value ^ value >> np.uint64(29)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX
        value[apart] = 0
        h = np.add.reduceat(value ^ value >> np.uint64(31), start) if len(start) else np.zeros(0, np.uint64)
        _, one, self.words = np.unique(h, return_index=True, return_inverse=True)
        self.hashes = h[one]
        # Distinct words once more, each between two marks.
        n = stop[one] - start[one] + 2
        edge = np.concatenate(([0], np.cumsum(n)))
        held = np.full(int(edge[-1]), 2, np.uint64)
        inner = np.arange(len(held)) - np.repeat(edge[:-1], n)
        of = np.repeat(start[one], n)
        body = (inner > 0) & (inner < np.repeat(n, n) - 1)
        held[body] = chars[(of + inner - 1)[body]]
        held[~body & (inner > 0)] = 3
        room = np.repeat(n, n) - inner
        rolled, found, owner = np.zeros(len(held), np.uint64), [], []
        word = np.repeat(np.arange(len(n)), n)
        for k in range(max(GRAMS)):
            rolled = rolled[: len(held) - k] * np.uint64(1_000_003) + held[k:]
            if k + 1 in GRAMS:
                fits = np.flatnonzero(room[: len(rolled)] > k)
                found.append(((rolled[fits] ^ np.uint64(k)) * _MIX >> np.uint64(40)) % np.uint64(BUCKETS))
                owner.append(word[fits])
        order = np.argsort(np.concatenate(owner), kind="stable") if len(n) else np.zeros(0, np.int64)
        self.grams = np.concatenate(found)[order].astype(np.int64) if len(n) else np.zeros(0, np.int64)
        self.of = np.searchsorted(np.concatenate(owner)[order], np.arange(len(n))) if len(n) else np.zeros(0, np.int64)
        self.many = np.diff(np.append(self.of, len(self.grams)))

    def leaning(self, lean: np.ndarray, bias: float) -> np.ndarray:
        """The log odds of each passage, from a number for each bucket."""
        if not len(self.words):
            return np.zeros(0)
        word = np.add.reduceat(lean[self.grams], self.of) / self.many
        return np.add.reduceat(word[self.words], self.first) / self.size + bias


class Sample:
    """The bags of many passages, read slice by slice: as in ``Bags``, with each passage's number as its owner."""

    def __init__(self, passages: list[str]) -> None:
        known: dict[int, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        at, total = 0, 0
        for k, p in enumerate(passages, 1):
            total += len(p)
            if total < SLICE and k < len(passages):
                continue
            bags = Bags(passages[at:k])
            number = np.array([known.setdefault(h, len(known)) for h in bags.hashes.tolist()], np.int64)
            fresh = np.flatnonzero(number >= (parts[-1][5] if parts else 0))
            order = fresh[np.argsort(number[fresh])]
            size = bags.many[order]
            row = np.repeat(bags.of[order] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum())) if len(order) else np.zeros(0, np.int64)
            parts.append((bags.owner + at, bags.size, number[bags.words], bags.grams[row], size, len(known)))
            at, total = k, 0
        whole = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
        self.owner, self.size, self.words, self.grams, self.many = (whole(k) for k in range(5))
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        self.of = np.concatenate(([0], np.cumsum(self.many)[:-1])).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Vectors of n-grams, and a softmax over them for (clean, toxic); ``lean`` and ``bias`` are what scoring needs."""

    vectors: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    @property
    def lean(self) -> np.ndarray:
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    @property
    def bias(self) -> float:
        return float(self.biases[1] - self.biases[0])


def _clean(z: np.ndarray) -> np.ndarray:
    """The logarithm of what a passage of log odds ``z`` leaves for being clean."""
    return -np.logaddexp(0, z)


def fit(passages: list[str], doc: np.ndarray, toxic: np.ndarray, rounds: int = 12, batch: int = 400, rate: float = 0.1, decay: float = 0.04, drop: float = 0.3, seed: int = 1) -> Model:
    """Vectors and softmax by Adam with decay on ``passages``, of which each belongs to document ``doc`` (ascending) with label ``toxic[doc]``.

    Of a toxic document it is unknown which passages are; the likelihood is that of "not all are clean". In each
    step a share ``drop`` of the n-grams is left out, so that none has to be there.
    """
    r = np.random.default_rng(seed)
    bags = Sample(passages)
    vectors = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights = r.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    per = max(1.0, len(passages) / max(1, len(toxic)))
    biases = np.array([0.0, np.log(share / (1 - share)) - np.log(per)], np.float32)
    if not len(bags.words) or not 0 < toxic.sum() < len(toxic):
        return Model(np.zeros_like(vectors), weights, biases)
    held = [vectors, weights, biases]
    first, second = [np.zeros_like(x) for x in held], [np.zeros_like(x) for x in held]
    which = doc[bags.owner]  # each bag's document; passages without words have no bag
    edge = np.append(bags.first, len(bags.words))
    step, rounds = 0, max(rounds, 150 * batch // len(toxic))
    steps = rounds * -(-len(toxic) // batch)
    for _ in range(rounds):
        order = r.permutation(len(toxic))
        for at in range(0, len(order), batch):
            chosen = np.zeros(len(toxic), bool)
            chosen[order[at : at + batch]] = True
            rows = np.flatnonzero(chosen[which])
            if not len(rows):
                continue
            size = bags.size[rows]
            row = np.repeat(np.arange(len(rows)), size)
            words = bags.words[np.repeat(edge[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(row))]
            used, words = np.unique(words, return_inverse=True)
            many = bags.many[used]
            owner = np.repeat(np.arange(len(used)), many)
            grams = bags.grams[np.repeat(bags.of[used] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(owner))]
            kept = (r.random(len(grams)) >= drop) / (1 - drop)
            axis = weights[:, 1] - weights[:, 0]
            lean = vectors @ axis
            word = np.bincount(owner, kept * lean[grams], len(used)) / many
            z = np.bincount(row, word[words], len(rows)) / size + float(biases[1] - biases[0])
            # The gradient by z: a clean document wants all passages clean, a toxic one that not all are.
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            clean = np.minimum(np.bincount(which[rows], _clean(z), len(toxic)), -1e-9)
            pull = np.where(toxic > 0, -np.exp(clean) / -np.expm1(clean), 1.0)[which[rows]] * p / len(order[at : at + batch])
            by_word = np.bincount(words, (pull / size)[row], len(used)) / many
            by_gram = np.bincount(grams, by_word[owner] * kept, BUCKETS).astype(np.float32)
            turn = vectors.T @ by_gram
            slopes = [np.outer(by_gram, axis), np.stack((-turn, turn), axis=1), np.array([-pull.sum(), pull.sum()], np.float32)]
            step += 1
            for x, g, a, b in zip(held, slopes, first, second, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * (g * g)
                x -= rate * (1 - step / steps) * ((a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-5) + decay * x)
    return Model(*held)


def scores(texts: list[str], lean: np.ndarray, bias: float) -> np.ndarray:
    """Each text's chance of being toxic. A text without words is a passage that leans nowhere."""
    clean = np.zeros(len(texts))
    seen = np.zeros(len(texts), bool)
    held, owner, total = [], [], 0

    def read() -> None:
        nonlocal held, owner, total
        if held:
            bags = Bags(held)
            doc = np.array(owner)[bags.owner]
            np.add.at(clean, doc, _clean(bags.leaning(lean, bias)))
            seen[doc] = True
        held, owner, total = [], [], 0

    for k, t in enumerate(texts):
        for p in parts(t):
            held.append(p)
            owner.append(k)
            total += len(p)
            if total >= SLICE:
                read()
    read()
    clean[~seen] = _clean(np.array(bias))
    return -np.expm1(clean)


def held_out(doc_id: Column) -> Column:
    """Whether nothing may be learned from a document's label: a fifth of all ids; a null id counts as one without digits."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = PASSAGES) -> Model:
    """A model of ``labels`` (doc_id, toxic) on documents that are not held out: at most ``sample`` of them and ``passages`` passages of each, all of them spread by hash. Tasks cut the passages, so what comes to the driver is bounded by these numbers."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("label_id")))
    total, grain = known.count(), 1 << 30
    order = F.xxhash64(F.lit("toxicity"), "label_id")
    known = known.withColumn("at", order).filter(F.pmod("at", F.lit(grain)) <= min(grain, int(1.1 * sample * grain / max(1, total)) + 1))
    known = known.orderBy("at").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))  # at most `sample` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found: list[tuple[int, str]] = []
                for p in parts(text.as_py()):
                    chars = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
                    apart = _APART[np.minimum(chars, len(_APART) - 1)]
                    start = np.flatnonzero(~apart & np.concatenate(([True], apart[:-1])))[::PASSAGE]
                    # Of very long words a passage takes the first characters, here only: the sample is bounded.
                    cuts = [p[a:z][: 64 * PASSAGE] for a, z in zip(start, [*start[1:], len(p)], strict=False)]
                    found += [(hash_of(x), x) for x in cuts]
                    found = sorted(found)[:passages]
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([int(toxic)], pa.int32()), pa.array([[x for _, x in found]], pa.list_(pa.string()))], names=["at", "toxic", "passages"])
            B.release()

    got = rows.select("at", "toxic", "text").mapInArrow(run, "at long, toxic int, passages array<string>").toArrow()
    held = sorted(zip(got["at"].to_pylist(), got["passages"].to_pylist(), got["toxic"].to_pylist(), strict=True))[:sample]
    return fit([p for _, ps, _ in held for p in ps], np.repeat(np.arange(len(held)), [len(ps) for _, ps, _ in held]), np.array([t for *_, t in held], np.int64))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document, over its whole text.

    The score depends on the text alone, so equal texts, repeated rows among them, fare alike; null and empty
    texts, and those without words, score what a passage that leans nowhere does. Without labels of both
    kinds every passage leans nowhere. Labels of unknown documents and null labels teach nothing; of several labels
    the highest holds. No rows give no rows; other columns are not carried along.
    """
    model = train(docs, labels, sample)
    held = docs.sparkSession.sparkContext.broadcast((model.lean, model.bias))  # a number a bucket
    schema = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean, bias = held.value
        for b in batches:
            for first, texts in B.slices((t.as_py() or b"" for t in b.column(2)), 1 << 20):
                p = scores([t.decode("utf-8", "replace") for t in texts], lean, bias)
                part = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
            B.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
