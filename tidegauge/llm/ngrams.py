"""Near-duplicate documents by an exact Jaccard join on word n-grams.

Tokens are a document's distinct word n-grams. Batches of documents exchange them once, so that every
token's document frequency is known: 1, rare, frequent or very frequent. In the order of rising
frequency class a document that reaches the threshold with another one can miss only so many of its
tokens (``spare``). Tokens of frequency 1 are missed for sure: more of them than that, and the document
has no partner and is done. Otherwise its prefix is extended until it cannot be missed: rare tokens are
indexed alone, frequent ones in combinations of two and very frequent ones of three. Of c tokens that
are combined by k, c - k + 1 have to be missed before no combination is left, which is what a token adds
to the prefix; documents that link then share an indexed token or combination (both prefixes are
prefixes of one order, so what the shorter one shares lies in the longer one). Combinations are formed
inside groups of a class by token hash; the number of groups follows the document's size, and each
document is indexed for its own class of sizes and the next, so that the partners agree on it.

Two documents that meet under a combination either share a rare token, and meet under that, too, or each
misses all rare tokens of the other one. So a document has a number of tokens that it is known not to share
under a key. Links allow (den - num) / (den + num) of both sizes together, so one of two partners has no
more than that part of its own size (it is light); the others (heavy ones) are compared with light ones
only, and only as far as the lightest one under the key leaves room for them. Texts from one template
whose variable parts are rare are heavy and make no pairs, however many they are.

Documents under one key are verified against the lightest one, and components formed. What is then left
under the same key in different components is compared in pairs with light ones, so no link is
lost while a group of copies of any size costs a verification a document. Pairs are told apart before
their tokens are looked up: each document has PARITY bits, the parities of how many of its tokens hash to
each, and two documents differ in at least as many tokens as their parities do.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches as B
from .common import WORD, cut
from .graph import components
from .suffixes import pair

#: Highest document frequency of each class but the last; tokens of class i > 0 are combined by i, but never by more than MOST.
CLASSES = (1, 8, 256, 1 << 12, 1 << 16, 1 << 20, 1 << 24)
MOST = 3
#: Tokens that a group of combined ones holds, about, if a whole prefix is frequent.
GROUP = 8
PARITY = 512
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(1).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MUL, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def tokens(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct ``k``-word shingles as sorted 64-bit fingerprints; fewer words are one shingle, none are none."""
    out: list[np.ndarray] = []
    for _, held in B.slices(texts):
        data = np.frombuffer(b" ".join(held).lower() + b" ", np.uint8)
        space = _SPACE[data]
        word = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        ends = np.cumsum([len(t) + 1 for t in held])
        of = np.searchsorted(word, np.concatenate(([0], ends)))  # words before each text
        if not len(word):
            out.extend([np.zeros(0, np.uint64)] * len(held))
            continue
        stop = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        lens = stop - word
        inner = np.arange(len(data)) - np.repeat(np.concatenate(([0], word)), np.diff(np.concatenate(([0], word, [len(data)]))))
        value = np.where(space, np.uint64(0), _BYTES[data] * _powers(int(lens.max()) + 1)[np.minimum(inner, lens.max())])
        h = pair(np.add.reduceat(value, word), lens.astype(np.uint64))
        gram, n = h, len(h)
        for j in range(1, k):
            gram = pair(gram[: max(0, n - j)], h[j:])
        for a, z in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
            if z - a >= k:
                out.append(np.unique(gram[a : z - k + 1]))
            elif z > a:
                x = h[a : a + 1]
                for j in range(a + 1, z):
                    x = pair(x, h[j : j + 1])
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def size_classes(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """Least sizes of the classes: partners are in the same class or neighbouring ones."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, -(-out[-1] * den // num)))
    return np.array(out, np.int64)


def spare(n: int, num: int, den: int) -> int:
    """How many of ``n`` tokens a partner can miss: a partner shares at least num/den of them."""
    return n - -(-num * n // den)


def _groups(size: int, num: int, den: int) -> int:
    return max(1, -(-spare(size, num, den) // GROUP))


@lru_cache
def tiny(num: int, den: int) -> int:
    """Size up to which a class of sizes has documents that combinations may not cover: each group can lose one token of those combined by 2 and two of others."""
    bounds, most = size_classes(num, den, 1000).tolist(), 0
    for k, size in enumerate(bounds[:-1]):
        sizes = range(bounds[max(0, k - 1)], bounds[k + 1])
        if any(n - 3 * _groups(size, num, den) < spare(n, num, den) + 1 for n in sizes):
            most = size
    return most


def index_keys(toks: np.ndarray, level: np.ndarray, num: int, den: int, bounds: np.ndarray) -> np.ndarray:
    """The keys under which a document is indexed; none if it has no partner. ``level``: the frequency class of each token."""
    n = len(toks)
    need = spare(n, num, den) + 1 - int(np.count_nonzero(level == 0))
    if need <= 0:
        return np.zeros(0, np.uint64)
    if spare(n, num, den) == 0 and n * den // num == n:  # only an equal set can link
        key = np.full(1, np.uint64(n))
        for t in toks:
            key = pair(key, t.reshape(1))
        return key
    order = np.lexsort((toks, level))
    order = order[np.searchsorted(level[order], 1) :]
    toks, level = toks[order], level[order]
    rare = int(np.searchsorted(level, 2))
    if rare >= need:
        return toks[:need]
    keys, by_k = [toks[:rare]], np.minimum(level, MOST)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    for context in (own, own + 1):
        size = int(bounds[context])
        if size <= tiny(num, den):
            keys.append(toks[rare:need])
            continue
        groups = _groups(size, num, den)
        # What each token adds once its group holds as many as it combines, until the prefix cannot be missed.
        cell = by_k[rare:].astype(np.int64) * groups + (toks[rare:] >> np.uint64(20)).astype(np.int64) % groups
        by = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], cell[by][1:] != cell[by][:-1])))
        place = np.empty(len(cell), np.int64)
        place[by] = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
        counts = np.cumsum(place >= by_k[rare:] - 1)
        upto = int(np.searchsorted(counts, need - rare)) + 1
        held: dict[int, list[int]] = {}
        for c, t in zip(cell[:upto].tolist(), toks[rare : rare + upto].tolist(), strict=True):
            held.setdefault(c, []).append(t)
        made = [np.array(list(combinations(ts, c // groups)), np.uint64).reshape(-1, c // groups) for c, ts in held.items()]
        for combos in made:
            key = np.full(len(combos), np.uint64(context))
            for j in range(combos.shape[1]):
                key = pair(key, combos[:, j])
            keys.append(key)
    return np.unique(np.concatenate(keys))


def _frequencies(sent: DataFrame, n: B.Sizes) -> DataFrame:
    """The frequency class of each key sent, as three planes of bits; ``docs`` holds its count in the batch, a byte each."""
    width = n.width(False)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["batch"].to_pylist(), table["keys"].to_pylist(), table["docs"].to_pylist(), strict=True), key=lambda r: r[0])
        lens = [len(r[2]) for r in rows]
        raw = np.zeros((sum(lens), 8), np.uint8)
        raw[:, :width] = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, width)
        keys, count = raw.view("<u8").ravel(), np.frombuffer(b"".join(r[2] for r in rows), np.uint8).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        total = np.add.reduceat(count[order], first)
        level = np.empty(len(keys), np.uint8)
        level[order] = np.repeat(np.searchsorted(CLASSES, total), np.diff(np.append(first, len(keys))))
        parts = np.split(level, np.cumsum(lens)[:-1])
        keep = [k for k, p in enumerate(parts) if p.any()]
        return pa.table([
            pa.array([rows[k][0] for k in keep], pa.int32()), pa.array([1] * len(keep), pa.int32()), pa.array([table["bucket"][0].as_py()] * len(keep), pa.int32()),
            pa.array([np.packbits(np.concatenate((parts[k] & 1, parts[k] >> 1 & 1, parts[k] >> 2))).tobytes() for k in keep], pa.binary()),
        ], names=["batch", "kind", "bucket", "bits"])

    return sent.groupBy("bucket").applyInArrow(B.released(run), B.ANSWER)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: one row a document.

    Texts are lower-cased in A-Z and split at the six ASCII white-space characters; n_shingles is the
    number of distinct shingles. Documents link when den * shared >= num * union; component_id is the
    smallest doc_id that links reach. A document without words links with nothing, a null text has no
    words. The threshold is one half at least. Rows with the same id are one node of the graph; a null id comes after all others, and where
    it has no smaller id to name, its component is null. No rows give no rows; other columns are ignored.
    """
    if 2 * num < den:
        raise ValueError("the threshold must be at least one half")
    n = B.sizes(docs, bytes_per_key=6)
    by = B.gather(docs, n).groupBy("batch")
    bounds = size_classes(num, den)
    # Equal texts: all but the smallest of a group link to it at once and are indexed no further.
    copies = B.copies_of(docs, n, F.coalesce(F.col("text"), F.lit("")).rlike(WORD))
    known = B.told(copies, n)

    def opened(table: pa.Table, side: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[bool], B.Sending]:
        ids, texts = B.unpack(table)
        whole = {x for k, x in zip(side["kind"].to_pylist(), side["bits"].to_pylist(), strict=True) if k == 0}
        copied = {x[:8] for x in whole}
        named = [int(i).to_bytes(8, "big", signed=True) for i in ids]
        live = [i not in copied or i + xxhash.xxh64_digest(t, seed=42) not in whole for i, t in zip(named, texts, strict=True)]
        toks = tokens(texts, words)
        held = [t if ok else t[:0] for t, ok in zip(toks, live, strict=True)]
        keys = np.concatenate(held) if held else np.zeros(0, np.uint64)
        return ids, toks, live, B.Sending(keys, np.repeat(np.arange(len(held)), [len(t) for t in held]), n)

    def send(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())], names=["bucket", "batch", "keys", "docs", "counts"])
        ids, _, _, sent = opened(table, side)
        rows = sent.rows(table["batch"][0].as_py(), ids, exact=False, owners=False)
        count = np.minimum(np.bincount(sent.of, minlength=len(sent.keys)), 255).astype(np.uint8)[sent.sent]
        return rows.set_column(3, "docs", pa.array([c.tobytes() for c in np.split(count, sent.cuts)] if len(count) else [], pa.binary()))

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    names = ["kind", "key", "doc", "n", "own", "tokens", "parity"]

    def index(table: pa.Table, side: pa.Table) -> pa.Table:
        """Kind 0: a document's size; 1: a key of a document, ``own`` being what it shares with none that it first meets there; 2: the tokens of an indexed document that others hold, too."""
        cols: list[list] = [[] for _ in names]

        def add(*values) -> None:
            for c, v in zip(cols, values, strict=True):
                c.append(v)

        if table.num_rows:
            ids, toks, live, sent = opened(table, side)
            bits = B.bits_of(side, 1)
            level = np.zeros(len(sent.keys), np.uint8)
            for own in np.split(np.arange(len(sent.sent)), sent.cuts) if len(sent.sent) else []:
                if (got := bits.get(int(sent.bucket[own[0]]))) is not None:
                    planes = np.unpackbits(np.frombuffer(got, np.uint8), count=3 * len(own)).reshape(3, -1)
                    level[sent.sent[own]] = planes[0] + 2 * planes[1] + 4 * planes[2]
            level, at = level[sent.of], 0
            for i, t, ok in zip(ids.tolist(), toks, live, strict=True):
                add(0, None, i, len(t), None, None, None)
                if not ok or not len(t):
                    continue
                own = level[at : at + len(t)]
                at += len(t)
                keys = index_keys(t, own, num, den, bounds)
                single, rare = int(np.count_nonzero(own == 0)), t[own == 1]
                # Where only equal sets link, rare tokens have no keys of their own.
                missed = np.where(np.isin(keys, rare), single, single + len(rare)) if spare(len(t), num, den) else np.full(len(keys), single)
                for key, m in zip(keys.view(np.int64).tolist(), missed.tolist(), strict=True):
                    add(1, key, i, len(t), m, None, None)
                if len(keys):
                    held = t[own > 0]
                    odd = np.bincount((held >> np.uint64(33)).astype(np.int64) % PARITY, minlength=PARITY).astype(np.uint8) & 1
                    add(2, None, i, len(t), single, held.tobytes(), np.packbits(odd).view(np.int64).tolist())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    asked = by.cogroup(known.groupBy("batch")).applyInArrow(B.released_both(send), B.SENT)
    levels = _frequencies(asked, n)
    indexed = cut(by.cogroup(known.unionByName(levels).groupBy("batch")).applyInArrow(B.released_both(index), "kind int, key long, doc long, n long, own long, tokens binary, parity array<long>"))

    # den s >= num (n + m - s) is the same as (num + den) (tokens that differ) <= (den - num) (n + m), so two whose weights add up to more than 0 do not link.
    keys = indexed.filter("kind = 1").select("key", "doc", F.expr(f"({num} + {den}) * own - ({den} - {num}) * n").alias("weight"))
    sets = indexed.filter("kind = 2").select("doc", "n", "own", "tokens", "parity")
    lightest = F.min(F.struct("weight", "doc")).alias("x")
    shared = keys.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), lightest, F.count("*").alias("rows_of")).filter("least < most and x.weight <= 0")
    shared = shared.select("key", F.col("x.doc").alias("centre"), F.col("x.weight").alias("low"), "rows_of")
    shared = cut(B.joined(keys, shared, ["key"]).filter("weight + low <= 0").select("key", "doc", "centre", "weight"))
    to_least = shared.filter("doc <> centre").select(F.least("centre", "doc").alias("a"), F.greatest("centre", "doc").alias("b")).distinct()
    links = cut(verified(to_least, sets, num, den))
    equal = copies.select(F.col("least").alias("a"), F.col("doc").alias("b"))
    found = cut(components(links))
    # Under each key, what is in different components now.
    placed = cut(shared.join(found, "doc", "left").select("key", "doc", "weight", F.coalesce("component", "doc").alias("component")))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows_of")).filter("lo < hi").select("key", "rows_of")
    mixed = cut(B.joined(placed, mixed, ["key"]).join(sets.select("doc", "n", "own", "parity"), "doc"))
    x, y = mixed.filter("weight <= 0").alias("x"), mixed.alias("y")
    differ = " + ".join(f"bit_count(x.parity[{k}] ^ y.parity[{k}])" for k in range(PARITY // 64))
    near = f"({num} + {den}) * ({differ} + x.own + y.own) <= ({den} - {num}) * (x.n + y.n)"
    apart = x.join(y, F.expr(f"x.key = y.key and x.component <> y.component and x.weight + y.weight <= 0 and (y.weight > 0 or x.doc < y.doc) and {near}"))
    rest = apart.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct().join(to_least, ["a", "b"], "left_anti")
    more = verified(rest, sets, num, den)
    found = components(links.unionByName(more).unionByName(equal))
    rows = indexed.filter("kind = 0").select("doc", "n").join(found, "doc", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return rows.select(n.outside(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), n.outside(component).alias("component_id"))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link. ``sets`` has each indexed document's tokens that other documents hold."""

    def run(batches):
        for t in batches:
            keep = []
            for k, (n, m, x, y) in enumerate(zip(t.column(2).to_pylist(), t.column(3).to_pylist(), t.column(4), t.column(5), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(q, p)
                s = int(np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p)) if len(q) else 0
                if den * s >= num * (n + m - s):
                    keep.append(k)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([t.column(0).take(at), t.column(1).take(at)], names=["a", "b"])

    one = sets.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("other"))
    two = sets.select(F.col("doc").alias("a"), "n", "tokens")
    return pairs.join(one, "b").join(two, "a").select("a", "b", "n", "m", "tokens", "other").mapInArrow(run, "a long, b long")
