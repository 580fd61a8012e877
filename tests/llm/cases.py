"""Small awkward tables, and plain Python versions of what the operators do."""

import hashlib
import random
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns.
CLASHING = ["h", "size", "bucket", "part", "key", "n", "doc", "batch", "kind", "own", "votes", "score", "keep", "label", "target", "rank", "row", "shard", "length", "piece", "th", "h1", "h2", "component", "copy", "term", "which", "text_crc32"]


def documents(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = prose(60)
    rows = []
    for k in range(n):
        text = prose(r.randint(5, 120))
        if k % 5 == 0:
            text += " " + passage + " " + prose(10)
        if k % 7 == 0 and rows:
            words = rows[k // 2][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if k % 11 == 0 and rows:
            text = rows[k // 3][1]
        rows.append((1000 - 3 * k if k % 2 else k, text, "en", f"src{k % 3}", len(text)))
    rows += [
        (2000, None, "en", "src0", None), (2001, "", None, None, 0), (2002, " \t\n ", "en", None, 4), (2003, "word", "en", "src1", 4), (2004, "word", "en", "", 4),
        (2005, "two words", "en", "src2", 9), (2006, "é́ ünï 漢字 漢字 😀\x0b x", "xx", "é", 18), (2007, "a" * 30_000, "en", "src0", 30_000), (2008, "ab " * 8_000, "en", "src0", 24_000), (2009, prose(3_000), "en", "src0", 1),
        (2010, passage, "en", "src1", 1), (2010, passage, "en", "src1", 1), (2011, prose(40), "en", "src1", 1), (2011, passage + " other", "en", "src1", 1), (None, passage, "en", "src1", 1), (None, prose(30), "en", None, 1),
        (-5, prose(50) + " " + passage, "en", "src2", 1),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clash(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


LAST = 2**63


def order(i):
    return LAST if i is None else i


def substrings(rows, length):
    least = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            least[k] = min(least.get(k, LAST + 1), order(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < order(i):
                cov[s : s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cov) if not c)
        spans = sum(1 for k, c in enumerate(cov) if c and (k == 0 or not cov[k - 1]))
        out.append((i, len(b), sum(cov), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(rows, k, num, den):
    sets = [(order(i), shingles(t, k)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    known = lambda i: None if i == LAST else i
    return sorted(((known(i), len(s), known(find(i)) if s else known(i)) for i, s in sets), key=repr)


def bag(text):
    w = (text or "").lower().split()
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)


def jaccard(a, b):
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0
