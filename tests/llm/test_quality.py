"""The quality classifier against plain Python, and its label model against the labels of sf0.1."""

import os
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from tidegauge.llm import batches, quality

SF = "/root/testdata/sf0.1"
MARKS = set(b"%$#*&|~^<>{}[]\\@=+_!?.,:;-")


def measured(text):
    """What the labellers measure: counts and what they are counted of."""
    w = re.findall(rb"[^\x20\x09-\x0D]+", text)
    pairs, had = set(), 0
    for p in zip(w, w[1:]):
        had += p in pairs
        pairs.add(p)
    many = len(w)
    alone = lambda x: not any(c >= 128 or chr(c).isalnum() for c in x)
    return [
        (sum(c in b"%$#*&|~^<>{}[]\\@=+_!" for c in text), len(text)), (sum(65 <= c <= 90 for c in text), len(re.findall(rb"[A-Za-z]", text))),
        (sum(not re.search(rb"[a-z]", x) and len(re.findall(rb"[A-Z]", x)) > 2 for x in w), many), (sum(len(x) > 2 and x[-1] in MARKS and x[-2] in MARKS for x in w), many),
        (sum(x[-1] in b".?!:;" for x in w), many), (sum(a == b for a, b in zip(w, w[1:])), many), (had, many), (sum(map(alone, w)), many), (sum(len(x) for x in w if len(x) > 16), len(text)), (1, max(1, many)),
    ]


def voted(text):
    code = 0
    for k, ((x, of), (_, bad, good, weight)) in enumerate(zip(measured(text), quality.LABELLERS, strict=True)):
        share = (x + weight * (bad + good) / 2) / (of + weight)
        code += 3**k * (2 if share > bad else 1 if share < good else 0)
    return code


def features(text):
    pairs = Counter((a * 251 + b) * 2654435761 % 2**32 >> 22 for a, b in zip(text, text[1:]))
    out = np.zeros(quality.WIDTH)
    for k, n in pairs.items():
        out[k] = (n / (len(text) - 1)) ** 0.5 * ((len(text)) / (len(text) + 100))
    m = measured(text)
    many = max(1, len(re.findall(rb"[^\x20\x09-\x0D]+", text)))
    out[quality.FEATURES :] = [m[k][0] / many for k in (5, 7, 4, 3, 6)]
    return out


TEXTS = [(t or "").encode() for _, t, *_ in cases.documents()] + [b"THIS IS LOUD!! LOUD!! LOUD!! ab ab ab ab", b"$$ %% ## a|b <x> {y}", b"one. two? three! four; five: x" * 9, b"averyveryveryverylongwordindeed " * 30, b"...", b"x"]


def test_votes_and_features():
    m = quality.Measured(TEXTS, True)
    assert m.votes().tolist() == [voted(t) for t in TEXTS]
    for t, got in zip(TEXTS, m.features, strict=True):
        assert np.allclose(got, features(t), atol=1e-5), t[:50]


def test_scores(spark):
    """All documents are in the sample here, so votes, labels, fit and scores can be followed."""
    rows = cases.documents()
    got = quality.score(cases.frame(spark, rows)).collect()
    votes = {t: voted(t) for t in TEXTS}
    held = [(t or "").encode() for _, t, *_ in rows]
    labels = quality.label_model(dict(Counter(votes[t] for t in held)))
    x, y = np.array([features(t) for t in held]), np.array([labels[votes[t]] for t in held])
    w, bias = quality.fit(x.astype(np.float32), y)
    want = {t: 1 / (1 + np.exp(-(features(t) @ w + bias))) for t in held}
    for r in got:
        t = (r["text"] or "").encode()
        assert r["votes"] == votes[t] and r["label"] == pytest.approx(labels[votes[t]]) and r["score"] == pytest.approx(want[t], abs=1e-3) and r["keep"] == (r["score"] >= 0.5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_label_model_decides_between_labellers(spark):
    """On sf0.1 it calls some two hundred documents good that a labeller speaks against, and is right by the labels."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").select("text", "quality").collect()
    codes = np.concatenate([quality.Measured(held, False).votes() for _, held in batches.slices([(r["text"] or "").encode() for r in rows], 1 << 18)])
    labels = quality.label_model(dict(Counter(codes.tolist())))
    good = np.array([labels[c] >= 0.5 for c in codes.tolist()])
    none_against = np.array([all(c // 3**k % 3 != 2 for k in range(len(quality.LABELLERS))) for c in codes.tolist()])
    truth = np.array([-1 if r["quality"] is None else r["quality"] for r in rows])
    differ = (good != none_against) & (truth >= 0)
    assert (good != none_against).sum() > 200 and differ.sum() > 80
    assert np.mean(good[differ] == (truth[differ] == 1)) > 0.95
    assert np.mean(good[truth >= 0] == (truth[truth >= 0] == 1)) > 0.995 > 0.98 > np.mean(none_against[truth >= 0] == (truth[truth >= 0] == 1))
