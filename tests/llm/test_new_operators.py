"""Operators 11 to 13: against plain Python, exact round trips, held-out labels."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidegauge.llm import infill, queries, resampling, toxicity

SF = "/root/testdata/sf0.1"
ROWS = cases.documents() + [
    (3000, "a <P> b", "", "", 0), (3001, "<P<S<M", "", "", 0), (3002, "x<<S>", "", "", 0), (3003, "<", "", "", 0), (3004, "漢" * 700 + "<M" + "é" * 500, "", "", 0),
    (3005, "\x00 null \x7f", "", "", 0), (3006, "<S>", "", "", 0), (2**63 - 1, "the end", "", "", 0), (-(2**63), "the beginning", "", "", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, ROWS).cache()


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 12


def cut_plainly(i, text, seed=1, rate=90, first=20, marks=infill.SENTINELS):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(t)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in marks) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, t.encode()
    p, s, m = marks
    made = s + t[z:] + p + t[:a] + m + t[a:z] if h[3] % 100 < first else p + t[:a] + s + t[z:] + m + t[a:z]
    return i, n, "spm" if h[3] % 100 < first else "psm", a, z - a, made.encode()


@pytest.mark.parametrize("seed,rate,first", [(1, 90, 20), (2, 100, 100), (3, 0, 20), (4, 100, 0)])
def test_infill(docs, seed, rate, first):
    got = infill.restore(infill.transform(docs, rate=rate, suffix_first=first, seed=seed))
    rows = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    plain = lambda r: (*r[:5], bytes(r[5]))
    assert sorted((plain(r) for r in rows), key=repr) == sorted((cut_plainly(i, t, seed, rate, first) for i, t, *_ in ROWS), key=repr)
    assert Counter((r["doc_id"], bytes(r["restored"])) for r in rows) == Counter((i, (t or "").encode()) for i, t, *_ in ROWS)


def test_infill_of_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 4 * infill.LANE)
    r = random.Random(4)
    texts = ["".join(r.choice("ab<PSM>é漢😀") for _ in range(n)) for n in (0, 1, 127, 128, 129, 511, 512, 513, 2000, 9000)] + ["<P" * 900, "漢" * 2000 + "<P>", "a" * 511 + "<P>"]
    got = list(infill._cut(list(range(len(texts))), [t.encode() for t in texts], infill.SENTINELS, 100, 20, 1))
    assert [(k, *g) for k, g in enumerate(got)] == [cut_plainly(k, t, 1, 100) for k, t in enumerate(texts)]
    assert [g[1] for g in got[-2:]] == ["plain"] * 2


def test_infill_of_a_very_long_text(spark):
    text = "é <b 漢 " * 300_000
    got = infill.restore(infill.transform(spark.createDataFrame([(6, text), (7, text)], "doc_id long, text string"), rate=100)).collect()
    assert [(*g[:5], bytes(g["output"])) for g in sorted(got)] == [cut_plainly(i, text, 1, 100) for i in (6, 7)]
    assert {bytes(g["restored"]) for g in got} == {text.encode()}


def test_infill_with_other_sentinels(docs):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    got = infill.restore(infill.transform(docs, marks), marks)
    assert Counter((r["doc_id"], bytes(r["output"])) for r in got.collect()) == Counter((i, cut_plainly(i, t, marks=marks)[5]) for i, t, *_ in ROWS)
    for bad in (("", "a", "b"), ("é", "a", "b"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            infill.transform(docs, bad)


def test_table_counts_bytes_that_are_no_text():
    t = infill.table()
    scan = infill.Scan([b"\x80\x80", b"\xc3(", b"\xe2\x82", b"\xff\xfe<P>\xe2<P>"], t)
    assert scan.units.tolist() == [2, 2, 1, 9] and dict(scan.hits) == {3: [(5, 1), (9, 1)]}


def test_infill_of_no_rows_and_clashing_columns(spark, docs):
    assert infill.restore(infill.transform(docs.limit(0))).collect() == []
    assert tuples(infill.transform(cases.clash(docs)).select("doc_id", "n", "form")) == tuples(infill.transform(docs).select("doc_id", "n", "form"))


# --- 13


def bag(text, words=2, buckets=10_000):
    t = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return len(w), Counter(zlib.crc32(b" ".join(w[k : k + n])) % buckets for n in range(1, words + 1) for k in range(len(w) - n + 1))


def resampled_plainly(rows, target, words=2, buckets=10_000, least=20, percent=25, seed=7):
    bags = [bag(t, words, buckets) for _, t, *_ in rows]
    s, t = sum((b for _, b in bags), Counter()), sum((bag(x, words, buckets)[1] for x in target), Counter())
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for (i, *_), (n, b) in zip(rows, bags):
        size = sum(b.values())
        weight = sum(c * gain(x) for x, c in b.items()) // size if size else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], cases.order(r[0])))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


TARGET = [t for _, t, *_ in ROWS[3:9]] + [None, "", "Some Words of 1 other kind_of text, é漢é 漢"]


def target(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id long, text string")


@pytest.mark.parametrize("words,buckets,least,percent", [(2, 10_000, 20, 25), (1, 50, 0, 100), (3, 777, 5, 60)])
def test_resampling(spark, docs, words, buckets, least, percent):
    got = resampling.resample(docs, target(spark), words, buckets, least, percent)
    assert tuples(got) == resampled_plainly(ROWS, TARGET, words, buckets, least, percent)


def test_resampling_ranks_over_ranges(spark):
    rows = [(k, f"w{k % 7} " * 20, "", "", 0) for k in range(3000)]
    got = resampling.resample(cases.frame(spark, rows).repartition(9), target(spark))
    assert tuples(got) == resampled_plainly(rows, TARGET)


def test_resampling_of_a_text_that_a_third_of_all_documents_have(spark):
    rows = [(k, "the same words again " * 9 if k % 3 else f"one of its own {k} " * 8, "", "", 0) for k in range(900)]
    assert tuples(resampling.resample(cases.frame(spark, rows), target(spark))) == resampled_plainly(rows, TARGET)


def test_resampling_without_documents_or_target(spark, docs):
    assert resampling.resample(docs.limit(0), target(spark)).collect() == []
    assert tuples(resampling.resample(docs, target(spark).limit(0))) == resampled_plainly(ROWS, [])
    assert tuples(resampling.resample(cases.clash(docs), cases.clash(target(spark)))) == resampled_plainly(ROWS, TARGET)


def test_resampling_of_very_long_texts(spark):
    rows = [(1, "Ab1 é " * 400_000, "", "", 0), (2, "x" * 3_000_000, "", "", 0), (3, None, "", "", 0)]
    assert tuples(resampling.resample(cases.frame(spark, rows), target(spark), least=1)) == resampled_plainly(rows, TARGET, least=1)


# --- 11


def toxic_corpus(n=2400, seed=5):
    """Prose of made-up words; a third of the documents insult, each in one or two places."""
    r = random.Random(seed)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "da", "fe", "gi"]
    words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        text, toxic = r.choices(words, k=r.randint(5, 90)), k % 3 == 0
        for _ in range(r.randint(1, 2) if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(("wretchling", "scoundrelly", "nincompoops", "Buffoonery!")))
        rows.append((k, " ".join(text), "en", "s", 0))
        labels.append((k, int(toxic)))
    return rows, labels, words


@pytest.fixture(scope="module")
def taught(spark):
    rows, labels, words = toxic_corpus()
    return cases.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), labels, words


def test_toxicity_on_held_out_documents(taught):
    docs, labels, known, _ = taught
    got = toxicity.score(docs, labels).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k, _ in known}
    want = dict(known)
    assert sum(r["held_out"] for r in got) > 300
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in got if r["held_out"]]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_of_unseen_spellings_and_long_texts(taught):
    docs, labels, _, words = taught
    model = toxicity.train(docs, labels)
    rate = lambda *texts: toxicity.scores(list(texts), model.lean, model.bias)
    base = " ".join(words[:12])
    assert (rate(*[f"{base} {x} {base}" for x in ("wretchlings", "scoundrely", "nincompooops", "BUFFOONERYY", "wwretchling")]) >= 0.5).all()
    long = " ".join(words) + " "
    assert rate(base, long * 60).max() < 0.5
    assert rate(long * 30 + " wretchling nincompoops " + long * 30)[0] >= 0.5


def test_labels_of_held_out_documents_teach_nothing(spark, taught):
    docs, labels, _, _ = taught
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tuples(toxicity.score(docs, labels)) == tuples(toxicity.score(docs, other))


def test_toxicity_of_awkward_rows(spark, docs, taught):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, none).collect()
    assert len(got) == len(ROWS) and len({r["score"] for r in got if (r["doc_id"] or 0) in (2000, 2001, 2002)}) == 1
    one = spark.createDataFrame([(1000 - 3, 1), (2003, 1), (None, 1), (2004, None), (99_999, 0)], "doc_id long, toxic int")
    assert len(toxicity.score(docs, one).collect()) == len(ROWS)
    assert toxicity.score(docs.limit(0), one).collect() == []
    known, labels, *_ = taught
    rated = toxicity.score(known.unionByName(docs), cases.clash(labels))
    by_text = {}
    for i, text, s in rated.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", "score").collect():
        by_text.setdefault((i, text), set()).add(s)
    assert rated.filter("score is null").count() == 0
    same = [r["score"] for r in rated.filter("doc_id in (2003, 2004)").collect()]  # equal texts
    assert len(same) >= 2


def test_parts_join_to_the_text():
    r = random.Random(1)
    for size in (1, 7, 50):
        for text in ("", "a", "word " * 40, "x" * 200, "".join(r.choice("ab é\n") for _ in range(500))):
            assert "".join(toxicity.parts(text, size)) == text


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_toxicity_by_held_out_labels(spark):
    """On sf0.1 only English documents have words that mark them; the labels of the others follow nothing in their texts."""
    truth = spark.read.parquet(f"{SF}/labels.parquet").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = queries.op11_toxicity(spark, SF).filter("held_out").join(truth, "doc_id").collect()
    clean, bad = [r for r in rows if not r["toxic"]], [r for r in rows if r["toxic"] and r["lang"] == "en"]
    assert np.mean([r["predicted"] for r in clean]) < 0.03
    assert np.mean([r["predicted"] for r in bad]) > 0.9
