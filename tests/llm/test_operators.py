import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidegauge.llm import chat, chunks, fingerprints, graph, mixing, neighbours, ngrams, packing, quality, sharding, suffixes

ROWS = cases.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 1 and 5: against brute force

@pytest.mark.parametrize("words,num", [(3, 90), (5, 80), (2, 50)])
def test_near_duplicates(docs, words, num):
    assert tuples(ngrams.near_duplicates(docs, words, num, 100)) == cases.components(ROWS, words, num, 100)


def test_near_duplicates_among_many_near_copies(spark):
    r = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        w = list(base)
        for p in r.integers(0, 60, r.integers(0, 4)):
            w[p] = f"x{r.integers(0, 40)}"
        rows.append((int(k * 7 % 151), " ".join(w), "", "", 0))
    rows += [(1000 + k, " ".join(base[: 4 + k]), "", "", 0) for k in range(8)]
    for words, num in ((3, 90), (1, 80), (5, 80)):
        assert tuples(ngrams.near_duplicates(cases.frame(spark, rows), words, num, 100)) == cases.components(rows, words, num, 100)


@pytest.mark.parametrize("words,num", [(3, 90), (1, 80)])
def test_near_duplicates_among_texts_of_a_template(spark, words, num):
    """Texts with slots of many widths, whose fillings are unique, rare or frequent: some pairs link, most are just not alike enough."""
    r = np.random.default_rng(11)
    rows = []
    for k in range(240):
        w = [f"t{j}" for j in range(100 + k % 3)]
        at, wide, kind = int(r.integers(0, 80)), int(r.integers(0, 9 if words == 3 else 20)), k % 4
        filling = {0: f"u{k}", 1: f"r{k // 12}", 2: f"f{r.integers(0, 3)}", 3: f"m{k // 60}"}[kind]
        w[at : at + wide] = [f"{filling}x{j}" for j in range(wide)]
        if k % 5 == 0:
            w[90:92] = ["at", f"p{k % 7}"]
        rows.append((int(k * 11 % 241), " ".join(w), "", "", 0))
    assert tuples(ngrams.near_duplicates(cases.frame(spark, rows), words, num, 100)) == cases.components(rows, words, num, 100)
    expected = cases.components(rows, words, num, 100)
    assert 5 < len({c for _, _, c in expected}) < 235


@pytest.mark.parametrize("length", [50, 20, 7])
def test_substrings(docs, length):
    assert tuples(suffixes.remove_repeats(docs, length)) == cases.substrings(ROWS, length)


EXTREMES = [
    [None, 2**63 - 1, 5, -3],  # the largest id beside nulls
    [None, 2**63 - 1, -(2**63), 1 - 2**63],  # and the smallest
    [2**63 - 1, 2**63 - 2, 0, 1],
]


@pytest.mark.parametrize("ids", EXTREMES)
def test_extreme_ids(spark, ids):
    passage = " ".join(f"word{k}" for k in range(40))
    rows = [(i, passage + f" tail{k % 2}", "", "", 0) for k, i in enumerate(ids)] + [(i, f"other {i} text", "", "", 0) for i in ids]
    df = cases.frame(spark, rows)
    assert tuples(ngrams.near_duplicates(df, 3, 90, 100)) == cases.components(rows, 3, 90, 100)
    assert tuples(suffixes.remove_repeats(df, 50)) == cases.substrings(rows, 50)
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed) for x in chunks.remove_passages(df).collect()), key=repr)
    assert Counter(i for i, *_ in got) == Counter(2 * ids) and sum(r == 0 for _, n, r in got if n > 100) == 1


def test_keys_of_many_bytes(docs, monkeypatch):
    """As many bytes as a hundred terabytes ask for, and equal first halves of different keys."""
    import dataclasses

    sizes = suffixes.B.sizes
    monkeypatch.setattr(suffixes.B, "sizes", lambda *a, **k: dataclasses.replace(sizes(*a, **k), n_keys=8e12))
    assert tuples(suffixes.remove_repeats(docs, 50)) == cases.substrings(ROWS, 50)
    assert suffixes.B.Sizes(25_000_000, 1_000_000, 8e12).width(True) >= 9
    n = suffixes.B.Sizes(3, 3, 10.0)
    keys, more, own = np.array([7, 7, 5, 7, 7], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64), np.array([0, 0, 1, 1, 2])
    sent = suffixes.B.Sending(keys, own, n, more)
    assert len(sent.keys) == 3 and sent.of[0] == sent.of[3] and sent.of[1] == sent.of[4] and sent.first[sent.of].tolist() == [0, 0, 1, 0, 0]


def test_width_keeps_its_promise():
    for n_keys, buckets in ((1e3, 4), (1e9, 700), (1e12, 1e5), (8e12, 1e6)):
        n = suffixes.B.Sizes(buckets, buckets, n_keys)
        assert n_keys * n_keys / 2 / 2 ** (8 * n.width(True)) / buckets < 1 / 256


@pytest.mark.parametrize("num", [50, 67, 80, 90])
def test_keys_cover_every_link(num):
    """Sets that link share a key, whatever class their tokens are in."""
    r = np.random.default_rng(1)
    bounds = ngrams.size_classes(num, 100)
    level_of = {int(t): int(r.integers(1, 8)) for t in range(1, 400)}
    linked = 0
    for _ in range(300):
        a = r.choice(np.arange(1, 400), r.choice([r.integers(1, 12), r.integers(1, 120)]), replace=False)
        b = np.union1d(r.choice(a, max(1, int(len(a) * r.uniform(num / 100, 1))), replace=False), r.choice(np.arange(1, 400), r.integers(0, 6)))
        s = len(np.intersect1d(a, b))
        if 100 * s < num * (len(a) + len(b) - s):
            continue
        linked += 1
        keys = []
        for x in (a, b):
            t = np.unique(x).astype(np.uint64)
            keys.append(set(ngrams.index_keys(t, np.array([level_of[int(v)] for v in t], np.uint8), num, 100, bounds).tolist()))
        assert keys[0] & keys[1]
    assert linked > 50


# --- 2

def test_quality_learns_without_labels(spark):
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(2, 8)))
    prose = lambda: ". ".join(" ".join(word() for _ in range(8)) for _ in range(8)) + "."
    rows = [(k, prose(), "", "", 0) for k in range(300)]
    rows += [(400 + k, " ".join(word() + "%%$$#" for _ in range(40)), "", "", 0) for k in range(20)] + [(500 + k, " ".join([word()] * 60), "", "", 0) for k in range(12)] + [(600 + k, prose().upper(), "", "", 0) for k in range(15)]
    got = {x.doc_id: x.keep for x in quality.score(cases.frame(spark, rows)).collect()}
    assert sum(got[k] for k in range(300)) >= 297 and sum(got[k] for k in got if k >= 400) <= 2


def test_quality_edges(spark, docs):
    got = quality.score(docs)
    assert got.count() == len(ROWS) and got.columns[:5] == ["doc_id", "votes", "label", "score", "keep"]
    by_text = defaultdict(set)
    for x in got.collect():
        assert 0 <= x.score <= 1
        by_text[x.text].add(x.score)
    assert all(len(v) == 1 for v in by_text.values())


def simulated(r, n=20_000, noisy=0.15):
    """Votes of six labellers on good texts and two kinds of bad ones with known chances; one labeller is often wrong."""
    chance = np.array([[0.002, 0.004, 0.003, 0.002, noisy, 0.01], [0.9, 0.8, 0.01, 0.01, 0.5, 0.02], [0.01, 0.02, 0.85, 0.95, 0.3, 0.02]])
    kind = r.choice(3, n, p=[0.9, 0.06, 0.04])
    votes = np.where(r.random((n, 6)) < 0.1, 0, np.where(r.random((n, 6)) < chance[kind], 2, 1))
    return chance, kind, votes


def test_label_model_recovers_known_accuracies():
    chance, kind, votes = simulated(np.random.default_rng(1))
    code = (votes * 3 ** np.arange(6)).sum(1)
    codes, first, n = np.unique(code, return_index=True, return_counts=True)
    share, found, own = quality.latent_classes(votes[first], n.astype(float))
    good = (found > 0.5).sum(1) < 2  # a labeller's own errors may make a class, too
    assert np.allclose(share[good] @ found[good] / share[good].sum(), chance[0], atol=0.01) and abs(share[good].sum() - 0.9) < 0.01
    for k in (1, 2):  # each kind is one of the classes, or several alike
        near = [j for j in range(1, 7) if not good[j] and (found[j] > 0.5).tolist()[:4] == (chance[k] > 0.5).tolist()[:4]]
        assert np.allclose(share[near] @ found[near] / share[near].sum(), chance[k], atol=0.1) and abs(share[near].sum() - (0.06, 0.04)[k - 1]) < 0.01
    # Brute force: the posterior under the true chances.
    p = np.array([0.9, 0.06, 0.04])[:, None] * np.stack([np.where(votes == 2, c, np.where(votes == 1, 1 - c, 1)).prod(1) for c in chance])
    exact = p[0] / p.sum(0)
    label = np.array([quality.label_model(dict(zip(codes.tolist(), n.tolist())), 6)[c] for c in codes.tolist()])[np.searchsorted(codes, code)]
    assert np.mean((label > 0.5) == (exact > 0.5)) > 0.98  # lone votes that are right are the difference
    wrong, any_bad = np.mean((label > 0.5) != (kind == 0)), np.mean((votes != 2).all(1) != (kind == 0))
    assert wrong < 0.02 < 0.1 < any_bad  # one vote against is no verdict


def test_silent_labellers_say_nothing():
    chance, kind, votes = simulated(np.random.default_rng(2))
    code = (votes * 3 ** np.arange(6)).sum(1)
    codes, n = np.unique(code, return_counts=True)
    p = quality.label_model(dict(zip(codes.tolist(), n.tolist())) | {0: 50}, 6)
    assert 0.8 < p[0] < 0.95  # the share of good texts


# --- 3

def test_shards(docs):
    rows = sharding.shard(docs, 4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in rows) == want
    total = sum(x["size"] for x in rows)
    by = defaultdict(list)
    for x in rows:
        by[x.shard].append(x)
    longest = max(x["size"] for x in rows)
    for s, held in by.items():
        assert sorted(x.slot for x in held) == list(range(len(held))) and abs(sum(x["size"] for x in held) - total / 4) <= longest
    line = sorted(rows, key=lambda x: x.start_byte)
    assert [x.shard for x in line] == sorted(x.shard for x in rows) and [cases.order(x.doc_id) for x in line] == sorted(cases.order(x.doc_id) for x in rows)
    assert [x.start_byte for x in line] == np.cumsum([0, *(x["size"] for x in line)])[:-1].tolist()


# --- 4

def test_packing(docs, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    rows = packing.pack(docs, vocabulary, 256).collect()
    want = Counter()
    for i, text, *_ in ROWS:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for p, at in enumerate(range(0, len(ids), 256)):
            want[(i, p, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes()))] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows) == want
    seqs = defaultdict(list)
    for x in rows:
        seqs[x.sequence_id].append((x.offset, x.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(seqs) <= 1.03 * sum(x.length for x in rows) / 256 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_histogram(seed):
    r = np.random.default_rng(seed)
    lengths = Counter(r.integers(1, 129, 3000).tolist() + [128] * 1000)
    groups = packing.plan(dict(lengths), 128)
    held = Counter()
    for took, n in groups:
        assert sum(took) <= 128 and n > 0
        for x in took:
            held[x] += n
    assert held == lengths and sum(n for _, n in groups) <= 1.02 * sum(k * n for k, n in lengths.items()) / 128 + 1
    assert packing.plan({}, 128) == []


def test_patterns_place_most_pieces():
    r = np.random.default_rng(9)
    lengths = Counter(np.minimum(512, np.maximum(1, r.gamma(1.6, 110, 20_000))).astype(int).tolist())
    groups, placed = packing.fit(dict(lengths), 512, *packing.GRIDS[0])
    bound = -(-sum(k * n for k, n in lengths.items()) // 512)
    small = sum(n for k, n in lengths.items() if k < 512 / packing.SMALL)
    assert placed > 0.75 * (lengths.total() - small) and sum(n for _, n in groups) <= 1.002 * bound + 1


def test_other_tokenizers_encode_whole_texts():
    """A vocabulary that keeps case, blanks or word ends in its ids must not be split at words."""
    names = pytest.importorskip("public_tokenizers")
    import glob
    import os

    from tokenizers import Tokenizer

    folder = os.path.dirname(names.path("word_bpe_49k.json"))
    texts = [*packing.PROBES, "Some Other Words, with  blanks\n and\ttabs, don't they? 10,000.50 caf\u00e9"]
    found = 0
    for path in sorted(glob.glob(f"{folder}/*.json")):
        try:
            t = Tokenizer.from_file(path)
        except Exception:
            continue  # a table of another library
        e = packing.Encoder(path)
        found += not e.by_words
        for text, got in zip(texts, e([x.encode() for x in texts])):
            assert got.tolist() == t.encode(text, add_special_tokens=False).ids, (path, text)
    assert found


def test_nnls():
    r = np.random.default_rng(0)
    a, x = r.random((20, 8)), np.array([0, 1, 0, 2, 0, 0, 3, 0.5])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


def test_encoder_forgets_and_still_agrees(vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SLOTS", 9)
    t, e = Tokenizer.from_file(vocabulary), packing.Encoder(vocabulary)
    for k in range(20):
        texts = [f"Word{k} Ünï{j}. don't, 12 İ. {'x' * j}!? \t<|endoftext|> a\x1cb ¼ {k}word{j}" for j in range(12)]
        for text, got in zip(texts, e([x.encode() for x in texts]), strict=True):
            assert got.tolist() == t.encode(text, add_special_tokens=False).ids


def test_encoder_of_a_slice_larger_than_the_table(vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SLOTS", 9)
    monkeypatch.setattr(packing, "POOL", 64)
    t, e = Tokenizer.from_file(vocabulary), packing.Encoder(vocabulary)
    run = "".join(f"q{k}Z" for k in range(200))  # ids of one word that the table cannot hold
    many = " ".join(f"{k}x{k}" for k in range(600))  # more words than the table has slots
    for texts in (["known words."], [f"known {run} words."], ["known new"], [f"known {many}", run, "", many], ["known words."]):
        for text, got in zip(texts, e([x.encode() for x in texts]), strict=True):
            assert got.tolist() == t.encode(text, add_special_tokens=False).ids


# --- 6

def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    size = defaultdict(int)
    for _, t, _, s, _ in ROWS:
        size[s] += len((t or "").encode().split())
    got, goal = defaultdict(int), {}
    source = {}
    for i, t, _, s, _ in ROWS:
        source.setdefault((i, len((t or "").encode().split())), set()).add(s)
    assert sum(x.taken for x in rows) == pytest.approx(1.5 * sum(size.values()), abs=len(size))
    for x in rows:
        assert 0 <= x.taken <= 2 * x["size"] and x.target <= 2 * x.source_size + 1e-6
        assert len(x.shards) == -(-x.taken // x["size"]) if x["size"] else not x.shards
    counts = Counter(s for x in rows for s in x.shards)
    assert max(counts.values()) - min(counts.values()) <= 1
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda x: (repr(x.doc_id), x["size"], x.taken, tuple(x.shards))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_targets(spark):
    sizes = {"a": 100, "b": 100, "c": 1000, None: 50}
    rows = spark.createDataFrame([(s, ("1" if s is None else "0") + (s or ""), n) for s, n in sizes.items()], "source string, skey string, size long")
    got = {x.source: x.target for x in mixing.targets(rows).collect()}
    # a and b and null are full at twice their size, c takes the rest.
    assert got == {"a": 200.0, "b": 200.0, None: 100.0, "c": 1.5 * 1250 - 500}


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by sharing what is left among the sources that are not full, until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


@pytest.mark.parametrize("seed", range(3))
def test_mix_by_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    names = [*(f"s{k}" for k in range(9)), None, ""]
    rows = [(int(k), " ".join(["w"] * int(r.integers(0, 30) ** (1 + k % 2))), "", names[int(r.integers(0, 11) * r.random())], 0) for k in range(300)]
    rows += rows[:20]  # ties: rows that are equal in all
    got = mixing.mix(cases.frame(spark, rows)).join(spark.createDataFrame([(r[0], r[3]) for r in rows[:300]], "doc_id long, s string"), "doc_id").collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    goal, taken, parts = water(sizes), defaultdict(int), Counter()
    for x in got:
        assert x.source_size == sizes[x.s] and x.target == pytest.approx(goal[x.s])
        taken[x.s] += x.taken
        parts[x.s] += bool(x["size"]) and x.taken % x["size"] > 0
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.5 + 1e-6 and parts[s] <= 1  # one document at most is taken in part
    blocks = mixing.mixed_rows(mixing.mix(cases.frame(spark, rows))).collect()
    assert len(blocks) == sum(len(x.shards) for x in got) and {b.shard for b in blocks} == set(range(8))
    first = [b.doc_id for b in sorted(blocks, key=lambda b: b["at"]) if b.shard == 0]
    assert len(first) > 10 and first != sorted(first)


def test_split_tree_is_exact_and_fair(spark):
    q = spark.createDataFrame([("0a", 700), ("0b", 300), ("0c", 1), ("1", 23)], "skey string, blocks long")
    begins = {x.skey: [*x.begins] for x in mixing.split_tree(q, 8, 1).collect()}
    blocks = {"0a": 700, "0b": 300, "0c": 1, "1": 23}
    per = np.array([np.diff([*begins[k], blocks[k]]) for k in blocks])
    assert (per >= 0).all() and per.sum(0).tolist() == [128] * 8
    means = np.mean([np.diff([*{x.skey: x.begins for x in mixing.split_tree(q, 2, s).collect()}["0a"], 700])[0] for s in range(12)])
    assert abs(means - 350) < 15


# --- 7

def test_passages(spark, docs):
    got = {(x.doc_id, x.text_hash): x for x in chunks.remove_passages(docs).collect()}
    passage = next(t for i, t, *_ in ROWS if i == 2010)
    keeps = sum(passage[60:200] in x.kept_text for x in got.values())
    assert sum(passage in (t or "") for _, t, *_ in ROWS) > 5 and keeps == 1
    texts = {i: t for i, t, *_ in ROWS}
    for (i, _), x in got.items():
        if i in texts and x.n_removed == 0 and i not in (2010, 2011, None):
            assert x.kept_text == (texts[i] or "")


def test_chunks_resist_insertions():
    r = np.random.default_rng(3)
    a = bytes(r.integers(97, 123, 20_000, dtype=np.uint8))
    b = a[:7000] + b"inserted" + a[7000:]
    def pieces(t):
        e = [0, *chunks.chunked([b"other text", t], 12, 256)[1]]
        assert e[-1] == len(t) and e == chunks.chunked([t], 12, 256)[0][:0] + [0, *chunks.chunked([t], 12, 256)[0]]
        return [t[x:y] for x, y in zip(e, e[1:])]
    assert len(set(pieces(a)) - set(pieces(b))) <= 3


def brute_chunks(rows, apart=12, most=256, passage=64):
    """Passage removal byte by byte: the gear hash by its sum, a cut where it is the largest of its neighbourhood."""
    def ends_of(b):
        h = [sum(int(chunks._GEAR[b[k - j]]) << j for j in range(32) if k - j >= 0) % 2**32 for k in range(len(b))]
        silent = lambda k: h[k] if 0 <= k < len(b) else tail(k, b)
        cuts = set()
        for k in range(len(b)):
            if all(h[k] > silent(k - j) for j in range(1, apart + 1)) and all(h[k] >= silent(k + j) for j in range(1, apart + 1)):
                at = k + 1
                for _ in range(3):
                    at += at < len(b) and b[at] & 0xC0 == 0x80
                if at < len(b):
                    cuts.add(at)
        return [*sorted(cuts), len(b)] if b else []

    def tail(k, b):
        if k < 0:
            return 0
        return sum(int(chunks._GEAR[b[k - j]]) << j for j in range(32) if 0 <= k - j < len(b)) % 2**32

    held, least = [], {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        e = chunks._split(np.frombuffer(b, np.uint8), ends_of(b), most) if b else []
        parts = [b[x:y] for x, y in zip([0, *e], e)]
        held.append((i, b, parts))
        for p in parts:
            least[p] = min(least.get(p, cases.LAST + 1), cases.order(i))
    out = []
    for i, b, parts in held:
        runs, kept, removed, spans = [], b"", 0, 0
        for p in parts:
            gone = least[p] < cases.order(i)
            if runs and runs[-1][0] == gone:
                runs[-1][1] += p
            else:
                runs.append([gone, p])
        for gone, p in runs:
            if gone and (len(p) >= passage or p == b):
                removed, spans = removed + len(p), spans + 1
            else:
                kept += p
        out.append((i, len(b), len(parts), removed, spans, kept.decode()))
    return sorted(out, key=repr)


def test_passages_by_brute_force(docs):
    got = chunks.remove_passages(docs).select("doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept_text")
    assert tuples(got) == brute_chunks(ROWS)


# --- 8

def brute(vectors, k):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    out = {}
    for i, v in vectors:
        if i % 20 == 0:
            s = x @ np.array(v, float)
            keep = ids != i
            o = np.lexsort((ids[keep], -s[keep]))[:k]
            out[i] = list(zip(ids[keep][o].tolist(), s[keep][o].tolist()))
    return out


def test_neighbours_recall(spark):
    r = np.random.default_rng(8)
    vectors = [(int(i), (r.standard_normal(32) + (i % 5) * 0.5).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for x in neighbours.search(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    want = brute(vectors, 20)
    hits = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [k for k, _, _ in mine] == list(range(1, 21)) and all(v != q for _, v, _ in mine)
        scores = [s for _, _, s in mine]
        assert scores == sorted(scores, reverse=True)
        hits += len({v for _, v, _ in mine} & {v for v, _ in best})
    assert hits / (20 * len(want)) >= 0.9


def test_neighbours_edges(spark):
    same = [0.6, 0.8]
    rows = [(k, same) for k in range(100)] + [(200, [0.0, 0.0]), (201, None), (202, [float("nan"), 1.0]), (203, [1.0, None]), (204, [float("inf"), 1.0]), (None, same), (206, [1.0, 0.0, 0.0]), (220, [1.0, 0.0]), (5, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in neighbours.search(df, df.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    assert set(got) == {0, 20, 40, 60, 80, 220}
    assert [v for v, _ in got[0]] == list(range(1, 21)) and [v for v, _ in got[20]] == [*range(20)] and [v for v, _ in got[60]] == list(range(20))
    assert [v for v, _ in got[220]] == list(range(20)) and got[220][0][1] == 0.6
    few = df.filter("vec_id in (1, 20, 220)")
    assert [(x.query_id, x.vec_id) for x in neighbours.search(few, few.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()] == [(20, 1), (20, 220), (220, 1), (220, 20)]
    assert neighbours.search(df.filter("vec_id = 200"), df, 20).count() == 0


# --- 9

def test_fingerprints(docs):
    rows = fingerprints.edited_and_fingerprinted(docs).collect()
    assert len(rows) == len(ROWS)
    by = defaultdict(set)
    exact = {}
    line = sorted({(cases.order(i), t or "") for i, t, *_ in ROWS}, key=lambda x: -x[0])
    unique = [i for i, n in Counter(i for i, _ in line).items() if n == 1]
    for k, (i, t) in enumerate(line):
        nxt = line[(k + 1) % len(line)]
        if i in unique and nxt[0] in unique:
            half = len(t) // 2
            exact[i] = (t, t[: len(t) - half] + nxt[1][:half])
    for x in rows:
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        if x.doc_id in exact:
            t, e = exact[x.doc_id]
            assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            by[t].add(x.fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) > 0.9 * len(by)


def test_fingerprint_likeness_is_generalised_jaccard(spark):
    r = np.random.default_rng(4)
    rows, want = [], []
    for k in range(60):
        a = [f"t{x}" for x in r.integers(0, 30, 200)]
        b = a[:100] + [f"t{x}" for x in r.integers(0, 30, 100)]
        rows.append((k, " ".join(a), " ".join(b)))
        x, y = cases.bag(rows[-1][1]), cases.bag(rows[-1][2])
        want.append(sum((x & y).values()) / sum((x | y).values()))
    fp = fingerprints.signatures(spark.createDataFrame(rows, "k long, a string, b string"), ["k"], ["a", "b"], 32)
    got = fp.select(fingerprints.likeness(F.col("a_fp"), F.col("b_fp"), 32).alias("x")).agg(F.avg("x")).first()[0]
    assert got == pytest.approx(np.mean(want), abs=0.03)


def test_likeness_of_each_pair(docs):
    """At the production number of samples every likeness lies within chance of the exact similarity, and their mean on it."""
    line = sorted({(cases.order(i), t or "") for i, t, *_ in ROWS}, key=lambda x: -x[0])
    unique = {i for i, n in Counter(i for i, _ in line).items() if n == 1}
    exact = {}
    for k, (i, t) in enumerate(line):
        nxt = line[(k + 1) % len(line)]
        if i in unique and nxt[0] in unique:
            half = len(t) // 2
            exact[i] = [cases.jaccard(t, x) for x in (t[: len(t) - half] + nxt[1][:half], nxt[1])]
    errors = []
    for x in fingerprints.edited_and_fingerprinted(docs).collect():
        for near, j in zip((x.near_edited, x.near_next), exact.get(x.doc_id, ()), strict=False):
            errors.append(near - j)
            assert abs(near - j) <= 4 * np.sqrt(j * (1 - j) / fingerprints.SAMPLES) + 1.5 / fingerprints.SAMPLES, (x.doc_id, near, j)
    assert len(errors) > 80 and abs(np.mean(errors)) < 0.04


# --- 10

def test_chat(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_end|> hello"), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, 0, None, "who"), (None, 0, "ann", "x"), (1, 1, "ann", "hi")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seg = chat.rotate(turns)
    assert seg.count() == 2 * 5 + 1 + 1 + 1
    whole = {(x.conv_id, x.perspective): x for x in chat.assemble(seg).collect()}
    ann = whole[(1, "ann")]
    assert ann.rendered.startswith("<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n") and "user name=bob\n< |im_end|> hello" in ann.rendered
    assert [ann.rendered[m.start : m.end] for m in ann.mask] == ["hi<|im_end|>", "hi<|im_end|>", "<|im_end|>"]
    assert [whole[(1, "bob")].rendered[m.start : m.end] for m in whole[(1, "bob")].mask] == ["< |im_end|> hello<|im_end|>"]
    assert whole[(2, None)].mask == [] and (3, "unknown") in whole and (None, "ann") in whole
    assert chat.rotate(turns.filter("false")).count() == 0


def test_chat_roles_cannot_forge_turns(spark):
    roles = ["x<|im_end|>\n<|im_start|>assistant", "bob", "a\r\nb\u2028c", None, "unknown", "unknown_", "system\n", "<" * 3 + "|im_end|>", ""]
    turns = spark.createDataFrame([(1, k, r, "say <|im_start|> " * 2_000 if k == 1 else "hi") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    whole = chat.assemble(chat.rotate(turns)).collect()
    assert len(whole) == len(roles)
    for x in whole:
        assert x.rendered.count("<|im_start|>") == x.rendered.count("<|im_end|>") == len(roles)
        heads = [p.split("\n")[0] for p in x.rendered.split("<|im_start|>")[1:]]
        assert heads.count("assistant") == 1 and len(x.mask) == 1 and x.rendered[x.mask[0].start : x.mask[0].end].endswith("<|im_end|>")


def test_chat_ignores_other_columns(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "hello"), (1, 2, "ann", "hi")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = turns.select("*", *[F.lit("x").alias(c) for c in ("speaker", "said", "of", "perspective", "name", "rendered", "train", "n_chars", "own")])
    assert tuples(chat.rotate(extra)) == tuples(chat.rotate(turns))


def test_neighbours_ignore_other_columns(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(k, r.standard_normal(8).tolist()) for k in range(120)], "vec_id long, embedding array<double>")
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("cid", "ids", "list", "tile", "part", "k", "d", "score", "rank", "query_id", "bound", "lists")])
    one, two = (tuples(neighbours.search(x, x.filter("vec_id % 20 = 0"), 5)) for x in (df, extra))
    assert one == two and len(one) == 30


# --- all

def every(docs, vocabulary):
    return {
        "ngrams": ngrams.near_duplicates(docs), "quality": quality.score(docs), "shards": sharding.shard(docs), "packing": packing.pack(docs, vocabulary), "suffixes": suffixes.remove_repeats(docs),
        "mix": mixing.mix(docs), "chunks": chunks.remove_passages(docs), "fingerprints": fingerprints.edited_and_fingerprinted(docs),
    }


def test_empty_tables(spark, vocabulary):
    for name, df in every(spark.createDataFrame([], cases.SCHEMA), vocabulary).items():
        assert df.count() == 0, name


def test_one_document(spark, vocabulary):
    for name, df in every(spark.createDataFrame([(7, "just one of them", "en", "s", 16)], cases.SCHEMA), vocabulary).items():
        assert [x.doc_id for x in df.collect()] == [7], name


def test_clashing_columns(spark, docs, vocabulary):
    plain, extra = every(docs, vocabulary), every(cases.clash(docs), vocabulary)
    for name, df in extra.items():
        cols = plain[name].columns
        if name == "quality":
            cols = ["doc_id", "votes", "label", "score", "keep"]
        assert tuples(df.select(cols)) == tuples(plain[name].select(cols)), name


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (100, 102), (200, 200)]
    got = {x.doc: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
