from collections import Counter

import pytest

from tests.llm import cases


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    rows = cases.documents()
    cases.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    numbers = [len(rows)]
    for k, (_, stage) in enumerate(p.STAGES):
        from tidegauge.llm.common import cut

        before, docs = docs, cut(stage(spark, docs, str(tmp_path)))
        numbers.append(docs.count())
        if k < 4:
            assert docs.columns == p.COLUMNS and numbers[-1] > 0
        if k == 1:
            kept = [(x.doc_id, x.text) for x in docs.collect()]
            # By brute force over the distinct rows, numbered in order of id.
            old = sorted({(cases.order(x.doc_id), x.text or "") for x in before.collect()})
            firsts = {n if c is None or not t.split() else c for (n, _, c), (_, t) in zip(sorted(cases.components([(j, t) for j, (_, t) in enumerate(old)], 5, 80, 100)), old, strict=True)}
            assert Counter(cases.order(i) for i, _ in kept) == Counter(old[c][0] for c in firsts) and len(kept) == len(set(kept))
        if k == 3:
            assert {x.doc_id for x in docs.collect()} == {x.doc_id for x in before.collect()} and numbers[-1] <= 2 * numbers[-2]
    assert numbers[2] < numbers[1] and set(docs.columns) >= {"sequence_id", "offset", "length"}
    assert p.run(spark, str(tmp_path)).count() == numbers[-1]


def test_stages_of_nothing(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    docs = spark.createDataFrame([], cases.SCHEMA)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_near_duplicates_by_row(spark):
    import corpus_pipeline as p

    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [
        (1, text("a")), (None, text("a") + " end"), (None, text("b")), (None, text("c")), (None, text("c") + " end"), (None, None), (None, ""),
        (5, text("a") + " more"), (5, text("d")), (5, text("d")), (7, text("d") + " end"), (5, text("e")),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], cases.SCHEMA).repartition(3)
    kept = sorted(((x.doc_id, x.text) for x in p.near_duplicates(spark, docs, "").collect()), key=repr)
    one_c = [x for x in kept if x[1] and x[1].startswith("c")]
    assert len(one_c) == 1 and one_c[0] in rows
    assert [x for x in kept if x not in one_c] == sorted([(1, text("a")), (None, text("b")), (None, None), (None, ""), (5, text("d")), (5, text("e"))], key=repr)


def test_stages_ignore_other_columns(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    docs = cases.frame(spark, [(k, " ".join(f"w{k % 7}x{j}" for j in range(40)), "en", f"s{k % 2}", 1) for k in range(30)])
    for name, stage in p.STAGES:
        one, two = (sorted(map(repr, (tuple(r) for r in stage(spark, x, "").select("doc_id").collect()))) for x in (docs, cases.clash(docs)))
        assert one == two and one, name


def test_stages_with_a_very_long_text(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    text = " ".join(f"word{j}" for j in range(150_000))
    docs = cases.frame(spark, [(1, text, "en", "a", None), (2, text, "en", "a", None), (3, "short one.", "en", "b", None)])
    for name, stage in p.STAGES[1:]:
        ids = {x.doc_id for x in stage(spark, docs, "").select("doc_id").distinct().collect()}
        assert ids == ({1, 3} if name in ("near duplicates", "passages") else {1, 2, 3}), name
