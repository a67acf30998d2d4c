import random

import corpus_pipeline
from notegraph.llm import decontaminate, minhash, quality_rules

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[:5] == before.columns[:5]
        assert (len(docs.columns) == 5) == (n < 4)
        counts.append(docs.count())
        if name == "quality_rules":
            judged = quality_rules.digest(before)
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in judged.where("kept").collect()}
        if name == "near_duplicates":
            assert minhash.near_duplicates(docs).where("not kept").count() == 0
        if name == "decontamination":
            assert decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
            assert counts[-1] < counts[-2]
        if name == "secret_scan":
            assert docs.where("text like '%<SECRET>%'").count() > 5
            assert docs.where(r"text rlike 'token = .[0-9a-f]{40}'").count() == 0
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] == counts[5] > 500


def test_odd_rows_and_empty_tables(spark, docs_of):
    rows = [(1, None), (1, ""), (None, "a b c"), (2, "This is a good line of prose, with some words in it."), (2, "This is a good line of prose, with some words in it.")]
    for docs in (docs_of(rows), docs_of([])):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()
    assert minhash.keep_one(docs_of(rows)).where("doc_id = 2").count() == 1


def test_near_duplicates_against_brute_force_at_080(spark, docs_of):
    from test_minhash import brute

    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"w{rng.random()}" for _ in range(120)]
        rows.append((100 * g, " ".join(base)))
        for n, places in enumerate(((20, 70), (50, 90), (10, 40, 80), (5, 30, 55, 100)), 1):
            own = [f"x{rng.random()}" if i in places else w for i, w in enumerate(base)]
            rows.append((100 * g + n, " ".join(own)))
    want = brute(rows, 80)
    assert any(c != i for i, (_, c) in want.items()) and want != brute(rows)
    left = corpus_pipeline.near_duplicates(spark, docs_of(rows), SF)
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_an_id_of_two_texts_loses_the_copy_alone(spark, docs_of):
    copy, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    left = corpus_pipeline.near_duplicates(spark, docs_of([(1, copy), (2, copy), (2, other), (3, None), (None, copy)]), SF)
    assert sorted(((r.doc_id or 9, r.text) for r in left.collect()), key=str) == sorted([(1, copy), (2, other), (3, None), (9, copy)], key=str)
