import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from notegraph.llm import lblm, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(90001, None), (90002, ""), (90003, " \n\t "), (90004, "a b c d e a b c d e a b c d e"), (90005, "é# x\né# x\n \n"), (90006, "w " * 30000), (90007, "line\n" * 300), (90004, "a b c d e a b c d e a b c d e")]


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_base_counts_against_brute_force(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(docs_of(ODD).select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_rules.digest(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    assert 0.7 < sum(r.kept for r in rows) / len(rows) < 0.95


def test_line_rules_clean_and_keep_columns(docs_of):
    good = "This is a plain line of prose that ends well.\nAnd another one follows it, quite long enough to stay."
    docs = docs_of([(1, good + "\nClick here to sign up"), (2, "A | B | C | D | E | F | G | H\n" * 4), (3, None)])
    out = quality_rules.keep_clean(docs)
    assert out.columns == docs.columns
    assert [(r.doc_id, r.text, r.n_chars) for r in out.collect()] == [(1, good, len(good))]
    assert quality_rules.keep_clean(docs_of([])).count() == 0


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_language_model_base_against_brute_force(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(docs_of(ODD).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(WORD.findall(low(t)) + [""])
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in rows:
        w = WORD.findall(low(t)) + [""]
        want[i] = (len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    for m in (lblm.LogBilinear(), lblm.LogBilinear(head=40, classes=16)):
        got = lblm.lm_scores(docs, m).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*want[r.doc_id][:2], n, held(r.doc_id))
            assert abs(r.base_score - want[r.doc_id][2]) < 1e-6 * max(1, abs(r.base_score)) and r.score < 0
    assert lblm.lm_scores(docs_of([])).count() == 0


def test_model_beats_the_base_whatever_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = lblm.LogBilinear(shard_tokens=40_000, head=3000, classes=256)
    got = []
    for n in (2, 16):
        rows = lblm.lm_scores(docs.repartition(n), m).collect()
        got.append({r.doc_id: r.score for r in rows})
        held_rows = [r for r in rows if r.held_out]
        assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)
    assert max(abs(got[0][i] - got[1][i]) / max(1, abs(got[0][i])) for i in got[0]) < 1e-3


def test_production_settings_beat_the_base_on_held_out_documents(spark):
    rows = lblm.lm_scores(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    # 0.1 in the decimal logarithm of each token's probability
    assert rows["sum(score)"] > rows["sum(base_score)"] + 0.1 * rows["sum(n_tokens)"]


def test_scores_are_normalised():
    rng = np.random.default_rng(0)
    m = lblm.LogBilinear(dim=4, tail=10, classes=8)
    words = lblm.Vocabulary.of(np.sort(rng.integers(1, 99, 40))[::-1].astype(float), np.array([9.0, 0.0, 16.0]), m)
    p = lblm.Params.start(words.log_noise, m, words.tail_log)
    own = lblm.Trainer(p, words, m, (1,))
    found = rng.integers(0, 43, 5000)
    w = words.table[found]
    own.learn(found, w, *lblm.context(w))
    s = lblm.Scorer.of(p, words.sizes()[words.own :])
    for w1, w2 in ((0, 0), (3, 7), (9, 1)):
        n = len(p.b)
        logs = s.log_prob(np.arange(n), np.full(n, w1), np.full(n, w2))
        assert abs(np.exp(logs).sum() - 1) < 1e-4
        of = words.table[words.own :]
        each = np.bincount(of, np.exp(s.log_within(np.arange(len(p.v)), of, np.full(len(of), w1))))
        assert len(p.v) == 43 - words.own and np.allclose(each[words.own :], 1, atol=1e-4)


def test_words_beyond_the_list_count_in_their_context(spark, docs_of):
    # 60 rare words beyond a list of 4: half follow "left", half follow "right"
    rows = [(i, " ".join(f"{side} {side[0]}{(i * 7 + j) % 30}" for j in range(30) for side in (("left", "right") if j % 2 else ("right", "left")))) for i in range(200)]
    m = lblm.LogBilinear(head=4, classes=4, buckets=16, tail=8, shard_tokens=4_000, batch=256)
    vocabulary = ["left", "right", *(f"{s}{k}" for s in "lr" for k in range(30))]
    asked = [(1000 + k, w) for k, w in enumerate([*vocabulary, "neverseen"])] + [(2000 + k, "left " + w) for k, w in enumerate([*vocabulary, "neverseen"])]
    asked = [(i if held(i) else next(j for j in range(i * 1000, i * 1000 + 999) if held(j)), t) for i, t in asked]
    score = {r.doc_id: r.score for r in lblm.lm_scores(docs_of(rows + asked), m).collect()}
    after = {t.split()[-1]: 10 ** score[i] for i, t in asked if t.startswith("left ")}
    alone = {t: 10 ** score[i] for i, t in asked if " " not in t}
    mean = lambda x, side: np.mean([x[f"{side}{k}"] for k in range(30)])
    # the context moves words beyond the list, though they share buckets
    assert mean(after, "l") / mean(after, "r") > 1.2 * mean(alone, "l") / mean(alone, "r")
    assert all(x > 0 for x in [*after.values(), *alone.values()]) and after["neverseen"] < min(after[f"l{k}"] for k in range(30))


def test_buckets_hold_every_word_beyond_the_list(spark):
    table = spark.createDataFrame([(f"w{i}", 1 + i) for i in range(900)], "word string, c bigint").repartition(5)
    lookup = lblm.Lookup([f"w{i}" for i in range(600, 900)], 32)
    n, v = lblm.bucket_counts(table, spark.sparkContext.broadcast(lookup))
    assert v.sum() == 600 and n.sum() == sum(range(1, 601)) and (v > 0).all()


def test_averages_come_through_a_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = ({r.doc_id: r.score for r in lblm.lm_scores(docs, lblm.LogBilinear(shard_tokens=2_000, fan_in=k)).collect()} for k in (3, 64))
    assert max(abs(a[i] - b[i]) / max(1, abs(a[i])) for i in a) < 1e-3


def test_a_row_of_sums_is_bounded(spark):
    """A shard's sums leave in rows of bounded size, however many words it saw."""
    m = lblm.LogBilinear(batch=4096)
    words = lblm.Vocabulary.of(np.ones(60_000), np.zeros(0), m)
    start = lblm.Params.start(words.log_noise, m, words.tail_log)
    texts = np.arange(60_000, dtype=np.int32)
    group = pa.table({"shard": pa.array([3], pa.int32()), "key": [5], "part": pa.array([0], pa.int32()), "words": [texts.tobytes()]})
    out = lblm._fitter(0, SimpleNamespace(value=start), SimpleNamespace(value=words), m)(group)
    assert max(sum(len(x) for x in r.values() if isinstance(x, bytes)) for r in out.to_pylist()) < 600_000
    at = np.concatenate([np.frombuffer(x, np.int32) for x in out.column("at").to_pylist() if x])
    assert at.tolist() == list(range(60_000 - words.own)) and set(out.column("shard").to_pylist()) == {3}


def test_parts_are_averaged_by_count(spark):
    """Each word's mean is weighted by its count, over the shards that hold it."""
    pack = lambda x, kind: np.array(x, kind).tobytes()
    rows = [lblm._sums(s, [(2, 0, b"", pack(at, np.int32), pack(n, np.int32), pack(x, np.float32))]) for s, at, n, x in ((7, [4, 9], [1, 2], [[1, 2], [3, 4]]), (6, [5, 9], [5, 6], [[5, 6], [7, 8]]))]
    group = pa.concat_tables(rows).append_column("into", pa.array([1, 1], pa.int32()))
    (r,) = lblm._averaged(group).to_pylist()
    assert (r["shard"], r["part"]) == (1, 2) and np.frombuffer(r["at"], np.int32).tolist() == [4, 5, 9]
    assert np.frombuffer(r["seen"], np.int32).tolist() == [1, 5, 8]
    assert np.frombuffer(r["moved"], np.float32).reshape(3, 2).tolist() == [[1, 2], [5, 6], [6, 7]]
    rows = [lblm._sums(s, [(0, n, pack(x, np.float64), b"", b"", b"")]) for s, n, x in ((0, 10, [1, 2]), (1, 20, [3, 4]))]
    (r,) = lblm._averaged(pa.concat_tables(rows).append_column("into", pa.array([0, 0], pa.int32()))).to_pylist()
    assert r["n"] == 30 and np.frombuffer(r["common"], np.float64).tolist() == [4, 6]


def test_listed_words_are_bounded(spark):
    table = spark.createDataFrame([(f"w{i}", 1 + (i % 7) ** 3) for i in range(700)], "word string, c bigint")
    got = lblm.listed(table, 250)
    assert len(got) == 200 and {r["c"] for r in got} == {126, 217} and lblm.listed(table.where("c = 1"), 50) == []


def test_texts_are_encoded_in_their_round_alone(spark, docs_of):
    """Every piece comes once over all rounds, where its key and part put it, long texts too."""
    m = lblm.LogBilinear(piece=8)
    docs = docs_of([(i, None if i == 3 else " ".join(f"w{j}" for j in range(i * 3))) for i in range(12)])
    lookup = spark.sparkContext.broadcast(lblm.Lookup(["w1", "w2"], 4))
    rows = [(turn, r) for turn in range(m.rounds) for r in lblm._pieces(docs, lookup, 3, m, turn).collect()]
    keys = {r.key: (r.text or "") for r in docs.selectExpr("xxhash64(doc_id, text) key", "text").collect()}
    assert sorted((r.key, r.part) for _, r in rows) == sorted((k, p) for k, t in keys.items() for p in range(-(-(len(t.split()) + 1) // 8)))
    for turn, r in rows:
        spot = (r.key * 0x9E3779B97F4A7C15 + r.part * 0xBF58476D1CE4E5B9) % 2**64 >> 20
        assert r.round == turn == spot % m.rounds and r.shard == spot // m.rounds % 3
    short = docs_of([(i, "a b") for i in range(40)])
    seen = [lblm._pieces(short, lookup, 1, m, turn).count() for turn in range(m.rounds)]
    assert sum(seen) == 40 and min(seen) > 0
