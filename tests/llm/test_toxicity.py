import random

from pyspark.sql import functions as F

from notegraph.llm import toxicity as T


def distance(a, b):
    """Edits and swaps of neighbours (each place edited once)."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_distance():
    rng = random.Random(1)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 11))): 1.0 for _ in range(30)}
    for states in (10**6, 50):
        s = T.Lexicon(max_states=states, fixed=frozenset(terms))
        auto = T.Automaton(terms, s)
        for _ in range(3000):
            w = list(rng.choice(list(terms)) if rng.random() < 0.6 else "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "d"])
            w = "".join(w)
            near = [t for t in terms if distance(w, t) <= (len(t) >= 4) + (len(t) >= 8)]
            found = auto.match(w)
            assert (found is None) == (not near), w
            if near:
                assert found[1] == min(distance(w, t) for t in near) and found[0] in near


def test_misspellings_of_each_kind():
    scorer = T.Scorer({t: 1.0 for t in T.INSULTS.split()}, frozenset(["food", "pool"]), T.Lexicon())
    spelled = "scumm fuk shiit idoit mroon idi0t sh1t st*pid m_o_ron worthles imbecille patheticc wrothless diskgusting stupid-looking idiot2"
    for w, x in zip(spelled.split(), scorer.features([f"such a {w} here" for w in spelled.split()]), strict=True):
        assert x[8] >= 1, w
    clean = "food pool that there window yesterday 2024 well-known x86 mother"
    assert not any(x[8] for x in scorer.features(clean.split()))
    (many, long) = scorer.features(["you idiot " * 25, "a" * 100000 + " moron"])
    assert many[8] == 25 and long[8] == 1


def test_quotation_and_abuse_are_told_apart():
    scorer = T.Scorer({"idiot": 1.0}, frozenset(), T.Lexicon())
    abuse, quoted, spelled, clean, empty, none = scorer.features(["you are an idiot", 'he said "idiot" was the word', "such an idiott here", "a fine day", "", None])
    assert abuse[4] > 0 and abuse[3] == 0 and quoted[3] > 0 and quoted[4] == 0
    assert spelled[0] == 0 and spelled[1] > 0 and not any(clean) and not any(empty) and not any(none)


def test_held_out_scores_and_odd_rows(spark, docs_of):
    rng = random.Random(2)
    rows, labels = [(900, None), (901, ""), (902, "é " * 20000)], [(900, 0, 1), (901, 1, 0), (5555, 1, 1), (None, 1, 1)]
    for i in range(400):
        words = [f"w{rng.randrange(200)}x".replace("0", "o").translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["gruntlewart", "blorgface", "gruntlewarts"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows.append(rows[-1])
    docs, table = docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = T.digest(docs, table)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = [(r.predicted == (r.doc_id % 5 == 0)) for r in got if r.doc_id < 400 and r.held_out]
    assert len(right) > 60 and sum(right) / len(right) > 0.97
    lone = T.digest(docs, table.where("false"))
    assert lone.count() == len(rows) and T.digest(docs_of([]), table).count() == 0
    assert out.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0
