import random
import re
from itertools import combinations

from notegraph.llm.minhash import MinMax, near_duplicates
from notegraph.llm.paragraphs import remove_repeats, repeated_paragraphs, split_paragraphs
from notegraph.llm.scratch import Scratch


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for a, b in {p for ids in where.values() for p in combinations(sorted(ids), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    have = near_duplicates(docs)
    assert got(have) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in have.collect())


def test_chains_and_odd_rows(docs_of):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE  two"), (5, "three")]
    chain = list(base)
    for i in range(40):
        rows.append((10 + i, " ".join(chain)))
        chain = list(chain)
        for _ in range(1):
            chain[rng.randrange(120)] = f"x{rng.random()}"
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(120)] = f"y{rng.random()}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(5000 + i, "é " * 30000) for i in range(3)]
    assert got(near_duplicates(docs_of(rows))) == brute(rows)
    assert got(near_duplicates(docs_of(rows), MinMax(max_broadcast_ids=0))) == brute(rows)


def test_no_plan_repeats_the_joins_before_it(docs_of, monkeypatch):
    """The driver plans each written table by itself: no step is one plan of all shuffles before it."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(80):
        own = list(base)
        for _ in range(rng.randrange(1, 12)):
            own[rng.randrange(120)] = f"y{rng.random()}"
        rows.append((i, " ".join(own)))
    shuffles, keep = {}, Scratch.keep

    def counted(self, df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles[name] = max(shuffles.get(name, 0), len(re.findall(r"\bExchange ", plan)))
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", counted)
    assert got(near_duplicates(docs_of(rows))) == brute(rows)
    assert shuffles["links"] and max(shuffles.values()) <= 12, shuffles


def test_empty_and_lone_tables(docs_of):
    assert got(near_duplicates(docs_of([]))) == {}
    assert got(near_duplicates(docs_of([(7, "only one text of a few words")]))) == {7: (3, 7)}


def test_repeated_paragraphs(docs_of):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    near = list(passage)
    near[30] = "changed"
    other = [[f"q{rng.random()}" for _ in range(70)] for _ in range(6)]
    rows = [(1, "short\n" + " ".join(passage)), (2, " ".join(other[0]) + "\n" + " ".join(near) + "\nshort"), (3, " ".join(other[1])), (4, None), (5, ""), (6, "é\n" + " ".join(passage))]
    out = {(r.doc_id, r.place): r for r in repeated_paragraphs(docs_of(rows)).collect()}
    assert set(out) == {(1, 1), (2, 1), (6, 1)}
    assert [k for k, r in out.items() if r.kept] == [(1, 1)] and {r.keeper_doc_id for r in out.values()} == {1}
    assert rows[5][1][out[6, 1].start : out[6, 1].end] == " ".join(passage)
    left = {r.doc_id: r.text for r in remove_repeats(docs_of(rows)).collect()}
    assert left[1] == rows[0][1] and left[2] == " ".join(other[0]) + "\nshort" and left[6] == "é" and left[4] is None
    assert repeated_paragraphs(docs_of([])).count() == 0


def test_runs_inside_and_across_lines(docs_of):
    rng = random.Random(11)

    def prose(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def wrapped(words, n):
        return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))

    a, b, c, short = prose(57), prose(120), prose(64), prose(49)
    rows = [
        (1, " ".join(prose(40) + a + prose(70))),
        (2, "é " + " ".join(prose(14) + a + prose(9))),
        (3, wrapped(prose(5) + b + prose(7), 12)),
        (4, wrapped(prose(8) + b[3:113] + prose(3), 17).upper()),
        (5, " ".join(prose(30) + c) + "\n" + " ".join(c[:55] + prose(60))),
        (6, " ".join(prose(60) + short + prose(60))),
        (7, " ".join(prose(60) + short + prose(60))),
        (8, "é " * 400),
        (9, wrapped(c, 20)),
        (10, wrapped(prose(70), 10)),
        (None, " ".join(prose(30) + a)),
        (11, " ".join(a)),
        (12, " ".join(a)),
    ]
    rows += [(13, rows[9][1]), (10, rows[9][1]), (14, None)]
    docs = docs_of(rows)
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t in rows]
    places = {}
    for i, w in enumerate(words):
        for j in range(len(w) - 49):
            places.setdefault(tuple(w[j : j + 50]), []).append((rows[i][0] or 10**6, rows[i][1], j))
    want, gone = {}, {}
    for at in places.values():
        first = min(at)
        for doc, text, j in at:
            if len(at) > 1:
                want.setdefault((doc, text), set()).update(range(j, j + 50))
                if (doc, text) != first[:2]:
                    gone.setdefault((doc, text), set()).update(range(j, j + 50))
                elif j != first[2]:
                    gone.setdefault((doc, text), set()).update(range(max(j, first[2] + 50), j + 50))
    texts = {}
    for i, t in rows:
        texts.setdefault(i or 10**6, t)
    found, removed = {}, {}
    for r in repeated_paragraphs(docs).collect():
        key = (r.doc_id or 10**6, texts[r.doc_id or 10**6])
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", key[1])]
        inside = {k for k, (x, y) in enumerate(spans) if x >= r.start and y <= r.end}
        assert r.n_words == len(inside) or r.place is not None
        found.setdefault(key, set()).update(inside)
        if not r.kept and key[0] != 10:
            removed.setdefault(key, set()).update(inside)
    assert found == want
    assert removed == {k: v for k, v in gone.items() if k[0] != 10}
    left = {(r.doc_id or 10**6): r.text for r in remove_repeats(docs).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if i != 10:
            assert (left[i] or "").split() == [x for k, x in enumerate(w) if k not in gone.get((i, t), set())], i
    assert left[10] == texts[10] and left[14] is None


def test_other_blanks_part_no_words(docs_of):
    """A line's words are counted as they are hashed: at the six ASCII blanks alone."""
    line = "\u00a0".join(f"w{i}" for i in range(60))
    docs = docs_of([(1, line), (2, "\x0b".join(f"w{i}" for i in range(60)))])
    assert [(r.doc_id, r.n_words) for r in split_paragraphs(docs).collect()] == [(2, 60)]
