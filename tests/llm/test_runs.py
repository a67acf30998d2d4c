import hashlib
import random
import zlib

import numpy as np
import pytest

from notegraph.llm import runs as R

WORDS = rb"[^\x20\x09-\x0D]+"


def brute_runs(w):
    """Maximal stretches by definition, period by period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute(doc_id, text):
    import re

    w = [x.decode() for x in re.findall(WORDS, (text or "").encode())]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = (None,) * 4
    if found:
        from fractions import Fraction

        s, n, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def key(r):
    return repr(r)


def test_digest_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 9000")
    rows = sorted((tuple(r) for r in R.digest(docs).collect()), key=key)
    assert rows == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert sum(r[1] > 0 for r in rows) >= 10


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "a " * 5),
    (5, "a " * 6),
    (6, "a b " * 4),
    (7, "x a b a b a b a y"),
    (8, "x a b a b a b a b y"),
    (9, "ab c\u0085d " * 9),
    (10, "é\tè\x0bé\x0cè " * 3 + "q q q q q q"),
    (11, "a a a a a a b " * 4 + "tail"),
    (None, "n n n n n n n"),
    (12, "w1 w2 w3 " * 3 + "w1 w2"),
    (12, "w1 w2 w3 " * 4),
    (12, "w1 w2 w3 " * 4),
    (13, "word " * 20000),
    (14, " ".join(f"v{i % 1500}" for i in range(6001))),
]


def test_odd_texts_and_clashing_columns(docs_of):
    docs = docs_of(ODD).withColumnRenamed("lang", "runs").withColumnRenamed("source", "start")
    want = [brute(*r) for r in ODD if r[0] not in (13, 14)]
    out = [tuple(r) for r in R.digest(docs).collect()]
    assert sorted((r for r in out if r[0] not in (13, 14)), key=key) == sorted(want, key=key)
    assert {r[0]: r[1:5] for r in out if r[0] in (13, 14)} == {13: (1, 0, 20000, 1), 14: (1, 0, 6001, 1500)}
    assert R.digest(docs_of([])).collect() == []
    assert [r.runs for r in R.find_runs(docs_of([(1, "a b c"), (2, "d")])).collect()] == [[], []]


def test_spans_and_collapsed_text(docs_of):
    (row,) = R.find_runs(docs_of([(1, "so  we go go go go go go\nhome and home")])).collect()
    assert (row.n_words, [tuple(x) for x in row.runs], row.collapsed) == (11, [(2, 6, 1)], "so we go home and home")


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words_in_blocks(letters):
    """Many documents in one block, and steps of few positions, change nothing."""
    rng = random.Random(letters)
    docs = []
    for _ in range(120):
        w = []
        while len(w) < rng.randrange(1, 120):
            block = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            w += block * rng.randrange(1, 7)
        docs.append(w)
    edges = np.concatenate(([0], np.cumsum([len(w) for w in docs])))
    items = np.array([x for w in docs for x in w])
    for step in (1, 50, 1 << 20):
        start, length, q = R.runs_of(items, edges, R.Rule(step=step))
        got = [[] for _ in docs]
        for s, n, p in zip(start, length, q, strict=True):
            d = int(np.searchsorted(edges, s, "right")) - 1
            got[d].append((int(s - edges[d]), int(n), int(p)))
        assert got == [brute_runs(w) for w in docs]


def test_names_and_extensions():
    items = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2])
    names = R.block_names(items)
    for k, row in enumerate(names):
        blocks = {}
        for i in range(len(items) - (1 << k) + 1):
            blocks.setdefault(tuple(items[i : i + (1 << k)]), []).append(i)
        for at in blocks.values():
            assert len({int(row[i]) for i in at}) == 1 and (row[at[0]] >= 0) == (len(at) > 1)
    for a in range(10):
        for b in range(a + 1, 10):
            ahead = next((t for t in range(10 - b) if items[a + t] != items[b + t]), 10 - b)
            behind = next((t for t in range(a) if items[a - 1 - t] != items[b - 1 - t]), a)
            x, y = np.array([a]), np.array([b])
            assert (R.extend(names, x, y)[0], R.extend(names, x, y, back=True)[0]) == (ahead, behind)
