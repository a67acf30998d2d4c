import random

import numpy as np

from notegraph.llm import bytecnn as B

SMALL = B.Network(sample=300, epochs=4)


def test_chunks_cover_the_whole_text():
    m = B.Network()
    for n in (0, 1, 64, 511, 512, 513, 960, 961, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        c = B.chunks(text, m)
        step = m.chunk - m.overlap
        joined = bytes(c[0]) + b"".join(bytes(x[m.overlap :]) for x in c[1:])
        assert joined.rstrip(b"\0") == text.encode() and len(c) == max(1, -(-(n - m.overlap) // step))
    assert len(B.chunks(None, m)) == 1


def test_gradients_match_differences():
    m = B.Network(chunk=32, overlap=8, dim=3, width=4, stride=2, filters=5)
    p = B.Weights.start(m)
    rng = np.random.default_rng(0)
    for name in ("e", "k", "b", "w"):
        setattr(p, name, (getattr(p, name) + rng.normal(0, 0.3, getattr(p, name).shape)).astype(np.float64))
    made = [B.chunks(t, m) for t in ("hello world " * 5, "x", "some more text here")]
    first = np.cumsum([0, *(len(c) for c in made[:-1])])
    block, y = np.concatenate(made), np.array([1.0, 0.0, 1.0])

    def loss():
        x = B.combine(B.pooled(block, p, m)[0], first)
        q = B.sigmoid(x @ p.w[1:] + p.w[0])
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    for x, g in zip((p.e, p.k, p.b, p.w), B.gradients(block, first, y, p, m), strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in x.shape)
            old = x[at]
            x[at] = old + 1e-6
            up = loss()
            x[at] = old - 1e-6
            down = loss()
            x[at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-3


def test_blocks_do_not_change_values():
    p = B.Weights.start(SMALL)
    texts = ["a b c " * 900, "", None, "x", "é ñ " * 4000]
    one = B.document_values(texts, p, SMALL)
    other = np.concatenate([B.document_values([t], p, B.Network(block=7)) for t in texts])
    assert np.allclose(one, other, atol=1e-5)


def test_held_out_accuracy_and_odd_rows(spark, docs_of):
    rng = random.Random(4)
    rows, labels = [(900, None), (901, ""), (902, "x" * 100000)], [(900, 0, 1), (7777, 1, 0)]
    for i in range(400):
        words = ["".join(rng.choice("aeioutnrs") for _ in range(5)) for _ in range(40)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "###" if bad and rng.random() < 0.5 else w for w in words)))
        labels.append((i, int(not bad), 0))
    docs, table = docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = B.digest(docs, table, m=SMALL).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    right = [r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id < 400 and r.held_out]
    assert len(right) > 60 and sum(right) / len(right) > 0.95
    assert {r.score for r in B.digest(docs, table.where("false"), m=SMALL).collect()} == {0.5}
    assert B.digest(docs_of([]), table, m=SMALL).count() == 0
