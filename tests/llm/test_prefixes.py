import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from notegraph.llm import prefixes as P
from notegraph.llm.scratch import Scratch

TURNS = "conv_id bigint, turn bigint, role string, text string"


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in own.items()}


def rebuilt(own):
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def brute(convs):
    """All nodes of a trie of {conversation: turns}, by their definition."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = own + sum(saved[k] for k in kids[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def got(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(*cols).collect()))


def test_digest_against_brute_force(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(P.digest(turns)) == brute(rebuilt(ordered(turns.select("conv_id", "turn", "role", "text").collect())))


ODD = [
    (0, 0, "user", "hi"), (0, 1, "bot", "yes"), (1, 0, "user", "hi"), (1, 1, None, "no"), (1, 1, "", "no"), (2, None, "user", None), (2, 5, "bot", "ok"),
    (2, None, "a", "late"), (100, 3, "user", "é漢"), (101, 0, "user", "one"), (101, 1, "user", "two"), (205, 0, "user", "alone"), (206, 0, "user", "x"), (206, 0, "user", "x"),
    (-3, 0, "user", "hi"), (None, 0, "user", "hi"), (7, 0, "user", "hi"), (7, 1, "bot", "yes"), (8, 0, "user", "hi"),
]


def test_odd_turns(spark):
    turns = spark.createDataFrame([(*r, "x", 1) for r in ODD], TURNS + ", path string, at int").withColumnRenamed("path", "node")
    own = ordered(ODD)
    scratch = Scratch(spark)
    assert got(P.trie(P.as_they_are(turns, scratch), scratch)) == brute(own)
    # the remainder of a negative id keeps its sign
    built = {c: (own.get(c + (-c) % 100 if c < 0 else c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6]) + ts[zlib.crc32(str(c).encode()) % 6 :] for c, ts in own.items()}
    assert got(P.digest(turns)) == brute(built)
    assert P.digest(turns.limit(0)).collect() == []


def small(spark, seed, n=60, words=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(c, i, rng.choice("ab"), str(rng.randrange(words))) for c in rng.sample(range(1000), n) for i in range(rng.randrange(1, 9))], TURNS)


def test_collisions_are_split(spark, monkeypatch):
    """With hashes of one bit nearly all fingerprints collide; the nodes stay exact."""
    turns = small(spark, 1)
    from pyspark.sql import functions as F

    monkeypatch.setattr(P, "_hashes", lambda: [(F.xxhash64("text") % 2).alias("a"), F.lit(1).cast("bigint").alias("b")])
    scratch = Scratch(spark)
    assert got(P.trie(P.as_they_are(turns, scratch), scratch)) == brute(ordered(turns.collect()))


def test_small_blocks_and_long_conversations(spark):
    rows = [(c, i, "user", str(min(i, 30 + c) % 5)) for c in range(4) for i in range(40 + c)]
    turns = spark.createDataFrame(rows, TURNS).repartition(3)
    scratch = Scratch(spark)
    assert got(P.trie(P.as_they_are(turns, scratch), scratch, P.Trie(block=7, chunk_ids=2))) == brute(ordered(rows))


def test_many_equal_conversations(spark):
    rows = [(c, i, "user", f"t{i}") for c in range(300) for i in range(2)] + [(c, 0, "user", "t0") for c in range(300, 330)]
    scratch = Scratch(spark)
    assert got(P.trie(P.as_they_are(spark.createDataFrame(rows, TURNS), scratch), scratch, P.Trie(chunk_ids=16))) == brute(ordered(rows))


@pytest.mark.parametrize("base", [3, (1 << 61) - 2, 0x9E3779B97F4A7C15 % P.PRIME])
def test_scans_against_python_integers(base):
    rng = np.random.default_rng(2)
    lengths = [1, 5, 1, 33, 8]
    v = rng.integers(0, P.PRIME, sum(lengths), dtype=np.uint64)
    v[3] = P.PRIME - 1
    out = P.scan(v, np.concatenate([np.arange(n) for n in lengths]), base)
    want = []
    at = 0
    for n in lengths:
        f = 0
        for x in v[at : at + n]:
            f = (f * base + int(x)) % P.PRIME
            want.append(f)
        at += n
    assert out.tolist() == want
    assert P.powers(base, 20).tolist() == [pow(base, k, P.PRIME) for k in range(21)]
