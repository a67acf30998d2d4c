"""Periodic runs of words: stretches that repeat a short block again and again.

Blocks of 2**k words are named as Karp, Miller and Rosenberg do: equal blocks
of one document, and only these, share a name, and the names of level k + 1
are made from pairs of names of level k.  Naming stops at the level at which
no block occurs twice.  The common extension of two positions, forwards or
backwards, follows from the names by descending levels, each of which is used
at most once.

A run of period q and at least 4 q words holds a multiple of 2 q at which the
next q words equal the q words after them.  So for each period only these
grid positions are tried, and those whose blocks agree are extended both ways
to the run's ends.  Many documents go through the same array operations
together; periods that a document's highest level rules out are not tried.

Defined results: null and blank texts have no words and no run; repeated rows
are answered each; a null ``doc_id`` is kept; other columns are not read.  A
text of n words takes memory in proportion to n times the levels in use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.shingles import text_blocks
from notegraph.llm.text import let, words


@dataclass(frozen=True)
class Rule:
    """What counts as a run: its least words, and how often its block repeats (2 or more)."""

    min_words: int = 6
    min_repeats: int = 4
    #: Grid positions that are tried at once (bounds the memory).
    step: int = 1 << 20


def _named(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of the keys at positions ``at``; what occurs once has a negative name of its own."""
    out = -1 - np.arange(n + 1, dtype=np.int32)
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=-1) != 0
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    out[at[order[many]]] = group[many]
    return out


def block_names(items: np.ndarray) -> np.ndarray:
    """Row k: the names of the blocks of 2**k items from each position.

    Positions at which no block begins have names of their own as well; the
    last column stands for the end.
    """
    n = len(items)
    levels = [_named(items, np.arange(n), n)]
    while True:
        last, width = levels[-1], 1 << (len(levels) - 1)
        at = np.flatnonzero(last >= 0)
        at = at[at + width < n]
        at = at[last[at + width] >= 0]
        if not len(at):
            break
        made = _named(last[at].astype(np.int64) * (n + 1) + last[at + width], at, n)
        if (made < 0).all():
            break
        levels.append(made)
    return np.stack(levels)


def extend(names: np.ndarray, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many items from positions ``a`` and ``b`` on (or before them) agree; ``a`` < ``b``."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width = 1 << k
        if back:
            x, y = a - total - width, b - total - width
            same = (x >= 0) & (names[k][np.maximum(x, 0)] == names[k][np.maximum(y, 0)]) & (y > 0)
        else:
            x, y = a + total, b + total
            same = names[k][x] == names[k][y]
        total += same * width
    return total


def runs_of(items: np.ndarray, edges: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of many documents, by start, then period.

    ``items`` are numbers of words; the i-th document's stand from
    ``edges[i]`` to ``edges[i + 1]``.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(items):
        return none
    count = np.diff(edges)
    owner = np.repeat(np.arange(len(count)), count)
    names = block_names(owner * (items.max() + 1) + items)
    top = np.full(len(count), -1)
    for k, row in enumerate(names):
        top[owner[np.flatnonzero(row[:-1] >= 0)]] = k
    # all but one repeat of a run occur twice
    most = np.minimum(count // rule.min_repeats, ((1 << (top + 1)) - 1) // (rule.min_repeats - 1))
    period = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1
    doc = np.repeat(np.arange(len(count)), most)
    grid = period * max(1, rule.min_repeats - 2)
    tries = np.maximum(0, (count[doc] - 2 * period) // grid + 1)
    cuts = np.searchsorted(np.cumsum(tries), np.arange(0, tries.sum(), rule.step))
    found = [none]
    for first, last in zip(cuts, [*cuts[1:], len(tries)][: len(cuts)], strict=True):
        # a period's positions stay together, so that a document's length bounds a step
        t = tries[first:last]
        q = np.repeat(period[first:last], t)
        i = np.repeat(edges[doc[first:last]], t) + (np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)) * np.repeat(grid[first:last], t)
        k = np.frexp(q)[1] - 1
        rest = q - (1 << k)
        deep = k < len(names)
        i, q, k, rest = i[deep], q[deep], k[deep], rest[deep]
        same = (names[k, i] == names[k, i + q]) & (names[k, i + rest] == names[k, i + q + rest])
        i, q = i[same], q[same]
        before = extend(names, i, i + q, back=True)
        length = before + q + extend(names, i, i + q)
        whole = length >= np.maximum(rule.min_words, rule.min_repeats * q)
        found.append(((i - before)[whole], length[whole], q[whole]))
    start, length, q = (np.concatenate(x) for x in zip(*found, strict=True))
    # one stretch may be met at many positions, and under multiples of its period
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = (np.diff(start, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0)
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def _block(raw: np.ndarray, at: np.ndarray, rule: Rule) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Word counts, runs and collapsed texts of a block of texts."""
    data = raw.tobytes()
    split = [data[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]  # bytes split at the six ASCII blanks
    count = np.array([len(ws) for ws in split])
    edges = np.concatenate(([0], np.cumsum(count)))
    number: dict[bytes, int] = {}
    items = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, edges[-1])
    start, length, period = runs_of(items, edges, rule)
    # what follows a run's first period is dropped
    depth = np.zeros(edges[-1] + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.cumsum(depth)[:-1] == 0
    texts = [b" ".join(ws if kept[a:b].all() else [w for w, k in zip(ws, kept[a:b], strict=True) if k]) for ws, a, b in zip(split, edges[:-1], edges[1:], strict=True)]
    own = np.searchsorted(edges, start, "right") - 1
    ends = np.searchsorted(start, edges).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(x) for x in (start - edges[own], length, period)], fields=list(RUN))
    return count, pa.ListArray.from_arrays(pa.array(ends), fields), pa.array(texts, pa.binary()).cast(pa.string())


def find_runs(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of each row of ``docs``.

    ``runs`` are structs of first word, words and smallest period, by start,
    then period; ``collapsed`` is the text without what a run says again, its
    words joined by one blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, at in text_blocks(batch.column(1)):
                count, runs, texts = _block(raw, at, rule)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(count)), pa.array(count), runs, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: a tenth of the documents, by hash, made periodic from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def periodic(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    made = F.when(h % 10 == 0, let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(""))).otherwise(F.col("text"))
    return docs.select("doc_id", made.alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the ``op12`` query."""
    found = find_runs(with_planted_runs(docs))
    first = F.get("runs", F.lit(0))
    # of equal exponents the earlier run stays
    best = F.aggregate("runs", first, lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))
    line = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
