"""The prefix trie of conversations: what they share from their first turn on.

A node is a distinct sequence of first turns.  Turns become pairs of hashes,
and polynomial rolling fingerprints of all prefixes come from numpy scans
(doubling: each step joins a prefix with the one that ends where it begins).
A conversation of more than ``block`` turns is scanned in blocks, whose
fingerprints are then carried on, so that no task has to hold it whole.

Equal fingerprints only propose a node.  Its smallest conversation represents
it, and every other member's last turn and parent are compared with the
representative's; by induction over the depth, groups that agree are equal
throughout.  Groups that don't are split: each class of equal last turns and
parents gets its own mark, which all deeper turns of its conversations keep.

A node is known by its smallest member and its depth, so a conversation owns a
chain of the nodes that it represents, and its path crosses the chains of
smaller ones.  Sums over subtrees need no rounds: a chain's total is added
once to each chain that its path crosses, at the depth where it leaves it, and
a running sum along each chain does the rest.

Defined results: null roles and texts are empty; turns of one conversation
with equal numbers stand in order of role, then text, null numbers first;
repeated rows are turns of their own; rows without ``conv_id`` are left out;
an empty table has no node, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from notegraph.llm.scratch import Scratch


@dataclass(frozen=True)
class Trie:
    """Bases of the two fingerprints (odd), and sizes of blocks and of joined id texts."""

    bases: tuple[int, int] = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    block: int = 4096
    chunk_ids: int = 8192


NODE = ["depth", "f", "g", "path"]
PRIME = (1 << 61) - 1


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    p, low = np.uint64(PRIME), np.uint64((1 << 31) - 1)
    s30, s31, s61 = np.uint64(30), np.uint64(31), np.uint64(61)
    ah, al, bh, bl = a >> s31, a & low, b >> s31, b & low
    mid = al * bh + ah * bl
    # 2**62 is 2 and 2**61 is 1 modulo the prime
    x = ah * bh * np.uint64(2) + (mid >> s30) + ((mid & np.uint64((1 << 30) - 1)) << s31)
    x = (x & p) + (x >> s61) + ((al * bl) & p) + ((al * bl) >> s61)
    x = (x & p) + (x >> s61)
    return np.where(x >= p, x - p, x)


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a + b
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        step = np.uint64(pow(base, len(out), PRIME))
        out = np.concatenate((out, times(out, np.full(len(out), step, np.uint64))))
    return out[: n + 1]


def scan(values: np.ndarray, place: np.ndarray, base: int) -> np.ndarray:
    """Fingerprints of the prefixes of many sequences that stand one after another.

    ``place`` numbers each item within its own sequence from 0; the prefix
    that ends with item i has ``sum(v[j] * base**(i - j))``.
    """
    out, width = values.copy(), 1
    while width <= place.max(initial=0):
        later = np.flatnonzero(place >= width)
        step = np.full(len(later), np.uint64(pow(base, width, PRIME)), np.uint64)
        out[later] = plus(out[later], times(out[later - width], step))
        width *= 2
    return out


def _scanned(rows: DataFrame, key: list[str], values: list[str], bases: tuple[int, int]) -> DataFrame:
    """``rows`` with ``f`` and ``g``, the fingerprints of ``values`` up to each row, and ``pf``, ``pg``, those before it.

    Rows of one ``key`` stand together in order; a key's rows may span batches.
    """
    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in ("f", "g", "pf", "pg"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [0, 0]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in key])
            new = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            head = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(head, np.diff([*head, n]))
            goes_on = last is not None and (keys[:, 0] == last).all()
            first = int(head[1]) if len(head) > 1 else n
            now, before = [], []
            for j, (name, base) in enumerate(zip(values, bases, strict=True)):
                v = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) % np.uint64(PRIME)
                f = scan(v, place, base)
                if goes_on:
                    f[:first] = plus(f[:first], times(np.full(first, carry[j], np.uint64), powers(base, first)[1:]))
                now.append(f)
                ahead = np.concatenate((np.array([carry[j] if goes_on else 0], np.uint64), f[:-1]))
                before.append(np.where(new & ~(goes_on & (np.arange(n) == 0)), np.uint64(0), ahead))
                carry[j] = int(f[-1])
            last = keys[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.int64)) for x in (*now, *before))], names=schema.names)

    return rows.mapInArrow(run, schema)


def numbered(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, at, role, text)`` and ``(conv_id, part, first, n, before)``.

    ``at`` is a number of the row's own; the rows of a conversation have
    successive ones within a part, and ``before`` of its rows stand in earlier
    parts.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), empty("role"), empty("text"))
    # ties share a partition here: they are sorted by text, of which no bound should be taken
    placed = rows.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first()).sortWithinPartitions(*order)
    placed = scratch.keep(placed.select("conv_id", F.monotonically_increasing_id().alias("at"), "role", "text"), "turns")
    parts = placed.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return placed, scratch.keep(parts.withColumn("before", F.coalesce(earlier, F.lit(0))), "parts")


def _hashes() -> list[Column]:
    return [F.xxhash64(F.lit(i), "role", "text").alias(c) for i, c in enumerate("ab")]


def as_they_are(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, conversations and ``(conv_id, depth, at, a, b, size)`` of turns in their own order."""
    texts, parts = numbered(turns, scratch)
    own = texts.select("conv_id", F.shiftright("at", 33).alias("part"), "at", *_hashes(), F.length("text").alias("size"))
    placed = own.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at") - F.col("first") + 1).alias("depth"), "at", "a", "b", "size")
    return texts, parts.select("conv_id").distinct(), placed


def with_shared_heads(turns: DataFrame, scratch: Scratch, group: int = 100, mod: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``as_they_are``, each conversation c rebuilt with the head of another.

    Its first turns are the first h of conversation ``c - c % group`` (h is
    crc32 of c modulo ``mod``), followed by its own after its first h.
    """
    texts, convs, placed = as_they_are(turns, scratch)
    placed = scratch.keep(placed, "placed")
    base = F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % mod).alias("h")
    head = placed.where((F.col("conv_id") == base) & (F.col("depth") < mod))
    heads = head.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("heads"))
    every = convs.select("conv_id", base.alias("base"), h).join(heads, "base", "left")
    every = every.select("conv_id", "base", "h", F.least("h", F.coalesce("heads", F.lit(0))).alias("kept"))
    # a head has fewer than mod turns, and fewer than group conversations share it
    shared = every.join(head.withColumnRenamed("conv_id", "base"), "base").where("depth <= h").select("conv_id", "depth", "at", "a", "b", "size")
    own = placed.join(every, "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("kept")).alias("depth"), "at", "a", "b", "size")
    return texts, convs, own.unionByName(shared)


def fingerprints(placed: DataFrame, scratch: Scratch, t: Trie) -> DataFrame:
    """``placed`` with prefix fingerprints ``f``, ``g`` and those one turn before, ``pf``, ``pg``."""
    blocks = placed.withColumn("block", F.floor((F.col("depth") - 1) / t.block))
    local = scratch.keep(_scanned(blocks.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth"), ["conv_id", "block"], ["a", "b"], t.bases), "local")
    # only conversations of more than a block have anything to carry
    ends = local.where(F.col("depth") % t.block == 0).select("conv_id", "block", F.col("f").alias("ef"), F.col("g").alias("eg"))
    wide = tuple(pow(b, t.block, PRIME) for b in t.bases)
    carried = _scanned(ends.repartition("conv_id").sortWithinPartitions("conv_id", "block"), ["conv_id"], ["ef", "eg"], wide)
    carried = carried.select("conv_id", (F.col("block") + 1).alias("block"), F.col("f").alias("cf"), F.col("g").alias("cg"))
    names = placed.columns + ["f", "g", "pf", "pg"]
    later = local.where("block > 0").join(carried, ["conv_id", "block"])
    schema = later.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [powers(b, t.block) for b in t.bases]
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            place = (cols["depth"] - 1) % t.block
            for c, p, e, w in (("f", "pf", "cf", table[0]), ("g", "pg", "cg", table[1])):
                carry = cols[e].view(np.uint64)
                cols[c] = plus(cols[c].view(np.uint64), times(carry, w[place + 1])).view(np.int64)
                cols[p] = plus(cols[p].view(np.uint64), times(carry, w[place])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cols[c]) for c in schema.names], names=schema.names)

    return local.where("block = 0").select(*names).unionByName(later.mapInArrow(run, schema).select(*names))


def verified(prints: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, depth, size, node, n_convs)``: the node of every prefix.

    ``node`` is the smallest conversation that has the prefix.
    """
    prints = scratch.keep(prints, "prints")
    same = ["depth", "f", "g"]
    groups = prints.groupBy(*same).agg(F.min(F.struct("conv_id", "at", "pf", "pg")).alias("rep"), F.count(F.lit(1)).alias("n_convs"))
    # written first: a common prefix's rows can then be split among tasks in the join
    known = scratch.keep(prints.join(scratch.keep(groups, "groups"), same), "known")
    # a representative agrees with itself, and so does a turn that two conversations share
    others = known.where("conv_id <> rep.conv_id")
    odd = others.where("pf <> rep.pf or pg <> rep.pg").select(*same)
    pairs = others.where("at <> rep.at").select(F.col("at").alias("x"), F.col("rep.at").alias("y"), *same).distinct()
    one = texts.select(F.col("at").alias("x"), F.col("role").alias("xr"), F.col("text").alias("xt"))
    two = texts.select(F.col("at").alias("y"), F.col("role").alias("yr"), F.col("text").alias("yt"))
    differs = pairs.join(one, "x").join(two, "y").where("xr <> yr or xt <> yt").select(*same)
    failed = scratch.keep(odd.unionByName(differs).distinct(), "failed")
    # marks of the classes inside failed groups; the representative's class needs none
    inside = known.join(failed, same).join(texts.select("at", "role", "text"), "at")
    alike = [*same, "pf", "pg", "role", "text"]
    classes = inside.groupBy(*alike).agg(F.min("conv_id").alias("mark"))
    marks = inside.join(classes, alike).where("mark <> rep.conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "mark"))).alias("marks"))
    marks = scratch.keep(marks, "marks")
    if marks.isEmpty():
        return known.select("conv_id", "depth", "size", F.col("rep.conv_id").alias("node"), "n_convs")
    until = F.transform(F.filter("marks", lambda m: m["depth"] <= F.col("depth")), lambda m: F.concat_ws(":", m["depth"], m["mark"]))
    split = known.drop("n_convs").join(marks, "conv_id", "left").withColumn("path", F.coalesce(F.array_join(until, ","), F.lit("")))
    exact = split.groupBy(*NODE).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"))
    return split.join(exact, NODE).select("conv_id", "depth", "size", "node", "n_convs")


def from_below(points: DataFrame, columns: list[str], t: Trie) -> DataFrame:
    """``points`` with each column summed over the same ``conv_id`` from its ``depth`` on.

    Sums run inside blocks of depths, then over the blocks' totals.
    """
    p = points.withColumn("block", F.floor(F.col("depth") / t.block))
    inner = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    rows = p.select(*points.columns, "block", *[F.sum(c).over(inner).alias(f"_{c}") for c in columns])
    outer = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = p.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in columns]).select("conv_id", "block", *[F.sum(c).over(outer).alias(f"__{c}") for c in columns])
    later = totals.where(F.col(f"__{columns[0]}").isNotNull())
    out = rows.join(later, ["conv_id", "block"], "left")
    return out.select("conv_id", "depth", *[(F.col(f"_{c}") + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in columns])


def end_hashes(ends: DataFrame, t: Trie) -> DataFrame:
    """``(conv_id, depth, ends_sha256)`` of nodes at which conversations ``(node, depth, conv)`` end.

    Sorted ids are joined in chunks wherever they are; one pass over a node's
    chunks, in order, makes its hash.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, conv = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1]))))
            cuts = [c for a, b in zip(new, [*new[1:], len(node)], strict=True) for c in range(a, b, t.chunk_ids)]
            text = [",".join(map(str, conv[a:b])) for a, b in zip(cuts, [*cuts[1:], len(node)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(node[cuts]), pa.array(depth[cuts]), pa.array(conv[cuts]), pa.array(text, pa.string())], names=["node", "depth", "conv", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        for batch in batches:
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if (node, depth) != now:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (node, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["conv_id", "depth", "ends_sha256"])
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names=["conv_id", "depth", "ends_sha256"])

    order = ["node", "depth", "conv"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "node bigint, depth bigint, conv bigint, ids string")
    return joined.repartition("node", "depth").sortWithinPartitions(*order).mapInArrow(digest, "conv_id bigint, depth bigint, ends_sha256 string")


def trie(placed: tuple[DataFrame, DataFrame, DataFrame], scratch: Scratch, t: Trie = Trie()) -> DataFrame:
    """The rows of the ``op13`` query for conversations as ``as_they_are`` gives them."""
    texts, convs, turns = placed
    row = convs.agg(F.min("conv_id").alias("root"), F.count(F.lit(1)).alias("n")).first()
    paths = verified(fingerprints(turns, scratch, t), texts, scratch)
    # the root is every conversation's prefix of no turns
    paths = scratch.keep(paths.unionByName(convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).alias("size"), F.lit(row["root"]).cast("bigint").alias("node"), F.lit(row["n"]).alias("n_convs"))), "paths")
    nodes = paths.where("conv_id = node").select("conv_id", "depth", "size", "n_convs")
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = nodes.join(above, ["conv_id", "depth"], "left")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    weight = (F.col("n_convs") - 1) * F.col("size")
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = scratch.keep(nodes.select("*", (F.col("n_children") == 0).cast("bigint").alias("leaves"), weight.alias("saved")), "nodes")
    chains = nodes.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    left = paths.where("conv_id <> node").groupBy("conv_id", "node").agg(F.max("depth").alias("depth"))
    crossed = chains.join(left, "conv_id").groupBy(F.col("node").alias("conv_id"), "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    points = nodes.select("conv_id", "depth", "leaves", "saved").unionByName(crossed).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sums = from_below(points, ["leaves", "saved"], t)
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("e")).select("e.node", "e.depth", F.col("conv_id").alias("conv"))
    out = nodes.drop("leaves", "saved").join(sums, ["conv_id", "depth"]).join(end_hashes(last, t), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def digest(turns: DataFrame) -> DataFrame:
    """The rows of the ``op13`` query."""
    scratch = Scratch(turns.sparkSession)
    return trie(with_shared_heads(turns, scratch), scratch)
