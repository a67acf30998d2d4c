"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle hashes yields two signature values,
its minimum and its maximum, so a signature of ``2 * permutations`` values
costs half the hash evaluations.  Consecutive values form bands; documents
that share a band are candidates, and every candidate link is confirmed on
the full shingle sets.

How it stays linear in hot groups:

* texts with the same shingle set become one node before anything is paired
  (a grouped minimum with map-side combine);
* a bucket's nodes are compared with its hub, not with each other; only what
  stays apart in a bucket is compared further, in blocks of nodes whose rows
  hold two blocks and give links alone, which keeps the result the same as
  that of comparing all pairs;
* shingle sets are built only for nodes that share a band with another.

Defined results: null or blank text has no shingles, is empty and linked
with nothing; null ``doc_id`` rows stay alone; repeated rows are copies of
each other; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.components import components
from notegraph.llm.scratch import Scratch
from notegraph.llm.shingles import block_sets, block_shingles, block_words, document_words, mix, shingle_set
from notegraph.llm.text import free_name


@dataclass(frozen=True)
class MinMax:
    """Shingle length, link threshold and band shape.

    At the threshold a link shares a band with probability
    ``1 - (1 - s**rows) ** bands``: 0.99995 for 0.85, 6 and 21.
    """

    words: int = 5
    percent: int = 85
    permutations: int = 63
    rows: int = 6
    seed: int = 7
    max_broadcast_ids: int = 100_000
    block_nodes: int = 128
    block_items: int = 50_000

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.rows


@lru_cache(maxsize=8)
def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, (n, 1), dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**63, (n, 1), dtype=np.uint64)


def min_max(values: np.ndarray, starts: np.ndarray, p: MinMax) -> np.ndarray:
    """Minima, then maxima, of each segment of values under each permutation."""
    out = np.empty((2 * p.permutations, len(starts)), np.uint64)
    for i, (a, b) in enumerate(zip(*_permutations(p.permutations, p.seed), strict=True)):
        moved = values * a + b
        out[i] = np.minimum.reduceat(moved, starts)
        out[p.permutations + i] = np.maximum.reduceat(moved, starts)
    return out


def band_keys(signature: np.ndarray, p: MinMax) -> np.ndarray:
    """64-bit keys, a row for each text; a key tells its band apart."""
    # a stride over the values puts minima and maxima of different
    # permutations into each band
    grid = signature[: p.bands * p.rows].reshape(p.rows, p.bands, -1)
    key = mix(np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for row in grid:
        key = mix(key ^ row)
    return key.T


def signatures(docs: DataFrame, p: MinMax) -> DataFrame:
    """``(doc_id, n_shingles, print, bands)``: set size, fingerprint, keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, bands = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for _, h, edges in block_words(batch.column("text")):
                values, counts = block_shingles(h, edges, p.words)
                own, n = block_sets(values, counts)
                sizes.append(n)
                cut = np.concatenate(([0], np.cumsum(n)))
                marks += [hashlib.blake2b(own[a:b].tobytes(), digest_size=16).digest() if a < b else None for a, b in zip(cut[:-1], cut[1:], strict=True)]
                full = counts > 0
                if full.any():
                    bands.append(band_keys(min_max(values, (np.cumsum(counts) - counts)[full], p), p).astype(np.int64).ravel())
            n = np.concatenate(sizes)
            ends = np.concatenate(([0], np.cumsum((n > 0) * p.bands)))
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), keys], names=["doc_id", "n_shingles", "print", "bands"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, "doc_id bigint, n_shingles bigint, print binary, bands array<bigint>")


def shingle_sets(docs: DataFrame, p: MinMax) -> DataFrame:
    """``(id, items)``: each document's full set as packed sorted hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(h, p.words).tobytes() for _, h in document_words(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "items"])

    return docs.mapInArrow(build, "id bigint, items binary")


def confirm(pairs: DataFrame, sets: DataFrame, p: MinMax) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets meet the threshold.

    The pivot ``u`` is joined first, so that the wide rows are dealt by
    ``v``, of which there are many.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= p.percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])

    a, b = (sets.select(F.col("id").alias(k), F.col("items").alias(x)) for k, x in (("u", "a"), ("v", "b")))
    return pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select("u", "v", "a", "b").mapInArrow(check, "u bigint, v bigint")


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return buckets.withColumn("component", F.col("id"))
    return buckets.join(labels.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _paired(left: DataFrame, buckets: DataFrame, p: MinMax) -> DataFrame:
    """``left(key, u, c, m)`` against the other components of its buckets.

    Sets whose sizes alone rule a link out are not paired.
    """
    near = (F.least("m", "n") * 100 >= F.greatest("m", "n") * p.percent) & (F.col("u") != F.col("id")) & (F.col("c") != F.col("component"))
    return left.join(buckets.hint("merge"), "key").where(near).select("key", "u", F.col("id").alias("v"))


def _star(buckets: DataFrame, p: MinMax) -> DataFrame:
    """Each bucket's nodes with its hub, the node with most companions."""
    hubs = buckets.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "component", "n")).alias("h"))
    return _paired(hubs.select("key", (-F.col("h.minus")).alias("u"), F.col("h.component").alias("c"), F.col("h.n").alias("m")), buckets, p)


def _settle(buckets: DataFrame, sets: DataFrame, p: MinMax, scratch: Scratch) -> DataFrame:
    """Links between different components of one bucket, ``(u, v)``.

    Buckets with the same hub are one group.  Its nodes outside the hub's
    component are compared with each other and with the hub's component, in
    blocks of about ``block_nodes`` nodes and ``block_items`` shingles: a row
    holds two blocks, and only links leave it, so no row is made for a pair.
    Tables that several joins read are written first: one plan of all joins
    repeats them, and the driver plans it anew after each of its shuffles.
    """
    h = F.max(F.struct("degree", "id", "component")).alias("h")
    mixed = buckets.groupBy("key").agg(h, F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    nodes = scratch.keep(buckets.join(mixed.select("key", "h").hint("merge"), "key").select(F.col("h.id").alias("hub"), (F.col("component") != F.col("h.component")).alias("apart"), "id", "n", "component").distinct(), "apart")
    n_blocks = F.ceil(F.greatest(F.count(F.lit(1)) / p.block_nodes, F.sum("n") / p.block_items)).cast("int")
    counts = scratch.keep(nodes.groupBy("hub", "apart").agg(n_blocks.alias("blocks")), "counts")
    placed = nodes.join(counts.hint("merge"), ["hub", "apart"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    blocks = scratch.keep(placed.join(sets.hint("merge"), "id").groupBy("hub", "apart", "block").agg(F.collect_list(F.struct("id", "component", "items")).alias("nodes")), "blocks")
    own = counts.where("apart").select("hub", F.col("blocks").alias("a"))
    rest = counts.where("not apart").select("hub", F.col("blocks").alias("b"))
    tasks = own.join(rest.hint("merge"), "hub", "left").select("hub", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), "a", F.coalesce("b", F.lit(0)).alias("b"))
    among = tasks.select("hub", "i", F.lit(True).alias("apart"), F.explode(F.sequence(F.col("i"), F.col("a") - 1)).alias("block"))
    across = tasks.where("b > 0").select("hub", "i", F.lit(False).alias("apart"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("block"))
    left = blocks.where("apart").select("hub", F.col("block").alias("i"), F.col("nodes").alias("mine"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for row in range(batch.num_rows):
                (ids, comps, mine), (other_ids, other_comps, theirs) = (_block(batch.column(c)[row].values) for c in (0, 1))
                sizes = np.array([len(x) for x in theirs])
                values = np.concatenate(theirs)
                owner = np.repeat(np.arange(len(theirs)), sizes)
                order = np.argsort(values, kind="stable")
                values, owner = values[order], owner[order]
                for u, c, items in zip(ids, comps, mine, strict=True):
                    at = np.minimum(np.searchsorted(items, values), len(items) - 1)
                    both = np.bincount(owner[items[at] == values], minlength=len(theirs))
                    linked = (100 * both >= p.percent * (len(items) + sizes - both)) & (other_comps != c)
                    us += [u] * int(linked.sum())
                    vs += other_ids[linked].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return among.union(across).join(left.hint("merge"), ["hub", "i"]).join(blocks.hint("merge"), ["hub", "apart", "block"]).select("mine", F.col("nodes").alias("theirs")).mapInArrow(compare, "u bigint, v bigint")


def _block(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, components and sets of one block."""
    return rows.field("id").to_numpy(), rows.field("component").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.field("items")]


def link_nodes(buckets: DataFrame, sets: DataFrame, p: MinMax, scratch: Scratch) -> DataFrame | None:
    """``(id, component)`` of linked nodes of ``buckets(key, id, degree, n)``.

    First each node is compared with the hub it shares most buckets with;
    what stays apart is settled block by block.
    """
    best = _star(buckets.withColumn("component", F.col("id")), p).groupBy("u", "v").count().groupBy("v").agg(F.max(F.struct("count", (-F.col("u")).alias("minus"))).alias("m"))
    pairs = scratch.keep(best.select((-F.col("m.minus")).alias("u"), "v"), "pairs")
    if pairs.isEmpty():
        return None
    links = scratch.keep(confirm(pairs, sets, p), "links")
    labels = None if links.isEmpty() else scratch.keep(components(links, scratch), "labels")
    rest = scratch.keep(_settle(_labelled(buckets, labels), sets, p, scratch).where("u <> v"), "links")
    if rest.isEmpty():
        return labels
    if labels is not None:
        # a component is a star around its smallest node
        rest = rest.union(labels.select(F.col("component").alias("u"), F.col("id").alias("v")))
    return scratch.keep(components(rest, scratch), "labels")


def near_duplicates(docs: DataFrame, p: MinMax = MinMax(), scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession)
    signed = scratch.keep(signatures(docs, p), "signed")
    nodes = scratch.keep(signed.where("print is not null and doc_id is not null").groupBy("print").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("n_rows")), "nodes")
    # a band's number is part of its keys, so that a node has each key once
    filed = nodes.select("id", "n", F.explode("bands").alias("key"))
    shared = scratch.keep(filed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    filed = scratch.keep(filed.join(_small(shared, p), "key"), "filed")
    wanted = _small(scratch.keep(filed.groupBy("id").agg(F.sum("size").alias("degree")), "wanted"), p)
    buckets = scratch.keep(filed.join(wanted, "id").select("key", "id", "degree", "n"), "buckets")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    sets = scratch.keep(shingle_sets(texts.join(wanted, "id", "left_semi"), p), "sets")
    labels = link_nodes(buckets, sets, p, scratch)
    # only rows whose component isn't their own id are looked up
    many = nodes.where("n_rows > 1") if labels is None else nodes.join(labels.hint("merge"), "id", "left").where("n_rows > 1 or component <> id")
    classes = many.select("print", F.col("id").alias("component_id") if labels is None else F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "print").join(_small(scratch.keep(classes, "classes"), p), "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _small(table: DataFrame, p: MinMax) -> DataFrame:
    """The written table, to be broadcast if it has few rows and to be shuffled if not."""
    return F.broadcast(table) if table.count() <= p.max_broadcast_ids else table.hint("merge")


def keep_one(docs: DataFrame, p: MinMax = MinMax()) -> DataFrame:
    """The rows of ``docs`` but for all copies save one of each group.

    The row of the smallest id stays.  Rows that share an id are one
    document only if their texts agree too; rows without words or without an
    id are linked with nothing and stay.
    """
    scratch, own = Scratch(docs.sparkSession), free_name(docs, "key")
    # ids that two texts share would make one node of them
    key = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), 1)
    named = docs.where("doc_id is not null")
    found = near_duplicates(named.select(key.alias("doc_id"), "text"), p).where("n_shingles > 0").select(F.col("doc_id").alias(own), "component_id").distinct()
    many = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    members = scratch.keep(found.join(many.hint("merge"), "component_id").join(named.select(key.alias(own), "doc_id").distinct().hint("merge"), own), "members")
    firsts = members.groupBy("component_id").agg(F.min(F.struct("doc_id", own)).alias("first"))
    gone = scratch.keep(members.join(firsts.hint("merge"), "component_id").where(F.col(own) != F.col("first")[own]).select(own), "gone")
    if gone.count() <= p.max_broadcast_ids:
        gone = F.broadcast(gone)
    left = docs.withColumn(own, key).join(gone, own, "left_anti").select(*docs.columns)
    twice = scratch.keep(docs.where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left
    again = left.join(twice, "doc_id", "left_semi").select(*docs.columns)
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).union(again.dropDuplicates(["doc_id", "text"]))
