"""Token ids of a corpus as Huffman-coded shard files, and back.

Texts are encoded with a tokenizer of the ``tokenizers`` library, in order of
document id, and an end id follows each.  One canonical, length-limited
Huffman code is made from the corpus's own id counts (package-merge, so no
code is longer than ``max_bits``).  A shard file holds

* the magic bytes, the deflated code lengths by id, and the coded ids;
* for every block of ``block`` ids the bit offset at which it begins;
* for every document its id, whether that is null, and its number of ids;
* a fixed trailer with the sizes of these parts and the magic bytes again.

A block decodes on its own from its offset, so a reader steps through many
blocks at once: one table lookup gives the next id of each and the length of
its code.  A shard is written under a name of its own attempt and becomes part
of the data set by its row in ``manifest``, which Spark commits; what lost or
repeated attempts leave behind is never read.

Defined results: null texts are empty and have the end id alone; rows that
share an id stand side by side, in an order that their texts decide; a null
``doc_id`` comes first; an empty table gives no shard and reads as no row;
other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notegraph.llm.scratch import Scratch, opened
from notegraph.llm.shingles import text_blocks, word_hashes

MAGIC = b"HUFIDS01"
#: Words that the tokenizer's normaliser only lower-cases, and
#: the pieces into which it cuts them.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Bytes of a known piece besides its text.
ENTRY = 250
#: Another byte for each byte, blanks for blanks: gives words a second hash.
OTHER = np.arange(256, dtype=np.uint8)
_NO_BLANK = np.delete(OTHER, [32, 9, 10, 11, 12, 13])
OTHER[_NO_BLANK] = np.random.default_rng(5).permutation(_NO_BLANK)
#: Bytes of the code lengths and of the ids, ids, documents, ids in a block, bits of the longest code.
TRAILER = struct.Struct("<6Q8s")


@dataclass(frozen=True)
class Spec:
    """The tokenizer's file and the shape of the shards."""

    tokenizer: str
    end_id: int = 2
    max_bits: int = 18
    block: int = 256
    chunk_blocks: int = 4096
    shard_tokens: int = 1 << 26
    cache_bytes: int = 1 << 28


class Known:
    """Numbers of the words met so far, by their 128-bit prints (open addressing)."""

    def __init__(self, bits: int = 16):
        self.n, self.bits = 0, bits
        self.prints, self.number = np.zeros((1 << bits, 2), np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, p: np.ndarray) -> np.ndarray:
        return (p[:, 0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, p: np.ndarray) -> np.ndarray:
        """The number of each print, -1 if it is new."""
        out, slot, left = np.full(len(p), -1, np.int32), self._slots(p), np.arange(len(p))
        while len(left):
            at = slot[left]
            same = (self.prints[at] == p[left]).all(axis=1) & (self.number[at] >= 0)
            out[left[same]] = self.number[at[same]]
            left = left[~same & (self.number[at] >= 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, p: np.ndarray) -> None:
        """Numbers new, distinct prints in turn."""
        if (self.n + len(p)) * 2 > 1 << self.bits:
            used = self.number >= 0
            old = self.prints[used][np.argsort(self.number[used])]
            self.__init__(int(2 * (self.n + len(p))).bit_length() + 1)
            self.add(old)
        slot, left = self._slots(p), np.arange(len(p))
        while len(left):
            free = left[self.number[slot[left]] < 0]
            self.number[slot[free]] = self.n + free
            self.prints[slot[free]] = p[free]
            left = left[(self.number[slot[left]] != self.n + left)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.n += len(p)


class Words:
    """Ids of texts, word by word: a word that was met before is not encoded again.

    For tokenizers that drop white space: no token spans an ASCII blank, so a
    text's ids are those of its words in turn.  Words of plain letters and
    signs are cut further, as the tokenizer itself does, and their new pieces
    are encoded many in a call.  What is known is forgotten once it fills
    ``cache_bytes``.
    """

    def __init__(self, path: str, cache_bytes: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        #: Which ids end a piece.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.limit = cache_bytes
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.known, self.ids, self.ends, self.bytes = Known(), bytearray(), array("q", [0]), 0

    def _ids(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _learn_pieces(self, new: list[str]) -> None:
        groups = [new[i : i + 128] for i in range(0, len(new), 128)]
        for group, made in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            ids = np.array(made.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(group):
                raise ValueError("the tokenizer cuts words in another way")
            data, cuts = ids.tobytes(), (ends * 4).tolist()
            self.pieces.update((p, data[a:b]) for p, a, b in zip(group, [0, *cuts], cuts, strict=False))
            self.bytes += sum(map(len, group)) + ENTRY * len(group)

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode(errors="replace") for w in words]
        cut = [PIECE.findall(t.lower()) if PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        if new := list({p for ps in cut if ps for p in ps}.difference(self.pieces)):
            self._learn_pieces(new)
        whole = iter(self._ids([t for t, ps in zip(texts, cut, strict=True) if ps is None]))
        made = [b"".join(map(self.pieces.__getitem__, ps)) if ps is not None else np.array(next(whole).ids, "<u4").tobytes() for ps in cut]
        self.ids += b"".join(made)
        self.ends.frombytes((self.ends[-1] + np.cumsum(np.fromiter(map(len, made), np.int64)) // 4).tobytes())
        self.bytes += 64 * len(words) + sum(map(len, made))

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and how many each text has.

        The i-th text are the bytes from ``at[i]`` to ``at[i + 1]``.
        """
        data = np.full(len(raw) + len(at) - 1, 32, np.uint8)
        keep = np.ones(len(data), bool)
        keep[at[1:] + np.arange(len(at) - 1)] = False  # a blank after each text
        data[keep] = raw
        start, end, h = word_hashes(data)
        prints = np.stack((h, word_hashes(OTHER[data])[2]), axis=1)
        if self.bytes > self.limit:
            self._forget()
        number = self.known.find(prints)
        while len(new := np.flatnonzero(number < 0)):
            new = new[np.unique(prints[new, 0], return_index=True)[1]]
            self._learn([data[a:b].tobytes() for a, b in zip(start[new], end[new], strict=True)])
            self.known.add(prints[new])
            left = np.flatnonzero(number < 0)
            number[left] = self.known.find(prints[left])
        ids, ends = np.frombuffer(self.ids, "<u4"), np.frombuffer(self.ends, np.int64)
        first = ends[number]
        size = ends[number + 1] - first
        total = np.concatenate(([0], np.cumsum(size)))
        edges = np.searchsorted(start, at + np.arange(len(at)))
        return ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])], np.diff(total[edges])


@lru_cache(maxsize=2)
def _words(path: str, cache_bytes: int) -> Words:
    return Words(path, cache_bytes)


def token_ids(docs: DataFrame, s: Spec) -> DataFrame:
    """``(doc_id, at, ids)`` in order: little-endian 32-bit ids, the end id last.

    ``at`` numbers the rows in document order, with gaps between partitions.
    Equal ids are told apart by text and then by row, so that no id's rows
    must share a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _words(s.tokenizer, s.cache_bytes)
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, raw, edges in text_blocks(batch.column(1)):
                n = len(edges) - 1
                ids, counts = w.encode(raw, edges)
                ids = np.insert(ids, np.cumsum(counts), s.end_id).astype("<u4")
                ends = np.concatenate(([0], np.cumsum(counts + 1))) * 4
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.arange(at, at + n)), packed], names=["doc_id", "at", "ids"])
                at += n

    order = ["doc_id", "tie", "row"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "doc_id bigint, at bigint, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """``(id, n)``: how often each id stands in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(_flat(batch.column(0)))
            total, own = (total, own) if len(total) >= len(own) else (own, total)
            total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _flat(column: pa.Array) -> np.ndarray:
    """All ids of a column of binary id lists."""
    _, ends, data = column.buffers()
    edges = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "<u4")[edges[0] // 4 : edges[-1] // 4] if len(column) and data is not None else np.zeros(0, "<u4")


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Best code length of each id, none over ``max_bits``; 0 for ids that don't occur.

    Package-merge: at each of ``max_bits`` levels the sorted ids are merged
    with the pairs of the level below; going back down, the cheapest items
    are kept, and an id's length is the number of levels that keep it.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, kept = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        place = np.argsort(both, kind="stable")
        level = both[place]
        kept.append(place < len(leaves))
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(kept):
        own = int(np.count_nonzero(is_leaf[:take]))
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Codes:
    """Canonical codes of some code lengths: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray, max_bits: int):
        self.lengths, self.max_bits = lengths, max_bits
        order = np.flatnonzero(lengths)
        order = order[np.argsort(lengths[order], kind="stable")]
        room = np.int64(1) << (max_bits - lengths[order].astype(np.int64))
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (np.cumsum(room) - room).astype(np.uint64) >> (max_bits - lengths[order]).astype(np.uint64)
        #: For the next ``max_bits`` bits: 32 * id + code length.
        self.table = np.zeros(1 << max_bits, np.uint32)
        filled = np.repeat(order.astype(np.uint32) << np.uint32(5) | lengths[order], room)
        self.table[: len(filled)] = filled


def pack(ids: np.ndarray, c: Codes, block: int) -> tuple[bytes, np.ndarray]:
    """The coded ids, from a byte's first bit, and each block's bit offset."""
    size = c.lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    word = start >> 5
    wide = c.codes[ids] << (64 - (start & 31) - size).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
    # codes don't overlap, so sums are unions of bits
    out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: int(end[-1] + 7) // 8], start[::block]


def unpack(data: bytes, offsets: np.ndarray, n: int, c: Codes, block: int) -> np.ndarray:
    """The first ``n`` ids of blocks that begin at bit ``offsets`` of ``data``.

    All blocks advance together, an id a step; the last one may be short.
    """
    raw = np.frombuffer(data + bytes(block * c.max_bits // 8 + 8), np.uint8).astype(np.uint32)
    ahead = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at = offsets.astype(np.int64)
    out = np.empty((min(block, n), len(at)), np.uint32)
    drop = np.uint32(32 - c.max_bits)
    for row in out:
        entry = c.table[(ahead[at >> 3] << (at & 7).astype(np.uint32)) >> drop]
        np.right_shift(entry, np.uint32(5), out=row)
        at += entry & np.uint32(31)
    return out.T.reshape(-1)[:n]


class ShardWriter:
    """One shard file; ids are coded a chunk of whole blocks at a time."""

    def __init__(self, uri: str, c: Codes, s: Spec):
        self.c, self.s = c, s
        self.store, path = opened(uri)
        self.out = self.store.open_output_stream(path)
        self.head = zlib.compress(c.lengths.tobytes())
        self.out.write(MAGIC + self.head)
        self.held: list[np.ndarray] = []
        self.waiting = self.tokens = self.bytes = 0
        self.offsets: list[np.ndarray] = []
        self.docs: list[tuple[int, bool, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.waiting += len(ids)
        self.tokens += len(ids)
        chunk = self.s.block * self.s.chunk_blocks
        if self.waiting >= chunk:
            self._flush(self.waiting // chunk * chunk)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held)
        data, offsets = pack(ids[:n], self.c, self.s.block)
        self.offsets.append(offsets + self.bytes * 8)
        self.out.write(data)
        self.bytes += len(data)
        self.held, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        """Writes what is left; the numbers of documents and of ids."""
        if self.waiting:
            self._flush(self.waiting)
        for values, kind in ((np.concatenate(self.offsets), "<u8"), ([d[0] for d in self.docs], "<i8"), ([d[1] for d in self.docs], "u1"), ([d[2] for d in self.docs], "<u8")):
            self.out.write(np.array(values).astype(kind).tobytes())
        self.out.write(TRAILER.pack(len(self.head), self.bytes, self.tokens, len(self.docs), self.s.block, self.c.max_bits, MAGIC))
        self.out.close()
        return len(self.docs), self.tokens


class Shard:
    """A written shard file: its documents, and any stretch of its ids."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        head, self.bytes, self.n_tokens, n_docs, self.block, max_bits, magic = TRAILER.unpack(self._at(end - TRAILER.size, TRAILER.size))
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no shard of token ids")
        self.first = len(MAGIC) + head
        self.codes = Codes(np.frombuffer(zlib.decompress(self._at(len(MAGIC), head)), np.uint8), max_bits)
        blocks = -(-self.n_tokens // self.block)
        index = self._at(self.first + self.bytes, blocks * 8 + n_docs * 17)
        self.offsets = np.frombuffer(index, "<u8", blocks).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, blocks * 8)
        self.nulls = np.frombuffer(index, "u1", n_docs, blocks * 8 + n_docs * 8).astype(bool)
        self.counts = np.frombuffer(index, "<u8", n_docs, blocks * 8 + n_docs * 9).astype(np.int64)

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b`` (exclusive): only the blocks that hold them are read."""
        if a >= b:
            return np.zeros(0, np.uint32)
        one, last = a // self.block, -(-b // self.block)
        low = int(self.offsets[one]) // 8
        high = -(-int(self.offsets[last]) // 8) if last < len(self.offsets) else self.bytes
        n = min(last * self.block, self.n_tokens) - one * self.block
        made = unpack(self._at(self.first + low, high - low), self.offsets[one:last] - low * 8, n, self.codes, self.block)
        return made[a - one * self.block : b - one * self.block]

    def documents(self, step: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last, exclusive, their ids) of runs of about ``step`` ids."""
        ends = np.cumsum(self.counts)
        first = 0
        while first < len(ends):
            start = int(ends[first] - self.counts[first])
            last = max(first + 1, int(np.searchsorted(ends, start + step, "right")))
            yield first, last, self.ids(start, int(ends[last - 1]))
            first = last


def write(docs: DataFrame, path: str, s: Spec) -> None:
    """Writes the shards of ``docs`` and their manifest below ``path``.

    The number of distinct ids, and so what the driver gets to make the code
    from, is that of the vocabulary.
    """
    scratch = Scratch(docs.sparkSession)
    tokens = scratch.keep(token_ids(docs, s), "ids")
    rows = id_counts(tokens).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, s.max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(lengths, s.max_bits)
        shard, begun, name, after, done = None, 0, "", -1, []
        for batch in batches:
            ats, ids = batch.column(1).to_numpy(), batch.column(2)
            flat, edges = _flat(ids), np.concatenate(([0], np.cumsum(pa.compute.binary_length(ids).to_numpy(zero_copy_only=False) // 4)))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                # a shard holds neighbours in document order
                if shard is not None and (ats[i] != after or shard.tokens >= s.shard_tokens):
                    done.append((begun, name, *shard.close()))
                    shard = None
                if shard is None:
                    begun, name = int(ats[i]), f"{ats[i]:015d}-{uuid.uuid4().hex}.huf"
                    shard = ShardWriter(f"{path}/shards/{name}", codes, s)
                shard.add(doc_id, flat[edges[i] : edges[i + 1]])
                after = ats[i] + 1
        if shard is not None:
            done.append((begun, name, *shard.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["at", "file", "n_docs", "n_tokens"])

    tokens.select("doc_id", "at", "ids").mapInArrow(run, "at bigint, file string, n_docs bigint, n_tokens bigint").write.mode("overwrite").parquet(f"{path}/manifest")
    scratch.clear()


def read(spark: SparkSession, path: str, step: int = 1 << 20) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document below ``path``.

    ``start`` counts the ids of all documents before; ``ids`` are
    little-endian unsigned 32-bit numbers, the end id included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                shard = Shard(f"{path}/shards/{name}")
                for first, last, ids in shard.documents(step):
                    n = shard.counts[first:last]
                    ends = np.concatenate(([0], np.cumsum(n)))
                    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                    doc_ids = pa.array(shard.doc_ids[first:last], mask=shard.nulls[first:last])
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(at + ends[:-1]), pa.array(n), packed], names=["doc_id", "start", "n_tokens", "ids"])
                    at += int(ends[-1])

    shards = spark.read.schema("at bigint, file string, n_docs bigint, n_tokens bigint").parquet(f"{path}/manifest")
    # one row for each shard: all of them are one small partition, then dealt out again
    before = F.sum("n_tokens").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    return placed.repartition(max(1, shards.count())).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def digest(docs: DataFrame, s: Spec) -> DataFrame:
    """The rows of the ``op11`` query, from files written and read again."""
    path = f"{Scratch(docs.sparkSession).root}/shards-of-ids"
    write(docs, path, s)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
