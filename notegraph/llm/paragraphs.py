"""Repeated paragraphs and passages across documents.

A paragraph is a line of at least ``min_words`` words.  Paragraphs get
MinHash bands tuned for high recall at the threshold, those that collide are
joined and verified by the exact Jaccard index of their full shingle sets,
and components of verified links decide what goes: of each component the
paragraph of the smallest document (then the earliest) stays.

A passage is a run of at least ``min_words`` words that stands in two places,
wherever lines begin and end: its paragraphs are the overlapping windows of
``min_words`` words that cover the whole text.  Their MinHash is one band of
one value, the least hash of the pieces of half their words inside them
(equal windows always share it), so only windows whose band collides are
compared, by their own hashes of 95 bits.  Each repeated window is a copy of its first place;
neighbouring copies of one place join to whole runs.

Equal paragraphs are one node before anything is paired, and equal texts one
before windows are made, so that a passage that a third of all documents
share costs one node, not its square; windows are grouped, never paired.

Defined results: null or empty texts and lines of fewer words are no
paragraphs; repeats inside one document count too; rows that repeat a
document repeat its paragraphs; a null ``doc_id`` comes after all others;
other columns pass through, whatever their names; an empty table gives an
empty one.
Words are compared with A-Z lower-cased; blanks between them don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.minhash import MinMax, near_duplicates
from notegraph.llm.scratch import Scratch
from notegraph.llm.shingles import document_words, rolling_hashes, sliding
from notegraph.llm.text import free_name

#: 16 bands of 4 values: a link at 0.8 shares a band with probability 0.9998.
BANDS = MinMax(words=5, percent=80, permutations=32, rows=4, max_broadcast_ids=1_000_000)
MIN_WORDS = 50
#: Tables of marks and of texts up to this many rows are broadcast.
MAX_BROADCAST_ROWS = 1_000_000
_OTHER_BASE = 0xD6E8FEB86659FD93
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, text)``; ``row_key`` tells apart rows that share an id."""
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"), text.alias("text"))


def split_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(para_id, doc_id, row_key, place, start, end, n_words, text)``.

    ``start`` and ``end`` are code points of the whole text.  ``para_id`` is
    made of the task and a running number, so the result has to be written
    once before it is used twice.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, row_key, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                at = 0
                for place, line in enumerate((text or "").split("\n")):
                    # a word has a character and a blank at least; bytes split at the six ASCII blanks
                    words = len(line.encode().split()) if len(line) >= 2 * min_words - 1 else 0
                    if words >= min_words:
                        for c, x in zip(cols, (n, doc_id, row_key, place, at, at + len(line), words, line), strict=True):
                            c.append(x)
                        n += 1
                    at += len(line) + 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["para_id", "doc_id", "row_key", "place", "start", "end", "n_words", "text"])

    return _rows(docs).mapInArrow(cut, "para_id bigint, doc_id bigint, row_key bigint, place int, start bigint, end bigint, n_words bigint, text string")


def similar_paragraphs(docs: DataFrame, p: MinMax, min_words: int, scratch: Scratch) -> DataFrame:
    """One row per paragraph that has a repeat, as ``repeated_paragraphs``."""
    paras = scratch.keep(split_paragraphs(docs, min_words), "paras")
    own = Scratch(docs.sparkSession)
    classes = near_duplicates(paras.select(F.col("para_id").alias("doc_id"), "text"), p, own)
    classes = scratch.keep(classes.where("component_id is not null").select(F.col("doc_id").alias("para_id"), F.col("component_id").alias("group_id")), "classes")
    own.clear()
    groups = classes.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    groups = _small(scratch.keep(groups, "sizes"))
    placed = scratch.keep(paras.drop("text").join(classes.join(groups, "group_id"), "para_id"), "placed")
    scratch.drop(paras, classes)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "para_id")
    firsts = scratch.keep(placed.groupBy("group_id").agg(F.min(first).alias("first")), "firsts")
    return placed.join(_small(firsts), "group_id").select(
        "doc_id",
        "place",
        "start",
        "end",
        "n_words",
        "group_id",
        F.col("first.doc_id").alias("keeper_doc_id"),
        "n_copies",
        (F.col("para_id") == F.col("first.para_id")).alias("kept"),
        "row_key",
    )


def _small(table: DataFrame) -> DataFrame:
    """The written table, broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table


def _marks(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece hashes, and the least one in each window of ``size`` words."""
    pieces = rolling_hashes(h, size // 2)
    return pieces, sliding(np.minimum, pieces, size - size // 2 + 1)


def _signed(texts: DataFrame, size: int) -> DataFrame:
    """``texts`` with the marks of their windows, and those at two places."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = size - size // 2 + 1
        for batch in batches:
            counts, keys, twice = [], [], []
            for _, h in document_words(batch.column("text")):
                values, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(h) >= size:
                    pieces, least = _marks(h, size)
                    # a piece is a mark where the largest minimum around it is its own
                    values, n = np.unique(pieces[pieces == sliding(np.maximum, np.pad(least, width - 1), width)], return_counts=True)
                counts.append(len(h))
                keys.append(values.astype(np.int64))
                twice.append(values[n > 1].astype(np.int64))
            marks = [pa.array(x, pa.list_(pa.int64())) for x in (keys, twice)]
            columns = [batch.column(c) for c in ("doc_id", "row_key", "text_id", "length")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), *marks], names=["doc_id", "row_key", "text_id", "length", "n_words", "marks", "twice"])

    return texts.mapInArrow(sign, "doc_id bigint, row_key bigint, text_id bigint, length bigint, n_words bigint, marks array<bigint>, twice array<bigint>")


def _candidates(h: np.ndarray, spots: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows with a mark in ``spots``: place, first place in the text, two hashes."""
    at = np.flatnonzero(np.isin(_marks(h, size)[1], spots.to_numpy(zero_copy_only=False).astype(np.uint64)))
    key, more = rolling_hashes(h, size)[at], rolling_hashes(h, size, _OTHER_BASE)[at] >> np.uint64(33)
    _, first, same = np.unique(np.stack((key, more)), axis=1, return_index=True, return_inverse=True) if len(set(key.tolist())) < len(at) else (0, np.arange(len(at)), np.arange(len(at)))
    return at, at[first][same.ravel()], key.astype(np.int64), more.astype(np.int32)


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """``(key, more, doc, text_id, n, at)``: each text's distinct windows with a mark in ``spots``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, h in document_words(batch.column("text")):
                at, first, key, more = _candidates(h, batch.column("spots")[i].values, size)
                doc, text_id, n_rows = (batch.column(c)[i].as_py() for c in ("doc", "text_id", "n_rows"))
                own, n = at == first, np.bincount(first, minlength=len(h))
                m = int(own.sum())
                same = [pa.array(np.full(m, x, np.int64)) for x in (doc, text_id)]
                columns = [pa.array(key[own]), pa.array(more[own]), *same, pa.array(n[at[own]] * n_rows, pa.int64()), pa.array(at[own].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "more", "doc", "text_id", "n", "at"])

    return texts.select("doc", "text_id", "n_rows", "text", "spots").mapInArrow(emit, "key bigint, more int, doc bigint, text_id bigint, n bigint, at int")


def _joined(found: DataFrame, size: int) -> DataFrame:
    """Runs of each text of ``found(text_id, doc, n_rows, text, spots, windows)``, by code points.

    A run ends where the text that its windows are copies of changes.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for i, h in document_words(batch.column("text")):
                text_id, own_doc, n_rows = (batch.column(c)[i].as_py() for c in ("text_id", "doc", "n_rows"))
                at, from_at, _, _ = _candidates(h, batch.column("spots")[i].values, size)
                times = np.bincount(from_at, minlength=len(h))
                n, text, doc = times * n_rows, np.full(len(h), text_id), np.full(len(h), own_doc)
                origin, repeated = np.arange(len(h)), times > 1
                w = batch.column("windows")[i].values
                if w is not None and len(w):
                    here, place, n_all, from_text, from_doc = (w.field(c).to_numpy(zero_copy_only=False) for c in ("at", "from_at", "n", "from_text", "from_doc"))
                    n[here], text[here], doc[here], origin[here], repeated[here] = n_all, from_text, from_doc, place, True
                at, from_at = at[repeated[from_at]], from_at[repeated[from_at]]
                if not len(at):
                    continue
                n, text, doc, from_at = n[from_at], text[from_at], doc[from_at], origin[from_at]
                own = text == text_id
                kept = own & (at == from_at)
                # a copy that overlaps its first place goes from the end of that
                start = np.where(own & ~kept, np.maximum(at, from_at + size), at)
                new = np.flatnonzero((np.diff(at) != 1) | (text[1:] != text[:-1]) | (kept[1:] != kept[:-1])) + 1
                words = [m.span() for m in _WORD.finditer(batch.column("text")[i].as_py())]
                for a, b in zip([0, *new.tolist()], [*new.tolist(), len(at)], strict=True):
                    first, last = int(start[a:b].min()), int(at[b - 1]) + size
                    for c, x in zip(cols, (text_id, words[first][0], words[last - 1][1], last - first, int(doc[a]), int(n[a:b].max()), bool(kept[a])), strict=True):
                        c.append(x)
            kinds = (pa.int64(),) * 6 + (pa.bool_(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["text_id", "start", "end", "n_words", "keeper", "n_copies", "kept"])

    return found.mapInArrow(join, "text_id bigint, start bigint, end bigint, n_words bigint, keeper bigint, n_copies bigint, kept boolean")


def repeated_runs(docs: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """Runs of at least ``size`` words that stand in two places.

    The columns are those of ``repeated_paragraphs``; rows with the text of a
    smaller document are one run, that of the whole text.
    """
    rows = _rows(docs).withColumn("text_id", F.xxhash64("text")).withColumn("length", F.length("text").cast("bigint")).where("text is not null")
    signed = scratch.keep(_signed(rows, size).where(F.col("n_words") >= size), "signed")
    least = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "row_key")
    nodes = scratch.keep(signed.groupBy("text_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min(least).alias("first")).select("text_id", "n_rows", "first.*"), "texts")
    filed = signed.select("text_id", F.explode("marks").alias("mark"))
    shared = filed.groupBy("mark").agg(F.min("text_id").alias("x"), F.max("text_id").alias("y")).where("x <> y").select("mark")
    shared = _small(scratch.keep(shared.union(signed.select(F.explode("twice").alias("mark"))).distinct(), "marks"))
    spots = filed.join(shared, "mark").groupBy("text_id").agg(F.collect_set("mark").alias("spots"))
    spots = scratch.keep(spots.join(nodes, "text_id").withColumnRenamed("row_key", "chosen"), "spots")
    texts = rows.select("text_id", "row_key", "text").join(spots, "text_id").where("row_key = chosen").dropDuplicates(["text_id"])
    texts = scratch.keep(texts.select("text_id", "doc", "n_rows", "text", "spots"), "texts")
    windows = scratch.keep(_windows(texts, size), "windows")
    place = F.struct("doc", "text_id", "at")
    firsts = windows.groupBy("key", "more").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("n"), F.min(place).alias("from")).where("places > 1")
    copies = windows.select("key", "more", "text_id", "at").join(firsts, ["key", "more"])
    copies = copies.groupBy("text_id").agg(F.collect_list(F.struct("at", F.col("from.at").alias("from_at"), F.col("from.text_id").alias("from_text"), F.col("from.doc").alias("from_doc"), "n")).alias("windows"))
    runs = _joined(texts.join(copies, "text_id", "left").select("text_id", "doc", "n_rows", "text", "spots", "windows"), size).join(nodes.select("text_id", "doc", "row_key"), "text_id")
    whole = signed.join(nodes.where("n_rows > 1").select("text_id", "n_rows", "doc", F.col("row_key").alias("chosen")), "text_id")
    whole = whole.select("doc_id", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"), "n_words", F.col("doc").alias("keeper"), F.col("n_rows").alias("n_copies"), (F.col("row_key") == F.col("chosen")).alias("kept"), "row_key")

    def named(doc: str) -> Column:
        return F.when(F.col(doc) < 2**63 - 1, F.col(doc))

    found = runs.select(named("doc").alias("doc_id"), "start", "end", "n_words", "keeper", "n_copies", "kept", "row_key").union(whole)
    return found.select("doc_id", F.lit(None).cast("int").alias("place"), "start", "end", "n_words", F.lit(None).cast("bigint").alias("group_id"), named("keeper").alias("keeper_doc_id"), "n_copies", "kept", "row_key")


def repeated_paragraphs(docs: DataFrame, p: MinMax = BANDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, place, start, end, n_words, group_id, keeper_doc_id, n_copies, kept, row_key)``.

    One row per paragraph that has a repeat, with the document its group's
    kept paragraph stands in, and one per repeated run of words, with neither
    ``place`` nor ``group_id``.  A run inside a paragraph's row that says as
    much has no row of its own.
    """
    scratch = Scratch(docs.sparkSession)
    paras = scratch.keep(similar_paragraphs(docs, p, min_words, scratch), "paras")
    own = Scratch(docs.sparkSession)
    runs = scratch.keep(repeated_runs(docs, min_words, own), "runs")
    own.clear()
    lines = paras.groupBy("row_key").agg(F.collect_set(F.struct("start", "end", "kept")).alias("lines"))
    said = F.exists("lines", lambda x: (x["start"] <= F.col("start")) & (x["end"] >= F.col("end")) & (F.col("kept") | ~x["kept"]))
    runs = runs.join(lines, "row_key", "left").where(~F.coalesce(said, F.lit(False)))
    return paras.unionByName(runs.drop("lines"))


def remove_repeats(docs: DataFrame, p: MinMax = BANDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the paragraphs and runs that repeat a kept one.

    A paragraph goes with its line's end, and so does a line of which only
    blanks are left.  Where rows agree in id and text, what one of them keeps
    stays in all.
    """
    found = repeated_paragraphs(docs, p, min_words).groupBy("row_key", "place", "start", "end").agg(F.max("kept").alias("kept")).where("not kept")
    key, spans_of, columns = free_name(docs, "key"), free_name(docs, "gone"), docs.columns
    gone = found.groupBy(F.col("row_key").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(spans_of))
    joined = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).join(gone, key, "left").drop(key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(spans_of).to_pylist()
            texts = [t if g is None else _without(t, [(x["start"], x["end"]) for x in g]) for t, g in zip(batch.column("text").to_pylist(), spans, strict=True)]
            kept = {c: batch.column(c) for c in columns} | {"text": pa.array(texts, batch.schema.field("text").type)}
            yield pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))

    return joined.select(*columns, spans_of).mapInArrow(cut, docs.schema)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at, spans = [], 0, sorted(spans)
    for line in text.split("\n"):
        end, left, upto = at + len(line), [], at
        for a, b in spans:
            if a < end and b > upto:
                left.append(text[upto : max(a, upto)])
                upto = min(b, end)
        left.append(text[upto:end])
        rest = "".join(left)
        if upto == at or _WORD.search(rest):
            out.append(rest)
        at = end + 1
    return "\n".join(out)
