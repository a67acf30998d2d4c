"""Notes from files or tables, parsed into typed columns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.functions import parsing as P

#: Folders that hold knowledge notes.
ROOTS = ("知识簇", "_graphify/sources", "_graphify/indexes")


#: Where a vault keeps files.
FOLDERS = ("raw", *ROOTS)
FILES = "path string, modificationTime timestamp, length bigint, content binary"
LISTS = ("aliases", "tags", "source_refs", *P.RELATIONS, *P.CLAIM_FIELDS)
LISTED = "path string, is_folder boolean, length bigint, at double, hidden boolean"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``(rel_path, size, modified, content)`` of a vault's files.

    Spark's readers pass over names that begin with an underscore or a dot, so
    such files, and all below such folders, are found by listing, folder by
    folder, and are fetched one at a time.  A root that only Spark's file
    systems know (a mount table) is resolved to where it lies.  The content
    column is only read where a later step selects it.
    """
    jvm, root = spark._jvm, root.rstrip("/")
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(path(root)).toString()
    folders = [f for f in FOLDERS if fs.exists(path(f"{base}/{f}"))]
    if not folders:
        return spark.createDataFrame([], "rel_path string, size bigint, modified timestamp, content binary")
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{base}/{f}" for f in folders])
    parts = [(base, seen), (fs.resolvePath(path(root)).toString(), None)]
    out = None
    for place, table in parts:
        if table is None:
            table = _hidden(spark, [f"{place}/{f}" for f in folders])
        # paths come with or without an authority: what counts follows the root
        plain = F.lit(place.split(":", 1)[-1].lstrip("/") + "/")
        rel = F.substring("path", F.instr("path", plain) + F.length(plain), F.length("path"))
        own = table.select(rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
        out = own if out is None else out.unionByName(own)
    return out


def _hidden(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``(path, modificationTime, length, content)`` of files that Spark's readers pass over.

    The folders in the roots are dealt to tasks, which walk what is below
    them; the files found are dealt again, so that no task fetches many more
    than another.
    """
    tasks = spark.sparkContext.defaultParallelism * 4
    roots = spark.createDataFrame([(f, False) for f in folders], "path string, hidden boolean")
    top = roots.repartition(len(folders), "path").mapInArrow(_list, LISTED)
    below = top.where("is_folder").select("path", "hidden").repartition(tasks, "path").mapInArrow(_walk, LISTED)
    files = top.unionByName(below).where("hidden and not is_folder")
    return files.select("path", F.timestamp_seconds("at").alias("modificationTime"), "length").repartition(tasks, "path").mapInArrow(_fetch, FILES)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", uri), safe=":/"))


def _entries(uri: str, hidden: bool) -> pa.RecordBatch:
    """What stands in a folder; below a hidden folder all is hidden."""
    store, folder = _opened(uri)
    found = store.get_file_info(fs.FileSelector(folder))
    cols = (
        [f"{uri}/{x.base_name}" for x in found],
        [x.type == fs.FileType.Directory for x in found],
        [x.size or 0 for x in found],
        [x.mtime_ns / 1e9 if x.mtime_ns else 0.0 for x in found],
        [hidden or x.base_name[0] in "_." for x in found],
    )
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "is_folder", "length", "at", "hidden"])


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each folder ``(path, hidden)``."""
    for batch in batches:
        for uri, hidden in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
            yield _entries(uri, hidden)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each folder and of all folders below it, a folder at a time."""
    for batch in batches:
        open_folders = list(zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True))
        while open_folders:
            found = _entries(*open_folders.pop())
            inner = found.filter(found.column("is_folder"))
            open_folders += zip(inner.column("path").to_pylist(), inner.column("hidden").to_pylist(), strict=True)
            yield found


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the named files; one file's content is held at a time."""
    for batch in batches:
        for i, uri in enumerate(batch.column(0).to_pylist()):
            store, path = _opened(uri)
            with store.open_input_stream(path) as f:
                content = pa.array([f.read()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, content], names=["path", "modificationTime", "length", "content"])


def write_files(texts: DataFrame, root: str) -> DataFrame:
    """Writes each ``(rel_path, text)`` as a file below ``root``; ``(rel_path, size)`` of what was written.

    A file gets its name when it is complete, so a task that is run again
    leaves whole files.
    """
    spark = texts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    place = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for rel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, to = _opened(f"{place}/{rel}")
                store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                data, draft = (text or "").encode(), f"{to}.{uuid.uuid4().hex}.draft"
                with store.open_output_stream(draft) as f:
                    f.write(data)
                store.move(draft, to)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["rel_path", "size"])

    return texts.select("rel_path", "text").mapInArrow(run, "rel_path string, size bigint")


def snapshot(files: DataFrame, hashed: bool = True) -> DataFrame:
    """``(path, mtime, size, sha256)``, times in nanoseconds; the hash is null if not asked for."""
    digest = F.sha2(F.col("content"), 256) if hashed else F.lit(None).cast("string")
    return files.select(F.col("rel_path").alias("path"), (F.unix_micros("modified") * 1000).alias("mtime"), "size", digest.alias("sha256"))


def _is_markdown(path):
    return path.rlike(r"(?i)\.(md|markdown)$")


def texts_of(files: DataFrame) -> DataFrame:
    """``(rel_path, text)`` of knowledge and raw files; text only if Markdown."""
    p = F.split("rel_path", "/")
    knowledge = _is_markdown(F.col("rel_path")) & F.col("rel_path").rlike("^(?:" + "|".join(ROOTS) + ")/")
    raw = F.col("rel_path").startswith("raw/") & (F.element_at(p, -1) != ".DS_Store") & (F.coalesce(F.get(p, F.lit(1)), F.lit("")) != "assets")
    return files.where(knowledge | raw).select("rel_path", F.when(_is_markdown(F.col("rel_path")), P.universal_newlines(F.decode("content", "UTF-8"))).alias("text"))


def parse(texts: DataFrame) -> DataFrame:
    """``(rel_path, text)`` rows as notes and raw items with all their fields.

    ``is_raw`` tells raw items; those without text are inbox items titled by
    their file name.  Missing texts are '', only ``confidence`` can be null.
    ``fields`` are the values as written (``P.written_fields``).
    """
    return typed(heads(texts))


def _with_lines(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` with the first line of each key's value, so that it is taken once."""
    return table.select("*", *[P.first_line(F.col("fields")[k]).alias(f"__{k}") for k in keys])


def _text(key: str) -> Column:
    return P.text_of(F.col("fields")[key], F.col(f"__{key}"))


def _with_fields(texts: DataFrame) -> DataFrame:
    """``(rel_path, body, fields)``; each step is a column of its own that the next one reads twice, so that it is taken once."""
    split = P.front_matter(F.col("text"))
    head, body = split["head"], split["body"]
    out = texts.select("rel_path", F.coalesce("text", F.lit("")).alias("text"))
    out = out.select("rel_path", head.alias("head"), body.alias("body"))
    out = out.select("rel_path", "body", P.key_block(F.col("head")).alias("block"))
    keys, parts = P.keys_and_values(F.col("block"))
    out = out.select("rel_path", "body", keys.alias("keys"), parts.alias("parts"))
    return out.select("rel_path", "body", P.fields_of(F.col("keys"), F.col("parts")).alias("fields"))


def heads(texts: DataFrame) -> DataFrame:
    """``(rel_path, text)`` rows split into body and written fields, with what tells notes apart."""
    read = _with_fields(texts)
    is_raw = F.col("rel_path").startswith("raw/")
    kind = P.kind_of(F.col("rel_path"))
    status = _text("status")
    return _with_lines(read, *P.TITLES, "type", "status", "source_type").select(
        "rel_path",
        is_raw.alias("is_raw"),
        P.title_of(F.col("rel_path"), {k: _text(k) for k in P.TITLES}, F.col("body")).alias("title"),
        "body",
        "fields",
        kind.alias("kind"),
        F.when(is_raw, "raw").otherwise(F.coalesce(F.nullif(_text("type"), F.lit("")), kind)).alias("note_type"),
        F.when(is_raw & (status == ""), "inbox").otherwise(status).alias("status"),
        F.coalesce(F.when(is_raw, F.nullif(_text("source_type"), F.lit(""))), P.source_type(F.col("rel_path"))).alias("source_type"),
    )


def typed(read: DataFrame) -> DataFrame:
    """``heads`` with the values that are only taken apart where a plan asks for them."""
    texts = ("origin", "captured_at", "updated_at", "review_after")
    return _with_lines(read, *LISTS, "confidence", *texts).select(
        *read.columns,
        *[P.list_of(F.col("fields")[k], F.col(f"__{k}")).alias(k) for k in LISTS],
        P.wikilinks(F.col("body")).alias("wikilinks"),
        P.double_of(F.col("fields")["confidence"], F.col("__confidence")).alias("confidence"),
        *[_text(k).alias(k) for k in texts],
    )


def unticked(checklist: DataFrame) -> DataFrame:
    """``(ref, pos)`` of the open items of ``(text)`` checklists, deduplicated.

    An item gives its wikilink targets, then its backticked strings, else
    the plain path before `` #``.
    """
    line = F.col("line")
    item = F.regexp_extract(line, r"^\s*- \[ \]\s*(.*)$", 1)
    links = P.wikilinks(item)
    ticks = F.filter(F.transform(F.regexp_extract_all(item, F.lit("`([^`]+)`"), F.lit(1)), P.strip), lambda x: x != "")
    plain = F.array(P.strip(F.regexp_replace(item, r"\s#.*$", "")))
    found = F.concat(links, ticks)
    refs = F.when(F.size(found) > 0, found).otherwise(F.filter(plain, lambda x: x != ""))
    rows = checklist.select(F.posexplode(P.lines(F.col("text"))).alias("n", "line")).where(line.rlike(r"^\s*- \[ \]\s"))
    each = rows.select("n", F.posexplode(refs).alias("i", "ref"))
    first = each.groupBy("ref").agg(F.min(F.struct("n", "i")).alias("at"))
    # a line's number takes the high half, so that no item passes the next line
    return first.select("ref", (F.shiftleft(F.col("at.n").cast("bigint"), 32) + F.col("at.i")).alias("pos"))
