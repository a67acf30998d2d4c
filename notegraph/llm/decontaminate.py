"""Benchmark decontamination by template windows.

Texts are canonicalised to templates: numbers, units and names (runs of
capitalised words) become typed placeholders, so that a question whose
parameters were changed has the same template.  Windows of template words are
hash-joined with those of the benchmark; the windows of neighbouring
alignments are added up and their slots checked: a value must always be
replaced by the same value, and different values by different ones.  A
document is contaminated by an item when consistent windows cover enough of
the words that the item's windows hold.

Items with the same template share their windows.  Those whose slots are
equal in the same places (a class) accept the same documents, so slots are
checked once for a class; a copy that keeps an item's own values is reported
for that item.  Each item is also searched for as if it were written in lower
case, where names are no slots.

Scale: a document's windows are only exploded into the join and aggregated
by (document, template, alignment), so the shuffle holds matches, not the
text.  The benchmark's window table is broadcast behind a check of its size;
beyond that the join is an ordinary shuffled one.

Defined results: null or empty texts and items match nothing; an item of
fewer than ``least`` words is found where it is a whole document; items
shorter than the window are searched for with windows of their own length;
windows with more placeholders than words are no evidence, and an item that
has no others is found by its own values alone; rows with the same id and
text are reported once; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.llm.scratch import Scratch
from notegraph.llm.text import free_name, let

#: Placeholders and the end of a slot's value, from the private
#: use area.
NUMBER, NAME, UNIT, BEYOND, END = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
#: Units of measure that follow a number.
UNITS = "km|m|cm|mm|mi|miles?|meters?|metres?|feet|ft|inch(?:es)?|kg|g|mg|lbs?|pounds?|grams?|tons?|l|ml|liters?|litres?|gallons?|hours?|hrs?|h|minutes?|mins?|seconds?|secs?|s|days?|weeks?|months?|years?|dollars?|euros?|cents?|usd|eur|percent|degrees?|mph|kmh|watts?|volts?"
#: Words that begin sentences without being names.
COMMON = "a an and as at but by each every few find for from give given he her his how i if in is it its let many no of on one or she some that the their then there these they this those to two we what when where which who why with you".split()


@dataclass(frozen=True)
class Templates:
    """Window length and what counts as contamination."""

    window: int = 8
    least: int = 5
    coverage: float = 0.6
    slack: int = 4
    max_broadcast_rows: int = 1_000_000


def tagged_words(text: Column) -> Column:
    """Lower-cased words; a slot is its placeholder and its value.

    A run of capitalised words is one name, groups of three digits one number.
    """
    text = F.coalesce(text, F.lit(""))
    names = F.regexp_replace(text, r"(?<![\p{L}\p{M}\p{N}])\p{Lu}[\p{L}\p{M}]*+(?:\x20\p{Lu}[\p{L}\p{M}]*+)*+", f" {NAME}$0{END} ")
    numbers = F.regexp_replace(names, r"[0-9]{1,3}(?:\x20[0-9]{3})++(?![0-9])|[0-9]++(?:[.,:/][0-9]++)*+", f" {NUMBER}$0{END} ")
    units = F.regexp_replace(numbers, rf"(?i)({NUMBER}[^{END}]++{END}\x20\x20?)({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2{END} ")
    marked = F.when(text.rlike("[0-9]"), units).otherwise(names)
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"[{NUMBER}{NAME}{UNIT}][^{END}]++|[\p{{L}}\p{{M}}\p{{N}}]++"), F.lit(0))


def _is_slot(word: Column) -> Column:
    return (word >= NUMBER) & (word < BEYOND)


def template(words: Column) -> Column:
    """Tagged words with the slot values dropped."""
    return F.transform(words, lambda w: F.when(_is_slot(w), F.substring(w, 1, 1)).otherwise(w))


def template_windows(words: Column, lengths: list[int], least: int) -> Column:
    """(n, pos, key) of each window of the given lengths.

    Lengths below ``least`` count only where they are the whole text's.
    """

    def of(h: Column, n: int) -> Column:
        fits = F.size(h) == n if n < least else F.size(h) >= n
        return F.when(~fits, F.array().cast("array<struct<n:int,pos:int,key:bigint>>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(F.lit(n).alias("n"), i.alias("pos"), F.xxhash64(F.slice(h, i + 1, n)).alias("key")))
        )

    return let(F.transform(template(words), lambda w: F.xxhash64(w)), lambda h: F.concat(*[of(h, n) for n in lengths]))


def _counts(slot: Column) -> Column:
    """Whether a slot of an item takes part in the check."""
    return ~F.substring(slot, F.lit(2), F.length(slot)).isin(*COMMON)


def _pattern(words: Column) -> Column:
    """For each checked slot, the first place with the same value."""
    return let(F.filter(words, lambda w: _is_slot(w) & _counts(w)), lambda s: F.transform(s, lambda w: F.array_position(s, w)))


def _variants(benchmark: DataFrame) -> DataFrame:
    """``(item_id, words, shape, class, size, twin)``: items as they are and in lower case.

    ``twin`` is the shape of the item as it is, for its other variant.
    """
    own, low = tagged_words(F.col("text")), tagged_words(F.lower("text"))
    cased = F.xxhash64(template(own))
    both = F.array(F.struct(own.alias("words"), F.lit(None).cast("bigint").alias("twin")), F.struct(low.alias("words"), cased.alias("twin")))
    words = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(both).alias("v")).select("item_id", "v.*").where(F.size("words") > 0)
    shaped = words.withColumn("shape", F.xxhash64(template(F.col("words")))).where("twin is null or twin <> shape")
    return shaped.withColumn("class", F.xxhash64("shape", _pattern(F.col("words")))).withColumn("size", F.size("words"))


def _item_windows(variants: DataFrame, lengths: list[int], t: Templates) -> DataFrame:
    """``(shape, n, at, key, dense, held)``: the windows of each template.

    ``held`` counts the words inside them; a ``dense`` template has no window
    with as many words as placeholders.  Of a lower-cased template only the
    windows count that its twin lacks.
    """
    shapes = variants.groupBy("shape").agg(F.first("words").alias("words"), F.min("twin").alias("twin")).withColumn("size", F.size("words"))
    own = F.filter(template_windows(F.col("words"), lengths, 0), lambda w: w["n"] == F.least("size", F.lit(t.window)))
    few = F.transform(own, lambda w: F.struct(w["n"].alias("n"), w["pos"].alias("at"), w["key"].alias("key"), (F.size(F.filter(F.slice("words", w["pos"] + 1, w["n"]), _is_slot)) * 2 <= w["n"]).alias("plain")))
    rows = shapes.select("shape", "twin", F.inline(few))
    rows = rows.join(rows.select(F.col("shape").alias("twin"), "key").distinct(), ["twin", "key"], "left_anti")
    per = rows.groupBy("shape", "n").agg(F.collect_set(F.when(F.col("plain"), F.col("at"))).alias("plain_at"), F.collect_set("at").alias("all_at"))
    dense = F.size("plain_at") == 0
    held = per.select("shape", dense.alias("dense"), _covered(F.when(dense, F.col("all_at")).otherwise(F.col("plain_at")), F.col("n")).alias("held"))
    return rows.join(held, "shape").where("plain or dense").select("shape", "n", "at", "key", "dense", "held")


def _covered(places: Column, n: Column) -> Column:
    """How many words windows of ``n`` words at some places hold."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda a: F.sequence(a, a + n - 1)))))


def one_to_one(pairs: Column) -> Column:
    """Whether the distinct pairs (a, b) map values one to one."""
    return let(
        pairs,
        lambda s: (F.size(F.array_distinct(F.transform(s, lambda p: p["a"]))) == F.size(s)) & (F.size(F.array_distinct(F.transform(s, lambda p: p["b"]))) == F.size(s)),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, t: Templates = Templates()) -> DataFrame:
    """``(doc_id, row_key, item_id, n_items, coverage, exact)``.

    One row per document and item whose template it holds; ``row_key`` tells
    apart rows that share an id.  ``exact`` is true when the slot values are
    those of the item; otherwise ``item_id`` stands for the ``n_items`` items
    of its class, of which it is the smallest.
    """
    scratch = Scratch(docs.sparkSession)
    variants = scratch.keep(_variants(benchmark), "variants")
    # at most ``window`` different lengths
    lengths = sorted(r[0] for r in variants.select(F.least("size", F.lit(t.window))).distinct().collect())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = texts.withColumn("row_key", F.xxhash64("doc_id", "text"))
    out = ("doc_id", "row_key", "item_id", "n_items", "coverage", "exact")
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, row_key bigint, item_id bigint, n_items bigint, coverage double, exact boolean")
    keys = scratch.keep(_item_windows(variants, lengths, t), "keys")
    if keys.count() <= t.max_broadcast_rows:
        keys = F.broadcast(keys)
    classes = scratch.keep(variants.groupBy("shape", "class", "size").agg(F.min_by("words", "item_id").alias("words"), F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("n_items")), "classes")
    itself = variants.groupBy("shape", F.xxhash64("words").alias("values")).agg(F.min("item_id").alias("itself"))
    filed = texts.select("doc_id", "row_key", F.explode(template_windows(tagged_words(F.col("text")), lengths, t.least)).alias("w")).select("doc_id", "row_key", "w.n", "w.pos", "w.key")
    hits = filed.join(keys, ["key", "n"]).groupBy("doc_id", "row_key", "shape", "n", (F.col("pos") - F.col("at")).alias("shift"), "dense", "held")
    runs = hits.agg(F.collect_set("at").alias("ats"))
    beside = Window.partitionBy("row_key", "doc_id", "shape").orderBy("shift").rangeBetween(0, t.slack)
    own = F.transform("ats", lambda a: F.struct(a.alias("at"), F.col("shift").alias("shift")))
    # one alignment, and what stands beside it where words were put in or left out
    runs = runs.withColumn("near", F.flatten(F.collect_list(own).over(beside))).withColumn("near", F.explode(F.array_distinct(F.array(own, F.col("near")))))
    runs = runs.withColumn("covered", _covered(F.transform("near", lambda x: x["at"]), F.col("n")) / F.col("held"))
    runs = scratch.keep(runs.where(F.col("covered") >= t.coverage).drop("ats"), "runs")
    # few documents are left: their words are made again and aligned
    found = texts.join(runs.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["doc_id", "row_key"]).select("row_key", "doc_id", tagged_words(F.col("text")).alias("own"))
    aligned = runs.join(found, ["row_key", "doc_id"])
    whole = F.when(F.col("shift") >= 0, F.xxhash64(F.slice("own", F.col("shift") + 1, F.col("size"))))
    aligned = aligned.join(classes, "shape").withColumn("values", whole).join(itself, ["shape", "values"], "left")
    parts = F.transform("near", lambda x: F.arrays_zip(F.slice("words", x["at"] + 1, F.col("n")).alias("a"), F.slice("own", x["at"] + x["shift"] + 1, F.col("n")).alias("b")))
    slots = F.array_distinct(F.filter(F.flatten(parts), lambda p: _is_slot(p["a"])))
    checked = aligned.withColumn("slots", slots).withColumn("same", F.forall("slots", lambda p: p["a"] == p["b"]))
    fits = one_to_one(F.filter("slots", lambda p: _counts(p["a"])))
    checked = checked.withColumn("exact", F.col("same") | F.col("itself").isNotNull()).where((fits | F.col("itself").isNotNull()) & (F.col("exact") | ~F.col("dense")))
    named = checked.withColumn("n_items", F.when(F.col("exact"), 1).otherwise(F.col("n_items"))).withColumn("item_id", F.coalesce("itself", "item_id"))
    best = F.max(F.struct("exact", "n_items", F.col("covered").alias("coverage"))).alias("best")
    return named.groupBy("doc_id", "row_key", "item_id").agg(best).select("doc_id", "row_key", "item_id", F.col("best.n_items").cast("bigint").alias("n_items"), "best.coverage", "best.exact").select(*out)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, t: Templates = Templates()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    own = free_name(docs, "row_key")
    found = Scratch(docs.sparkSession).keep(contamination(docs, benchmark, t).select(F.col("row_key").alias(own)).distinct(), "found")
    if found.count() <= t.max_broadcast_rows:
        found = F.broadcast(found)
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.join(found, key == found[own], "left_anti")
