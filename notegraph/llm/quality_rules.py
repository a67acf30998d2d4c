"""Line-first document cleaning, in built-in column expressions only.

Each line is judged on its own (punctuation, navigation, ornament, shouting,
boilerplate).  Failing lines go; a document goes when the lines that went
held more than ``max_loss`` of its words, when it has too few words, or when
it repeats itself too much.  Every step is a narrow projection: no shuffle,
no Python, and the cost is linear in the text.

Defined results: null or empty text has no words and fails; a line without
words never fails; rows are independent, so ties, repeated rows and extra
columns of any name pass through unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.text import free_name, let, repeated_items, words

#: Phrases of page furniture rather than prose.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "sign up",
    "log in to",
    "share this",
    "read more",
    "licensed under",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document verdict."""

    min_words: int = 10
    window: int = 5
    max_repeat_pct: int = 20
    max_loss_pct: int = 50
    unpunctuated_words: int = 8
    boilerplate_words: int = 20


SYMBOLS = "[#*$%&|<>]"
MARKS = "[#*$%&|<>»›•!]"
LINE_BASE = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"


def _count(text: Column, chars: str) -> Column:
    """Occurrences of any of ``chars``; texts without one are only scanned."""
    return F.when(text.rlike(chars), F.regexp_count(text, F.lit(chars))).otherwise(0)


def line_fails(line: Column, rules: LineRules) -> Column:
    """True for a line that is not prose; false for a line without words.

    The tests stand in the order of their cost: most lines are settled by
    their first letters, and words are counted only for suspects.
    """
    n = F.size(F.array_remove(F.split(line, " "), ""))
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}") & (n >= 3)
    unpunctuated = ~line.rlike(r"[.!?…。！？]") & line.rlike(r"\S") & (n >= rules.unpunctuated_words)
    marked = line.rlike(MARKS) & ((_count(line, SYMBOLS) * 2 > n) | ((_count(line, r"[|»›•]") >= 3) & (_count(line, r"[|»›•]") * 5 > n)) | ((n >= 3) & (_count(line, "!") * 2 > n)))
    # long lines mostly have too many words: these are counted before they are searched
    short = (F.length(line) <= 16 * rules.boilerplate_words) | (n <= rules.boilerplate_words)
    furniture = short & line.rlike("(?i)" + "|".join(BOILERPLATE)) & (n <= rules.boilerplate_words)
    return shouting | unpunctuated | marked | furniture


def clean_text(text: Column, rules: LineRules) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~line_fails(x, rules)), "\n")


def base_counts(text: Column, rules: LineRules) -> Column:
    """The word, symbol and repetition counts of one text, as a struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _count(text, SYMBOLS).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeated_items(w, rules.window).cast("bigint").alias("n_repeat_words"),
        ).cast(LINE_BASE),
    )


def judge(text: Column, rules: LineRules = LineRules()) -> Column:
    """Struct of the counts, the cleaned text and both verdicts."""
    return let(
        F.struct(base_counts(text, rules).alias("base"), clean_text(text, rules).alias("clean")),
        lambda s: F.struct(
            s["base"].alias("base"),
            s["clean"].alias("clean"),
            F.size(words(s["clean"])).cast("bigint").alias("n_clean_words"),
            ((s["base"]["n_words"] < rules.min_words) | (100 * s["base"]["n_repeat_words"] > rules.max_repeat_pct * s["base"]["n_words"])).alias("base_failed"),
        ),
    )


def line_quality(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), name: str = "judged") -> DataFrame:
    """Add struct ``name``: counts, cleaned text and ``kept`` for every row.

    It comes out of a one-row generator, so that neither a filter on it nor
    the reading of its fields is pushed below and computes it again.
    """
    verdict = let(
        judge(F.col(text_col), rules),
        lambda j: F.struct(j["base"].alias("base"), j["clean"].alias("clean"), j["n_clean_words"].alias("n_clean_words"), j["base_failed"].alias("base_failed"), (~j["base_failed"] & (100 * (j["base"]["n_words"] - j["n_clean_words"]) <= rules.max_loss_pct * j["base"]["n_words"])).alias("kept")),
    )
    return docs.select("*", F.inline(F.array(F.struct(verdict.alias(name)))))


def keep_clean(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with their failing lines removed."""
    name = free_name(docs, "judged")
    out = line_quality(docs, text_col, rules, name).where(F.col(name)["kept"]).withColumn(text_col, F.col(name)["clean"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the ``op9`` query."""
    j = line_quality(docs.select("doc_id", "text"))
    return j.select("doc_id", "judged.base.*", "judged.base_failed", "judged.kept", "judged.n_clean_words")
