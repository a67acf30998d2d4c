"""References between notes: normal forms and the keys a node answers to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegraph.functions.parsing import stem, strip


def normalize_ref(value: Column) -> Column:
    """Lower-cased, without outer slashes, back slashes and ``.md``."""
    bare = F.btrim(strip(value), F.lit("/"))
    return F.lower(F.regexp_replace(F.replace(bare, F.lit("\\"), F.lit("/")), r"(?i)\.md\z", ""))


def clean_ref(value: Column) -> Column:
    """A reference without its label and heading."""
    return strip(F.split_part(F.split_part(value, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)))


def candidate_keys(path: Column, title: Column, aliases: Column) -> Column:
    """The distinct keys by which a node can be referred to."""
    bare = F.regexp_replace(path, r"\.[^.]*\z", "")
    short = F.regexp_replace(bare, r"^[^/]*/", "")
    keys = F.concat(F.array(stem(path), bare, short, title), aliases)
    return F.array_distinct(F.filter(F.transform(keys, normalize_ref), lambda k: k != ""))


def dedupe(values: Column) -> Column:
    """First occurrences in order, blanks dropped."""
    return F.array_distinct(F.filter(values, lambda x: x != ""))
