"""Markdown notes as column expressions: front matter, sections, links.

Everything is a built-in expression over one text column, so a scan of notes
stays one narrow projection without Python workers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A typed front-matter value: how it was written, its text, its list items.
VALUE = "struct<kind:string,scalar:string,items:array<string>>"
#: Relation fields and claim reference fields of a note.
RELATIONS = ("see_also", "part_of", "depends_on", "supports", "contradicts")
CLAIM_FIELDS = ("claim_refs", "summary_claim_refs", "conflict_refs")
#: The fields that can name a note, best first.
TITLES = ("title", "statement", "core_focus", "core_question", "question")
#: The characters that ``(?U)\\s`` stands for.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """``text`` without Unicode white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    """The lines of ``text``; a final line break ends the last line."""
    return F.split(F.regexp_replace(text, r"(?:\r?\n|\r)\z", ""), r"\r?\n|\r")


def universal_newlines(text: Column) -> Column:
    """``text`` with ``\\n`` for every line break."""
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def front_matter(text: Column) -> Column:
    """(head, body): the block between ``---`` lines and what follows."""
    parts = F.split(text, "\n---\n", 2)
    fenced = text.startswith("---\n") & (F.size(parts) == 2)
    return F.struct(
        F.when(fenced, F.substring(parts[0], 5, F.length(text))).otherwise("").alias("head"),
        F.when(fenced, F.get(parts, F.lit(1))).otherwise(text).alias("body"),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row or element."""
    return F.transform(F.array(value), body)[0]


def _quoted(v: Column) -> Column:
    return (v.startswith('"') | v.startswith("'")) & v.rlike(r"""^(?s)(?:".*"|'.*'|"|')$""")


def _bool(v: Column) -> Column:
    return (F.length(v) <= 5) & F.lower(v).isin("true", "false")


def _text(v: Column) -> Column:
    """The text of one unquoted or quoted value."""
    inner = F.substring(v, F.lit(2), F.greatest(F.length(v) - 2, F.lit(0)))
    return F.when(_quoted(v), inner).when(_bool(v), F.initcap(F.lower(v))).otherwise(v)


def _kind(v: Column) -> Column:
    number = F.when(v.rlike(r"^-?[0-9]+$"), "int").when(v.rlike(r"^-?[0-9]+\.[0-9]+$"), "float").otherwise("str")
    return F.when(_quoted(v), "str").when(_bool(v), "bool").when(F.substring(v, 1, 1).between("-", "9"), number).otherwise("str")


def _value(r: Column) -> Column:
    """A typed value from the text behind a key."""
    none = F.lit(None)
    listed = F.struct(F.lit("list").alias("kind"), none.cast("string").alias("scalar"), _bracket_items(r).alias("items"))
    single = F.struct(_kind(r).alias("kind"), _text(r).alias("scalar"), none.cast("array<string>").alias("items"))
    return F.when(_bracketed(r), listed).otherwise(single)


#: A key with the line break before it; the dash lines right below a key behind which nothing stands.
KEY = r"\n([A-Za-z0-9_-]+):"
DASHES = r"(?Umd)\A[^\S\n]*((?:\n[^\S\n]*-[^\S\n]+\S.*)*)"


def written_fields(head: Column) -> Column:
    """Keys to what is written from behind them to the next key; a later entry of a key replaces an earlier one.

    Blank and comment lines are left out.  A value is only taken apart where
    a field is asked for (``text_of``, ``list_of``, ``double_of``).  Only a
    head that repeats a key goes through a lambda, which is not compiled.
    """
    block = key_block(head)
    return fields_of(*keys_and_values(block))


def key_block(head: Column) -> Column:
    """A head without blank and comment lines, behind a line break."""
    return F.concat(F.lit("\n"), F.regexp_replace(universal_newlines(head), r"(?Umd)^[^\S\n]*(?:#.*)?(?:\n|\z)", ""))


def keys_and_values(block: Column) -> tuple[Column, Column]:
    """The keys of a ``key_block``; what stands before the first key, and each key's value."""
    return F.regexp_extract_all(block, F.lit(KEY), F.lit(1)), F.split(block, KEY)


def fields_of(keys: Column, parts: Column) -> Column:
    """The map of ``written_fields`` from ``keys_and_values``."""
    values = F.slice(parts, F.lit(2), F.size(parts))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["k"]))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(F.map_from_entries(last))


def first_line(written: Column) -> Column:
    """What stands in a key's own line."""
    return strip(F.substring_index(written, "\n", 1))


def _bracketed(line: Column) -> Column:
    return line.startswith("[") & line.endswith("]")


def _dash_items(written: Column) -> Column:
    below = F.filter(F.split(F.regexp_extract(written, DASHES, 1), "\n"), lambda x: strip(x) != "")
    return F.transform(F.transform(below, lambda x: strip(F.substring(x, F.instr(x, "-") + 1, F.length(x)))), _text)


def _bracket_items(line: Column) -> Column:
    inner = strip(F.substring(line, F.lit(2), F.greatest(F.length(line) - 2, F.lit(0))))
    return let(inner, lambda i: F.when(i == "", F.array().cast("array<string>")).otherwise(F.transform(F.transform(F.split(i, ","), strip), _text)))


def _shown(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def text_of(written: Column, line: Column | None = None) -> Column:
    """A written value as text, as ``as_text`` gives it; ``line`` is its ``first_line``."""
    line = first_line(written) if line is None else line
    listed = F.when(line == "", _dash_items(written)).otherwise(_bracket_items(line))
    return F.when(written.isNull(), "").when((line == "") | _bracketed(line), _shown(listed)).otherwise(strip(_text(line)))


def list_of(written: Column, line: Column) -> Column:
    """A written value as list items, as ``as_list`` gives them."""
    one = F.when(_kind(line) == "str", F.split(_text(line), ",")).otherwise(F.array(_text(line)))
    full = F.when(line == "", _dash_items(written)).when(_bracketed(line), _bracket_items(line)).otherwise(one)
    return F.when(written.isNull() | (line == "[]"), F.array().cast("array<string>")).otherwise(F.filter(F.transform(full, strip), lambda x: x != ""))


def double_of(written: Column, line: Column) -> Column:
    """A written value as a number, or null, as ``as_double`` gives it."""
    return F.when(written.isNotNull() & (line != "") & ~_bracketed(line), as_double(F.struct(_kind(line).alias("kind"), _text(line).alias("scalar"))))


def front_matter_fields(head: Column) -> Column:
    """Keys to typed values; a later entry of a key replaces an earlier one.

    A bare key opens a list and the dash lines right below it are its items;
    blank and comment lines change nothing, any other line closes the list.
    """

    def typed(written: Column) -> Column:
        listed = F.struct(F.lit("list").alias("kind"), F.lit(None).cast("string").alias("scalar"), _dash_items(written).alias("items")).cast(VALUE)
        return let(first_line(written), lambda r: F.when(r == "", listed).otherwise(_value(r).cast(VALUE)))

    return F.transform_values(written_fields(head), lambda _, w: typed(w))


def as_text(value: Column) -> Column:
    """A typed value as text: '' if missing, a list in its bracketed form."""
    return F.when(value.isNull(), "").when(value["kind"] == "list", _shown(value["items"])).otherwise(strip(value["scalar"]))


def as_list(value: Column) -> Column:
    """A typed value as list items; text is cut at commas, blanks dropped."""
    full = F.when(value.isNull(), F.array().cast("array<string>")).when(value["kind"] == "list", value["items"]).when(value["kind"] == "str", F.split(value["scalar"], ",")).otherwise(F.array(value["scalar"]))
    return F.filter(F.transform(full, strip), lambda x: x != "")


def as_double(value: Column) -> Column:
    """A typed value as a number, or null."""
    text = F.when(value["kind"] == "bool", F.when(value["scalar"] == "True", "1").otherwise("0")).when(value["kind"] != "list", strip(value["scalar"]))
    return F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def wikilinks(body: Column) -> Column:
    """Targets of ``[[target#heading|label]]`` in order, repeats kept."""
    found = F.when(body.contains("[["), F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).otherwise(F.when(body.isNotNull(), F.array().cast("array<string>")))
    return F.filter(F.transform(found, lambda x: strip(F.split_part(F.split_part(x, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)))), lambda x: x != "")


def sections(body: Column) -> Column:
    """(heading, content) of each ``##`` section that has content."""
    rows = F.split(F.concat(F.lit("\n"), universal_newlines(body)), r"\n(?=[\x20\t]*##[\x20\t])")
    cut = F.transform(
        F.filter(rows, lambda r: r.rlike(r"^[\x20\t]*##[\x20\t]")),
        lambda r: F.struct(strip(F.regexp_extract(r, r"^[\x20\t]*##[\x20\t]([^\n]*)", 1)).alias("heading"), strip(F.regexp_replace(r, r"^[^\n]*\n?", "")).alias("content")),
    )
    return F.filter(cut, lambda s: s["content"] != "")


def section(body: Column, heading: str) -> Column:
    """Content of the first section with the heading, '' if there is none."""
    rows = F.split(F.concat(F.lit("\n"), universal_newlines(body)), r"\n(?=[\x20\t]*##[\x20\t])")
    own = F.filter(rows, lambda r: strip(F.regexp_extract(r, r"^[\x20\t]*(##[\x20\t][^\n]*)", 1)) == f"## {heading}")
    found = F.coalesce(strip(F.regexp_replace(F.get(own, F.lit(0)), r"^[^\n]*\n?", "")), F.lit(""))
    return F.when(body.contains(f"## {heading}"), found).otherwise("")


def callout(body: Column, title: str) -> Column:
    """Text of the quoted block under ``> [!…] title``."""

    def step(acc: Column, line: Column) -> Column:
        s = strip(line)

        def state(mode: Column, out: Column) -> Column:
            return F.struct(mode.alias("mode"), out.alias("out"))

        head = s.startswith("> [!") & s.contains(title)
        return (
            F.when(acc["mode"] == 2, acc)
            .when(head, state(F.lit(1), acc["out"]))
            .when(acc["mode"] == 0, acc)
            .when(s.startswith(">"), state(F.lit(1), F.concat(acc["out"], F.array(strip(F.substring(s, F.lit(2), F.length(s)))))))
            .when(s != "", state(F.lit(2), acc["out"]))
            .otherwise(acc)
        )

    start = F.struct(F.lit(0).alias("mode"), F.array().cast("array<string>").alias("out"))
    found = F.aggregate(lines(body), start, step, lambda a: a["out"])
    return F.when(~body.contains("> [!"), "").otherwise(strip(F.array_join(F.filter(found, lambda x: x != ""), "\n")))


def preview(body: Column, limit: int = 1200) -> Column:
    """The first code points of a body with white space collapsed."""
    bare = F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n", "")
    return F.substring(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), 1, limit)


def stem(path: Column) -> Column:
    """A path's last part without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def title_of(path: Column, texts: dict[str, Column], body: Column) -> Column:
    """The first filled title field, else the first ``#`` line, else the stem."""
    named = [F.nullif(texts[k], F.lit("")) for k in TITLES]
    heading = strip(F.regexp_extract(body, r"(?m)^#\x20(.*)$", 1))
    return F.coalesce(*named, F.nullif(heading, F.lit("")), stem(path))


def source_type(path: Column) -> Column:
    """Where a file belongs, by its first path parts."""
    p = F.split(path, "/")
    second = F.coalesce(F.get(p, F.lit(1)), F.lit(""))
    return F.when(p[0] == "raw", "raw").when((p[0] == "知识簇") & (F.size(p) > 1), second).when((p[0] == "_graphify") & (F.size(p) > 1), F.regexp_replace(second, "s+$", "")).otherwise(p[0])


def kind_of(path: Column) -> Column:
    """The note kind that a path implies."""
    p = F.split(path, "/")
    cluster, claim = p[0] == "知识簇", F.array_contains(p, "命题") | F.array_contains(p, "_claims")
    in_graph = (p[0] == "_graphify") & (F.size(p) > 1)
    return (
        F.when(cluster & (F.element_at(p, -1) == "_索引.md"), "index")
        .when(claim, "claim")
        .when(cluster, "wiki")
        .when(in_graph & (F.get(p, F.lit(1)) == "sources"), "source")
        .when(in_graph & (F.get(p, F.lit(1)) == "indexes"), "index")
        .otherwise("unknown")
    )


def is_due(value: Column, as_of: str) -> Column:
    """Whether a date text is a date not after ``as_of``; a text without a digit is none, which costs less to see than a parser's error."""
    return F.coalesce(F.when(value.rlike(r"\p{Nd}"), F.try_to_date(value, "yyyy-M-d") <= F.lit(as_of).cast("date")), F.lit(False))
