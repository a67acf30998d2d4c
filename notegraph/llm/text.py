"""Column expressions over text that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of the six ASCII blanks; everything else belongs to a word.
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst inlines a projected column that a lambda mentions once, and a
    lambda body runs per element; binding through a one-element array keeps
    the value outside.
    """
    return F.transform(F.array(value), body)[0]


def free_name(table: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``table`` has no such column."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """Maximal runs of non-blank characters; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def windows(items: Column, k: int) -> Column:
    """64-bit hashes of the ``k`` items from each position; none if fewer."""
    return let(
        F.transform(items, lambda x: F.xxhash64(x)),
        lambda h: F.when(F.size(h) < k, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        ),
    )


def covered(positions: Column, k: int) -> Column:
    """How many items the windows of length ``k`` at sorted positions cover."""
    gaps = F.zip_with(positions, F.slice(positions, F.lit(2), F.greatest(F.size(positions), F.lit(1))), lambda a, b: F.least(F.lit(k), F.coalesce(b - a, F.lit(k))))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x)


def repeated_items(items: Column, k: int) -> Column:
    """Items inside ``k``-item windows that occur at least twice in the row."""

    def twice(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: let(
                F.sort_array(
                    F.transform(
                        F.filter(
                            F.sequence(F.lit(0), F.size(s) - 1),
                            lambda j: ((j > 0) & (F.get(s, j - 1)["h"] == F.get(s, j)["h"])) | ((j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == F.get(s, j)["h"])),
                        ),
                        lambda j: F.get(s, j)["i"],
                    )
                ),
                lambda p: covered(p, k),
            ),
        )

    zero = F.lit(0).cast("bigint")
    return let(windows(items, k), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), zero).otherwise(twice(w)))


SPAN = "array<struct<start:int,end:int,hit:string>>"


def scan(values: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Running results of ``step`` over an int array, each including its own value.

    ``step`` is associative with 0 as its neutral value.  Results of blocks
    come first, so that no fold copies a long array.
    """

    def fold(xs: Column, first: Column) -> Column:
        empty = F.array().cast("array<int>")
        return F.aggregate(xs, F.struct(first.cast("int").alias("t"), empty.alias("o")), lambda a, x: let(step(a["t"], x), lambda t: F.struct(t.alias("t"), F.concat(a["o"], F.array(t)).alias("o"))), lambda a: a["o"])

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), step)

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil((F.size(v) - 1) / block).cast("int")), lambda b: F.slice(v, b * block + 1, block))

    return let(
        values,
        lambda v: F.when(F.size(v) <= block, fold(v, F.lit(0))).otherwise(
            let(blocks(v), lambda bs: let(fold(F.transform(bs, total), F.lit(0)), lambda ends: F.flatten(F.transform(bs, lambda b, i: fold(b, F.coalesce(F.get(ends, i - 1), F.lit(0)))))))
        ),
    )


def prefix_sums(values: Column) -> Column:
    """Running totals of an int array, each including its own value."""
    return scan(values, lambda a, x: a + x)


def clusters(items: Column) -> Column:
    """Groups of items (structs with ``start`` and ``end``, by start) that overlap.

    An item belongs to the group before it if it starts before an end in it.
    """

    def cut(xs: Column) -> Column:
        reach = scan(F.transform(xs, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
        heads = let(reach, lambda r: F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i)["start"] >= F.get(r, i - 1))))
        return let(heads, lambda h: F.transform(h, lambda at, j: F.slice(xs, at + 1, F.coalesce(F.get(h, j + 1), F.size(xs)) - at)))

    return let(items, lambda xs: F.when(F.size(xs) > 0, cut(xs)).otherwise(F.array(xs)))


def spans(text: Column, pattern: str, guard: str | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, end, hit), code points.

    The pieces between matches come from ``split`` and the matches from
    ``regexp_extract_all``; their lengths add up to the offsets.  Texts
    without ``guard`` (a cheaper necessary condition) are not scanned.
    """
    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, F.array().cast(SPAN)).otherwise(
            let(
                prefix_sums(F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))),
                lambda ends: F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit"))),
            )
        ),
    )
    return found if guard is None else F.when(text.rlike(guard), found).otherwise(F.array().cast(SPAN))


def joined_spans(items: Column) -> Column:
    """``kind:start:end`` of structs with these fields, comma-joined."""
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, items: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with sorted, disjoint spans replaced by their labels."""
    return let(
        items,
        lambda xs: F.when(F.size(xs) == 0, text).otherwise(
            F.concat(
                F.array_join(
                    F.transform(
                        xs,
                        lambda x, i: let(
                            F.coalesce(F.get(xs, i - 1)["end"], F.lit(0)),
                            lambda before: F.concat(F.substring(text, before + 1, x["start"] - before), label(x)),
                        ),
                    ),
                    "",
                ),
                F.substring(text, F.element_at(xs, -1)["end"] + 1, F.length(text)),
            )
        ),
    )
