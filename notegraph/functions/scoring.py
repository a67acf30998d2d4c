"""Lookup scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegraph.functions.refs import normalize_ref

#: Words that a query's tokens leave out.
STOPWORDS = ("a", "an", "and", "for", "from", "have", "in", "into", "is", "of", "on", "or", "that", "the", "this", "to", "what", "when", "where", "which", "with")
#: Order of sections among equal scores.
SECTION_PRIORITY = {"快速把握": 0, "主线解释": 1, "先把这三个东西分开": 2, "为什么这条边界决定你会不会走错路": 3, "检索到底是怎么发生的": 4, "Chunking 为什么会直接决定上限": 5, "什么时候该用 RAG，什么时候不该": 6, "最容易混淆的几个地方": 7, "它和哪些知识要一起看": 8, "当前证据如何支撑": 9, "适用边界": 10, "证据来源": 20, "正文预览": 30}
#: Weights of edge kinds; every other kind weighs 1.
EDGE_WEIGHTS = {"supports": 4, "depends_on": 4, "contradicts": 4, "part_of": 4, "summary_claim_ref": 4, "conflict_ref": 4, "claim_ref": 3, "see_also": 3, "wikilink": 2, "source_ref": 2}


#: Characters at which a query's tokens end.
SEPARATOR = r"[\s/,_\-]"


def tokens(query: Column) -> Column:
    """Lower-cased tokens of a query without stop words, repeats kept."""
    return F.filter(F.split(F.lower(query), f"(?U){SEPARATOR}+"), lambda t: (t != "") & ~t.isin(*STOPWORDS))


def stacks(title: Column, path: Column, aliases: Column, tags: Column) -> Column:
    """The normal forms of a note in which a query is searched for."""
    return F.transform(F.concat(F.array(title, path), aliases, tags), normalize_ref)


def level(term: Column, hay: Column, low: Column) -> Column:
    """How a term stands in stacks and lower-cased text: 3 is one of the stacks, 2 stands in one, 1 in the text, 0 nowhere."""
    return F.when(F.exists(hay, lambda h: h == term), 3).when(F.exists(hay, lambda h: h.contains(term)), 2).when(low.contains(term), 1).otherwise(0)


def _by_level(of: Column, equal: float, inside: float, text: float) -> Column:
    return F.when(of == 3, equal).when(of == 2, inside).when(of == 1, text).otherwise(0.0)


def whole_points(of: Column) -> Column:
    """What a query's normal form scores by its level."""
    return _by_level(of, 100.0, 45.0, 15.0)


def token_points(of: Column) -> Column:
    """What each of a query's tokens scores by its level."""
    return _by_level(of, 20.0, 10.0, 3.0)


def points(whole: Column, words: Column, hay: Column, low: Column) -> Column:
    """Score of a query's normal form and tokens against stacks and lower-cased text."""
    each = F.aggregate(words, F.lit(0.0), lambda a, t: a + token_points(level(t, hay, low)))
    return F.when(whole == "", 0.0).otherwise(whole_points(level(whole, hay, low))) + each


def match_score(query: Column, title: Column, path: Column, aliases: Column, tags: Column, body: Column) -> Column:
    """How well a note answers a query: whole query first, then tokens."""
    return points(normalize_ref(query), F.filter(tokens(query), lambda t: F.length(t) >= 2), stacks(title, path, aliases, tags), F.lower(body))


def section_priority(note_type: Column, name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SECTION_PRIORITY.items() for x in kv])
    return F.when(note_type == "claim", 0).otherwise(F.coalesce(table[name], F.lit(15)))


def edge_weight(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv])
    return F.coalesce(table[kind], F.lit(1)).cast("bigint")
