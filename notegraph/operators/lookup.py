"""Ranked lookup: route, prune by cluster, score sections, relate.

A lookup reads an index, not the notes.  ``Index`` holds the normal forms and
the text of what can be hit (a unit), written once.  A batch of queries asks
each unit for its terms: which of them stand in the unit, and how.  Units of
which that is the same have the same score for every query, so of each such
group only as many lowest paths as the limit can be shown.  The scores are
then taken by group, and no pair of a query and a unit is made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions import parsing as P
from notegraph.functions import refs as R
from notegraph.functions import scoring as S
from notegraph.operators.graph import Adjacency, Ends

#: Sections of a claim that its lookup text holds, the section
#: that is no search unit, and the names of the whole-body units.
CLAIM_SECTIONS = ("当前证据如何支撑", "适用边界", "可能冲突或待验证")
SKIPPED, CALLOUT, BODY = "用户提问与复盘", "快速把握", "正文预览"
CONFLICTS = ("conflict_ref", "contradicts")
#: So many terms are looked for in each unit; of more, each where its first characters stand.
FEW_TERMS = 64
#: What a lookup tells of a unit.
UNIT = ("rel_path", "note_type", "section", "clusters")


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")


def _route_parts() -> list[Column]:
    field = lambda k: P.text_of(F.col("fields")[k])
    return [P.callout(F.col("body"), CALLOUT), P.section(F.col("body"), "摘要"), field("core_focus"), field("core_question"), field("page_intent"), field("statement"), P.preview(F.col("body"), 600), F.array_join("aliases", "\n"), F.array_join("tags", "\n")]


def units(notes: DataFrame) -> DataFrame:
    """``(rel_path, note_type, title, aliases, tags, section, text)``: what a lookup can hit."""
    field = lambda k: P.text_of(F.col("fields")[k])
    claim = _joined(*_route_parts(), field("support_state"), field("verification_state"), field("scope"), field("boundary_note"), *[P.section(F.col("body"), h) for h in CLAIM_SECTIONS])
    unit = "array<struct<section:string,text:string>>"
    own = F.array(F.struct(F.lit("claim").alias("section"), claim.alias("text"))).cast(unit)
    found = F.transform(P.sections(F.col("body")), lambda s: F.struct(s["heading"].alias("section"), s["content"].alias("text")))
    named = F.filter(found, lambda s: s["section"] != SKIPPED)
    call = F.array(F.struct(F.lit(CALLOUT).alias("section"), P.callout(F.col("body"), CALLOUT).alias("text")))
    whole = F.array(F.struct(F.lit(BODY).alias("section"), P.preview(F.col("body"), 900).alias("text")))
    heads = F.filter(F.concat(call, named), lambda s: s["text"] != "")
    # of sections with one heading the first counts
    first = P.let(heads, lambda hs: F.filter(hs, lambda s, i: ~F.exists(F.slice(hs, F.lit(1), i), lambda t: t["section"] == s["section"])))
    wiki = F.filter(F.concat(first, whole), lambda s: s["text"] != "").cast(unit)
    own = F.filter(own, lambda s: s["text"] != "")
    return notes.where("note_type in ('claim', 'wiki')").select("rel_path", "note_type", "title", "aliases", "tags", F.inline(F.when(F.col("note_type") == "claim", own).otherwise(wiki)))


def _grams(text: Column) -> Column:
    """Distinct runs of one to three characters of a text."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)])))


def _stacks() -> Column:
    return S.stacks(F.col("title"), F.col("rel_path"), F.col("aliases"), F.col("tags")).alias("stacks")


def _inside(path: Column) -> Column:
    """Whether a note lies in a folder of the cluster root."""
    return path.startswith("知识簇/")


class Part:
    """The table of routes or units ``(rel_path, note_type, section, clusters, stacks, low)``, numbered by ``unit``."""

    def __init__(self, units: DataFrame, keep: Callable[[DataFrame], DataFrame]):
        self.units = keep(units.select(F.monotonically_increasing_id().alias("unit"), "*"))
        self.keep = keep

    def found(self, terms: DataFrame) -> DataFrame:
        """Units with ``levels``: which of the terms ``(no, term)`` stand in them, and how, as ``(no, level)`` in order.

        Few terms are looked for in each unit.  Of more, a term is looked for
        where its first three characters stand, by a join on these.
        """
        # no term that stands in one of the strings is lost by joining them
        hay = F.concat_ws("\n", F.array_join("stacks", "\n"), "low")
        asked = F.col("term")
        if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
            every = terms.agg(F.array_sort(F.collect_list(F.struct("no", "term"))).alias("terms"))
            near = self.units.crossJoin(F.broadcast(every)).withColumn("near", P.let(hay, lambda h: F.filter("terms", lambda t: h.contains(t["term"]))))
            level = lambda t: F.struct(t["no"].alias("no"), S.level(t["term"], F.col("stacks"), F.col("low")).alias("level"))
            return near.select(*UNIT, F.filter(F.transform("near", level), lambda x: x["level"] > 0).alias("levels")).where("size(levels) > 0")
        first = terms.select("no", "term", F.substring("term", 1, 3).alias("gram"))
        near = self.units.select("*", hay.alias("hay")).select("*", F.explode(_grams(F.col("hay"))).alias("gram")).join(first, "gram").where(F.col("hay").contains(asked))
        each = near.select("unit", *UNIT, "no", S.level(asked, F.col("stacks"), F.col("low")).alias("level")).where("level > 0")
        return each.groupBy("unit", *UNIT).agg(F.array_sort(F.collect_list(F.struct("no", "level"))).alias("levels")).drop("unit")


class Index:
    """Routes, units and clusters of a vault, each made when it is first asked for.

    Tables are written or kept by ``keep``.
    """

    def __init__(self, notes: DataFrame, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist):
        self.notes, self.keep = notes, keep

    @cached_property
    def routes(self) -> Part:
        about = self.notes.where("note_type in ('index', 'wiki')")
        return Part(about.select("rel_path", "note_type", F.lit("").alias("section"), F.array().cast("array<string>").alias("clusters"), _stacks(), F.lower(_joined(*_route_parts())).alias("low")), self.keep)

    @cached_property
    def units(self) -> Part:
        own = F.array(F.get(F.split("rel_path", "/"), F.lit(1))).alias("clusters")
        # elsewhere a claim's clusters are what all notes of its path refer to
        away = self.clusters.where(~_inside(F.col("rel_path"))).groupBy("rel_path").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))
        rows = [units(self.notes.where(_inside(F.col("rel_path")))).select("*", own), units(self.notes.where(~_inside(F.col("rel_path")))).join(away, "rel_path", "left")]
        shown = ["rel_path", "note_type", "section", F.coalesce("clusters", F.array().cast("array<string>")).alias("clusters"), _stacks(), F.lower("text").alias("low")]
        return Part(rows[0].select(*shown).unionByName(rows[1].select(*shown)), self.keep)

    @property
    def clusters(self) -> DataFrame:
        return note_clusters(self.notes)

    def hits(self, queries: DataFrame, is_route: bool, limit: int) -> DataFrame:
        """``(query_id, rel_path, note_type, section, clusters, score)`` of routes or units, for each query of positive score.

        Of units that no query tells apart, those of the ``limit`` lowest
        paths: with their scores, all that is among the first ``limit`` notes
        of a query is here.
        """
        part = self.routes if is_route else self.units
        tokens = F.filter(S.tokens(F.col("query")), lambda t: F.length(t) >= 2)
        ready = queries.where("query_id is not null").select("query_id", R.normalize_ref(F.col("query")).alias("whole"), tokens.alias("tokens"))
        ready = self.keep(ready.select(F.monotonically_increasing_id().alias("asked"), "*"))
        term = lambda t, whole: F.struct(t.alias("term"), F.lit(whole).alias("whole"))
        terms = ready.select("asked", F.inline(F.concat(F.array(term(F.col("whole"), 1)), F.transform("tokens", lambda t: term(t, 0))))).where("term <> ''")
        terms = terms.groupBy("asked", "term").agg(F.sum("whole").alias("whole"), F.sum(1 - F.col("whole")).alias("n"))
        names = self.keep(terms.select("term").distinct().select(F.monotonically_increasing_id().alias("no"), "term"))
        alike = ["note_type", "section", "clusters", "levels"]
        place = F.dense_rank().over(Window.partitionBy(F.xxhash64(*alike), *alike).orderBy("rel_path"))
        lowest = part.found(names).withColumn("place", place).where(F.col("place") <= max(limit, 1))
        groups = lowest.groupBy(*alike).agg(F.collect_list("rel_path").alias("paths"))
        groups = self.keep(groups.select(F.monotonically_increasing_id().alias("g"), "*"))
        points = F.col("whole") * S.whole_points(F.col("level")) + F.col("n") * S.token_points(F.col("level"))
        scored = groups.select("g", F.inline("levels")).join(terms.join(names, "term").drop("term"), "no").groupBy("asked", "g").agg(F.sum(points).alias("score"))
        shown = scored.join(groups, "g").join(ready.select("asked", "query_id"), "asked")
        return shown.select("query_id", F.explode("paths").alias("rel_path"), "note_type", "section", "clusters", "score")


def _ranked(scored: DataFrame, limit: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= max(limit, 1)).withColumn("rank", F.col("rank").cast("bigint"))


def routes(index: Index, queries: DataFrame, limit: int = 5) -> DataFrame:
    """``(query_id, rel_path, score, rank)`` among indexes and wikis."""
    return _ranked(index.hits(queries, True, limit).select("query_id", "rel_path", "score"), limit, F.asc("rel_path"))


def clusters_of(routed: DataFrame) -> DataFrame:
    """``(query_id, cluster)`` of the routed notes under the cluster root."""
    p = F.split("rel_path", "/")
    return routed.where((p[0] == "知识簇") & (F.size(p) > 1)).select("query_id", F.get(p, F.lit(1)).alias("cluster")).distinct()


def note_clusters(notes: DataFrame) -> DataFrame:
    """``(rel_path, cluster)``: where a note is, or what a claim refers to."""
    own = F.split("rel_path", "/")
    refs = F.concat(*[F.col(f) for f in (*P.RELATIONS, *P.CLAIM_FIELDS)])
    named = F.filter(F.transform(refs, lambda r: F.when(r.startswith("知识簇/"), F.get(F.split(r, "/"), F.lit(1)))), lambda c: c.isNotNull())
    inside = (own[0] == "知识簇") & (F.size(own) > 1)
    found = F.when(inside, F.array(F.get(own, F.lit(1)))).when(F.col("note_type") == "claim", named).otherwise(F.array().cast("array<string>"))
    return notes.select("rel_path", F.explode(F.array_distinct(found)).alias("cluster"))


def knowledge(index: Index, queries: DataFrame, routed: DataFrame, limit: int = 5) -> DataFrame:
    """``(query_id, rel_path, note_type, section, score, rank)``.

    A note is scored by its best unit; queries whose routes name clusters
    look only inside these.
    """
    wanted = clusters_of(routed).groupBy("query_id").agg(F.collect_set("cluster").alias("wanted"))
    order = F.struct("score", (-S.section_priority(F.col("note_type"), F.col("section"))).alias("p"), "section")
    every = index.hits(queries, False, limit).join(wanted, "query_id", "left").where(F.col("wanted").isNull() | F.arrays_overlap("clusters", "wanted"))
    inside = every.groupBy("query_id", "rel_path", "note_type").agg(F.max(order).alias("b"))
    best = inside.select("query_id", "rel_path", "note_type", "b.section", "b.score")
    return _ranked(best, limit, F.asc("rel_path"), F.asc("section"))


def related(routed: DataFrame, found: DataFrame, near: Adjacency | Ends, limit: int = 5) -> DataFrame:
    """``(query_id, path, score, kinds, forced)``: neighbours of the matches.

    A note matched in both phases counts twice.  Conflicts of matched claims
    are always shown, beyond the limit.  What is asked of the edges is written
    first, so that its size is known and it is sent to them.
    """
    matched = routed.select("query_id", "rel_path", F.lit(False).alias("claim")).union(found.select("query_id", "rel_path", F.col("note_type") == "claim"))
    seen = near.keep(matched.groupBy("query_id", F.col("rel_path").alias("node")).agg(F.count(F.lit(1)).alias("times"), F.max("claim").alias("claim")))
    known = seen.select("query_id", F.col("node").alias("path"))
    shown = ~F.coalesce("other_type", F.lit("")).isin("raw", "source", "")
    disputed = F.col("kind").isin(*CONFLICTS)
    beside = near.keep(near.of(seen).where(shown).select("query_id", F.col("other").alias("path"), "kind", "times", "claim"))
    touching = beside.where(~disputed).join(known, ["query_id", "path"], "left_anti")
    plain = touching.groupBy("query_id", "path").agg(F.sum(S.edge_weight(F.col("kind")) * F.col("times")).alias("score"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    top = near.keep(_ranked(plain, limit, F.asc("path")).select("query_id", "path", "score", "kinds", F.lit(False).alias("forced")))
    forced = beside.where(F.col("claim") & disputed).groupBy("query_id", "path").agg(F.sum(S.edge_weight(F.col("kind"))).alias("score"))
    extra = near.keep(forced.join(known, ["query_id", "path"], "left_anti").join(top, ["query_id", "path"], "left_anti"))
    # of a forced note, the kinds of all its conflicts are told
    every = near.of(extra.select(F.col("path").alias("node")).distinct()).where(disputed).groupBy(F.col("node").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return top.unionByName(extra.join(every, "path").select("query_id", "path", "score", "kinds", F.lit(True).alias("forced")))


def matches(index: Index, queries: DataFrame, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """``routes`` and ``knowledge``: a few rows a query, which every later phase reads."""
    routed = index.keep(routes(index, queries, limit))
    return routed, index.keep(knowledge(index, queries, routed, limit))


def _matched(routed: DataFrame, found: DataFrame) -> DataFrame:
    none = F.lit("")
    return routed.select("query_id", F.lit("route").alias("part"), "rank", F.col("rel_path").alias("path"), none.alias("section"), "score", none.alias("kinds")).unionByName(
        found.select("query_id", F.lit("knowledge").alias("part"), "rank", F.col("rel_path").alias("path"), "section", "score", none.alias("kinds"))
    )


def lookup(index: Index, near: Adjacency | Ends, queries: DataFrame, limit: int = 5) -> DataFrame:
    """``(query_id, part, rank, path, section, score, kinds)``, all phases."""
    routed, found = matches(index, queries, limit)
    beside = related(routed, found, near, limit)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("forced", F.when(F.col("forced"), 0).otherwise(-F.col("score")), "path")).cast("bigint")
    shown = beside.select("query_id", F.lit("related").alias("part"), order.alias("rank"), "path", F.lit("").alias("section"), F.col("score").cast("double").alias("score"), "kinds")
    return _matched(routed, found).unionByName(shown)


def first_matches(index: Index, queries: DataFrame, limit: int = 5) -> DataFrame:
    """The rows of ``lookup`` that ``next_steps`` reads: no neighbours, so no edges."""
    return _matched(*matches(index, queries, limit))


def next_steps(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``(query_id, outcome, start)``: where to go on from the rows of ``lookup``.

    ``outcome`` is ``knowledge`` (start from the best match and its claims and
    sources), ``route`` (from the best route, then into its cluster) or ``no
    matches``, which has no start.
    """
    first = rows.where("rank = 1 and part <> 'related'").groupBy("query_id").agg(F.min(F.struct("part", "path")).alias("f"))
    asked = queries.select("query_id").join(first, "query_id", "left")
    return asked.select("query_id", F.coalesce("f.part", F.lit("no matches")).alias("outcome"), F.col("f.path").alias("start"))
