"""A vault's tables after a change set, without building them anew.

Only changed files are parsed.  A reference of an unchanged note is resolved
again only if its answer can differ: if one of the ids that it tries came or
went, or if the owners of its key changed.  Everything else is carried over.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions.refs import candidate_keys
from notegraph.operators import graph
from notegraph.sources.notes import parse


def _keys(node_table: DataFrame) -> DataFrame:
    return node_table.select("id", F.explode(candidate_keys(F.col("id"), F.col("title"), F.col("aliases"))).alias("key"))


def _differing(before: DataFrame, now: DataFrame) -> DataFrame:
    """Distinct rows that stand in one table alone."""
    both = before.withColumn("side", F.lit(1)).unionByName(now.withColumn("side", F.lit(2)))
    return both.groupBy(*before.columns).agg(F.count_distinct("side").alias("n")).where("n = 1").drop("n")


def _only(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return table.join(keys, column, "left_semi")


def _without(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return table.join(keys, column, "left_anti")


class Update:
    """``notes``, ``nodes``, ``aliases``, ``refs`` and ``edges`` of the vault ``old`` after ``changes``.

    ``changes`` are ``(path, change)`` as ``status.changes`` gives them,
    ``texts`` ``(rel_path, text)`` of at least the added and modified files.
    A path that is named but has no text counts as removed.  Both are read
    at once, each table is made when it is first asked for.
    """

    def __init__(self, old, changes: DataFrame, texts: DataFrame, keep):
        self.old, self.keep = old, keep
        self.paths = keep(changes.select("path").distinct())
        self.by_note, self.by_id = (self.paths.withColumnRenamed("path", c) for c in ("rel_path", "id"))
        self.fresh = keep(parse(_only(texts.select("rel_path", "text"), self.by_note, "rel_path")))

    @cached_property
    def notes(self) -> DataFrame:
        return self.keep(_without(self.old.notes, self.by_note, "rel_path").unionByName(self.fresh))

    @cached_property
    def _was(self) -> DataFrame:
        return self.keep(_only(self.old.nodes, self.by_id, "id"))

    @cached_property
    def nodes(self) -> DataFrame:
        return _without(self.old.nodes, self.by_id, "id").unionByName(graph.nodes(self.fresh))

    @cached_property
    def _differing_keys(self) -> DataFrame:
        return self.keep(_differing(_keys(self._was), _keys(graph.nodes(self.fresh))).select("key").distinct())

    @cached_property
    def aliases(self) -> DataFrame:
        owned = _keys(self.nodes).join(self._differing_keys, "key", "left_semi").select("id", "key")
        return self.keep(_without(self.old.aliases, self._differing_keys, "key").unionByName(graph.owners(owned)))

    @cached_property
    def _resolved(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Old references of notes that stay, the texts to ask for again, and the answers."""
        ids = self.keep(_differing(self._was.select("id"), graph.nodes(self.fresh).select("id")))
        left = _without(self.old.refs, self.by_note, "rel_path")
        asked = graph.tried(left.select("ref").distinct())
        differing = ids.select(F.lit("id").alias("kind"), F.col("id").alias("value")).union(self._differing_keys.select(F.lit("key"), "key"))
        touched = asked.select("ref", F.inline("tries")).join(differing, ["kind", "value"], "left_semi")
        again = self.keep(touched.select("ref").distinct())
        open_refs = self.keep(_only(left, again, "ref").drop("target").unionByName(graph.references(self.fresh)))
        # few references ask for few of the nodes and keys, so no alias table is brought up to date
        wanted = graph.tried(open_refs.select("ref").distinct()).select(F.inline("tries")).where("kind = 'id'")
        near_nodes = _only(self.nodes, wanted.select(F.col("value").alias("id")).distinct(), "id")
        return left, again, self.keep(graph.resolve(open_refs, near_nodes, graph.asked_aliases(self.nodes, open_refs)))

    @cached_property
    def refs(self) -> DataFrame:
        left, again, resolved = self._resolved
        return self.keep(_without(left, again, "ref").unionByName(resolved.select(*left.columns)))

    @cached_property
    def edges(self) -> DataFrame:
        resolved = self._resolved[2]
        sources = self.keep(resolved.select(F.col("rel_path").alias("source")).union(self.paths).distinct())
        renewed = graph.edges(_only(self.refs, sources.withColumnRenamed("source", "rel_path"), "rel_path"))
        return self.keep(_without(self.old.edges, sources, "source").unionByName(renewed))
