"""Nodes, references and edges, and what can be asked of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions.parsing import CLAIM_FIELDS, RELATIONS, first_line, list_of, strip, wikilinks
from notegraph.functions.refs import candidate_keys, clean_ref, normalize_ref

#: References of one text that stay in one part.
SALT_ROWS = 100_000
#: Stands for a note's body among the keys of its fields; no key holds a line break.
BODY = "\n"
EDGE_KIND = {"wikilinks": "wikilink", "source_refs": "source_ref", **{r: r for r in RELATIONS}, "claim_refs": "claim_ref", "summary_claim_refs": "summary_claim_ref", "conflict_refs": "conflict_ref"}


def nodes(notes: DataFrame) -> DataFrame:
    """``(id, title, type, status, tags, aliases, confidence)`` of everything."""
    return notes.select(F.col("rel_path").alias("id"), "title", F.col("note_type").alias("type"), "status", "tags", F.when(F.col("is_raw"), F.array().cast("array<string>")).otherwise(F.col("aliases")).alias("aliases"), F.when(~F.col("is_raw"), F.col("confidence")).alias("confidence"))


def alias_map(node_table: DataFrame) -> DataFrame:
    """``(key, target, n_owners)``; an ambiguous key's target is null."""
    return owners(node_table.select("id", F.explode(candidate_keys(F.col("id"), F.col("title"), F.col("aliases"))).alias("key")))


def asked_aliases(node_table: DataFrame, refs: DataFrame) -> DataFrame:
    """``(key, target)`` of ``alias_map`` that ``resolve`` asks for of references ``(ref)``.

    Reading the nodes costs less than making the whole map, also where many keys are asked for.
    """
    asked = _forms(refs.where("ref <> ''").select("ref").distinct()).select("key").distinct()
    keys = node_table.select("id", F.explode(candidate_keys(F.col("id"), F.col("title"), F.col("aliases"))).alias("key"))
    ends = keys.join(asked, "key", "left_semi").groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    return ends.select("key", F.when(F.col("low") == F.col("high"), F.col("low")).alias("target"))


def owners(keys: DataFrame) -> DataFrame:
    """``(key, target, n_owners)`` of ``(id, key)``; one shuffle, by key, serves distinct ids and their counts."""
    ids = keys.repartition("key").groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.countDistinct("id").alias("n_owners"))
    return ids.select("key", F.when(F.col("low") == F.col("high"), F.col("low")).alias("target"), "n_owners")


def references(notes: DataFrame) -> DataFrame:
    """``(rel_path, field, pos, ref)`` of every reference of every note.

    The written fields and the body come as rows, so that only lists in
    which something stands are taken apart.
    """
    body = F.array(F.struct(F.lit(BODY).alias("key"), F.col("body").alias("value")))
    each = notes.where("not is_raw").select("rel_path", F.inline(F.concat(F.map_entries("fields"), body)))
    links, line = F.col("key") == BODY, first_line(F.col("value"))
    listed = F.col("key").isin(*[f for f in EDGE_KIND if f != "wikilinks"]) & ~strip(F.col("value")).isin("", "[]")
    full = each.where((links & F.col("value").contains("[[")) | listed)
    refs = F.when(links, wikilinks(F.col("value"))).otherwise(list_of(F.col("value"), line))
    return full.select("rel_path", F.when(links, "wikilinks").otherwise(F.col("key")).alias("field"), F.posexplode(refs).alias("pos", "ref"))


def _forms(texts: DataFrame) -> DataFrame:
    """What a reference text is tried as: three ids and a key."""
    texts = texts.withColumn("clean", clean_ref(F.col("ref")))
    return texts.withColumn("bare", F.when(F.col("clean").endswith(".md"), F.expr("left(clean, length(clean) - 3)"))).withColumn("key", normalize_ref(F.col("clean"))).withColumn("dot", F.when(F.col("clean").startswith("./"), F.expr("substring(clean, 3)")))


def tried(texts: DataFrame) -> DataFrame:
    """``(ref, tries)``: the ids and the key, ``(kind, value)``, by which ``resolve`` looks up ``(ref)``."""
    tries = F.array(*[F.struct(F.lit("key" if c == "key" else "id").alias("kind"), F.col(c).alias("value")) for c in ("clean", "bare", "dot", "key")])
    return _forms(texts).select("ref", F.filter(tries, lambda t: t["value"].isNotNull()).alias("tries"))


def resolve(refs: DataFrame, node_table: DataFrame, aliases: DataFrame) -> DataFrame:
    """``refs`` with ``target``: a node id, or null if missing or ambiguous.

    In order: the id itself, the id with ``.md``, the alias (final even if
    it is ambiguous), the id behind ``./``.  Distinct texts are resolved
    once, so a text that many notes hold is one row of the joins, and a form
    that it lacks is none; where the targets go back to the references, a
    text of more than ``SALT_ROWS`` is dealt by salt.
    """
    counted = refs.where("ref <> ''").groupBy("ref").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(c).alias("value")) for i, c in enumerate(("clean", "bare", "key", "dot"))])
    each = _forms(counted).select("ref", "salts", F.inline(tries)).where("value is not null")
    own = each.where("rank <> 2").join(node_table.select(F.col("id").alias("value"), F.col("id").alias("target")), "value")
    named = each.where("rank = 2").join(aliases.select(F.col("key").alias("value"), "target"), "value")
    found = own.unionByName(named).groupBy("ref", "salts").agg(F.min(F.struct("rank", "target")).alias("first")).select("ref", "salts", "first.target")
    if "rel_path" not in refs.columns:
        return refs.join(found.drop("salts"), "ref", "left").select(*refs.columns, "target")
    # at most one of SALT_ROWS references has a row in this table
    hot = F.broadcast(counted.where("salts > 1"))
    dealt = refs.join(hot, "ref", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("rel_path"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    salted = found.select("ref", "target", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return dealt.join(salted, ["ref", "salt"], "left").select(*refs.columns, "target")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``(source, target, kind)`` of resolved references."""
    kinds = F.create_map(*[F.lit(x) for kv in EDGE_KIND.items() for x in kv])
    return resolved.where("target is not null").select(F.col("rel_path").alias("source"), "target", kinds[F.col("field")].alias("kind")).distinct()


def degrees(edge_table: DataFrame) -> DataFrame:
    """``(path, out_degree, in_degree)`` of every node that has an edge."""
    ends = edge_table.select(F.explode(F.array(F.struct(F.col("source").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.path").agg(F.sum("e.o").cast("bigint").alias("out_degree"), F.sum("e.i").cast("bigint").alias("in_degree"))


def top_linked(edge_table: DataFrame, node_table: DataFrame, n: int = 10) -> DataFrame:
    """The knowledge notes with the most edges, ties by path."""
    known = node_table.where("type <> 'raw'").select(F.col("id").alias("path"))
    total = degrees(edge_table).join(known, "path", "left_semi").select("path", (F.col("out_degree") + F.col("in_degree")).alias("degree"))
    return total.orderBy(F.desc("degree"), "path").limit(n)


def orphans(notes: DataFrame, edge_table: DataFrame) -> DataFrame:
    """``(rel_path)`` of knowledge notes without any edge."""
    ends = edge_table.select(F.col("source").alias("rel_path")).union(edge_table.select("target"))
    return notes.where("not is_raw").select("rel_path").join(ends, "rel_path", "left_anti")


def standalone_claims(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(rel_path)`` of claims that no wiki's claim fields refer to."""
    wikis = notes.where("note_type = 'wiki'").select("rel_path")
    absorbed = resolved.where(F.col("field").isin("claim_refs", "summary_claim_refs") & F.col("target").isNotNull()).join(wikis, "rel_path", "left_semi").select(F.col("target").alias("rel_path"))
    return notes.where("note_type = 'claim'").select("rel_path").join(absorbed, "rel_path", "left_anti")


def typed(edge_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Edges ``(source, target, kind)`` with ``source_type`` and ``target_type``, null where a node lacks."""
    kinds = node_table.select("id", "type")
    return edge_table.select("source", "target", "kind").join(kinds.toDF("source", "source_type"), "source", "left").join(kinds.toDF("target", "target_type"), "target", "left")


class Ends:
    """Edges by either end as they stand, for a plan that asks once: nothing is sorted or written ahead.

    ``of`` joins the edges of the direction and the types that are asked of
    it; a short frontier is sent to the edges.  Unless the edges are
    ``typed``, what is found is written and its types are looked up.
    """

    def __init__(self, edge_table: DataFrame, node_table: DataFrame, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist):
        self.edges, self.keep = edge_table, keep
        self.kinds = None if "source_type" in edge_table.columns else node_table.select(F.col("id").alias("other"), F.col("type").alias("other_type"))

    def of(self, frontier: DataFrame) -> DataFrame:
        """``frontier`` (with ``node``) joined with the edges of its nodes."""

        def side(node: str, other: str, out: bool) -> DataFrame:
            own = self.edges.select(F.col(node).alias("node"), F.col(other).alias("other"), "kind", *([] if self.kinds is not None else [F.col(f"{other}_type").alias("other_type")]))
            return frontier.join(own, "node").withColumn("out", F.lit(out))

        found = side("source", "target", True).union(side("target", "source", False))
        if self.kinds is not None:
            found = self.keep(found)
            found = found.join(self.kinds.join(found.select("other").distinct(), "other", "left_semi"), "other", "left")
        return found.select(*frontier.columns, "other", "other_type", "kind", "out")


class Adjacency:
    """Edges by either end: ``(node, block, other, other_type, kind, out)``.

    A node of more than ``block_edges`` edges is a hub (``(node, blocks)`` in
    ``hubs``), whose edges are dealt by their other end.  Where ``keep`` can
    write bucketed tables, the edges are bucketed and sorted by node and
    block, so that a join with a frontier moves the frontier alone.
    """

    def __init__(self, edge_table: DataFrame, node_table: DataFrame, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist, block_edges: int = 100_000):
        self.keep = keep
        away = F.struct(F.col("source").alias("node"), F.col("target").alias("other"), F.col("target_type").alias("other_type"), "kind", F.lit(True).alias("out"))
        back = F.struct(F.col("target").alias("node"), F.col("source").alias("other"), F.col("source_type").alias("other_type"), "kind", F.lit(False).alias("out"))
        nodes = edge_table.select(F.explode(F.array("source", "target")).alias("node"))
        self.hubs = keep(nodes.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / block_edges).cast("int").alias("blocks")).where("blocks > 1"))
        ends = typed(edge_table, node_table).select(F.inline(F.array(away, back)))
        block = F.pmod(F.xxhash64("other"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block")
        dealt = ends.join(self.hubs, "node", "left").select("node", block, "other", "other_type", "kind", "out")
        self.ends = getattr(keep, "bucketed", lambda table, *by: keep(table))(dealt, "node", "block")

    def of(self, frontier: DataFrame) -> DataFrame:
        """``frontier`` (with ``node``) joined with the edges of its nodes."""
        blocks = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block")
        return frontier.join(self.hubs, "node", "left").select(*frontier.columns, blocks).join(self.ends, ["node", "block"]).drop("block")


def impact(near: Adjacency | Ends, seeds: DataFrame, node_table: DataFrame) -> DataFrame:
    """``(target, layer, path)``: what a change of the seeds ``(target)`` reaches.

    A source reaches the claims with an edge to it; claims reach the wikis
    with an edge into them, wikis the indexes with an edge to or from them.
    A claim, wiki or index starts with itself; raw nodes reach nothing.  Each
    layer asks for the edges of the layer before it, and is written, since
    the next one and the result read it.
    """
    asked = near.keep(seeds.select("target").distinct().join(node_table.select(F.col("id").alias("target"), "type"), "target"))
    node = F.col("other").alias("node")

    def own(kind: str) -> DataFrame:
        return asked.where(F.col("type") == kind).select("target", F.col("target").alias("node"))

    claims = near.keep(near.of(own("source")).where("not out and other_type = 'claim'").select("target", node).union(own("claim")).distinct())
    wikis = near.keep(near.of(claims).where("not out and other_type = 'wiki'").select("target", node).union(own("wiki")).distinct())
    indexes = near.of(wikis).where("other_type = 'index'").select("target", node).union(own("index")).distinct()
    layers = [t.select("target", F.lit(name).alias("layer"), F.col("node").alias("path")) for t, name in ((claims, "claims"), (wikis, "wikis"), (indexes, "indexes"))]
    return layers[0].union(layers[1]).union(layers[2])


def scope(seeds: DataFrame, near: Adjacency | Ends, node_table: DataFrame) -> DataFrame:
    """``(path)``: seed nodes ``(path)``, what they reach and stand on."""
    own = node_table.select(F.col("id").alias("node"), "type").join(seeds.select(F.col("path").alias("node")), "node", "left_semi")
    reached = impact(near, seeds.select(F.col("path").alias("target")), node_table).select("path")
    wanted = """out and type = 'wiki' and other_type in ('claim', 'index') or out and type = 'claim' and other_type in ('source', 'claim')
        or not out and type in ('claim', 'source') and other_type = 'claim'"""
    beside = near.of(own).where(wanted).select(F.col("other").alias("path"))
    return own.select(F.col("node").alias("path")).union(reached).union(beside).distinct()


def manifest(resolved: DataFrame) -> DataFrame:
    """``(path, field, target)`` of protected links, repeats kept."""
    protected = ("wikilinks", *RELATIONS, *CLAIM_FIELDS)
    return resolved.where(F.col("field").isin(*protected) & F.col("target").isNotNull()).select(F.col("rel_path").alias("path"), "field", "target")


def lost_links(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, field, lost)``: protected targets that are no longer there."""
    gone = before.select("path", "field", "target").distinct().join(now, ["path", "field", "target"], "left_anti")
    return gone.groupBy("path", "field").agg(F.array_join(F.array_sort(F.collect_list("target")), ", ").alias("lost"))


def impact_of(refs: DataFrame, near: Adjacency | Ends, node_table: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(ref, outcome, target, type, layer, path)`` of references ``(ref)``.

    A reference without a target has one row, ``unresolved``; one that
    reaches nothing has one row without layer and path.
    """
    asked = near.keep(resolve(refs.select("ref").distinct(), node_table, aliases).join(node_table.select(F.col("id").alias("target"), "type"), "target", "left"))
    reached = asked.join(impact(near, asked.where("target is not null"), node_table), "target", "left")
    return reached.select("ref", F.when(F.col("target").isNull(), "unresolved").otherwise("resolved").alias("outcome"), "target", "type", "layer", "path")


#: What to do, in order, when a source has changed.
SYNC_STEPS = ("source", "claims", "disputed claims", "wikis", "indexes")


def sync_steps(reached: DataFrame) -> DataFrame:
    """``(ref, step, what)``: the order of work for each changed source of ``impact_of``."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(w).alias("what")) for i, w in enumerate(SYNC_STEPS, 1)])
    return reached.where("type = 'source'").select("ref").distinct().select("ref", F.inline(steps))


def scope_report(listed: DataFrame | None, near: Adjacency | Ends | None, node_table: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(mode, part, path, title, type)`` of a checklist's references ``(ref)``.

    Without references all nodes are the scope (mode ``full``);
    with references that all lack a target the list is empty: its only row
    has the mode alone.  Without ``near`` a list's seeds are told alone.
    """
    titles = node_table.select(F.col("id").alias("path"), "title", "type")
    if listed is None or listed.isEmpty():
        return titles.select(F.lit("full").alias("mode"), F.lit("scope").alias("part"), "path", "title", "type")
    seeds = resolve(listed.select("ref"), node_table, aliases).where("target is not null").select(F.col("target").alias("path")).distinct()
    rows = seeds.withColumn("part", F.lit("seed"))
    if near is not None:
        seeds = near.keep(seeds)
        rows = seeds.withColumn("part", F.lit("seed")).unionByName(scope(seeds, near, node_table).withColumn("part", F.lit("scope")))
    head = listed.sparkSession.createDataFrame([("list", None, None)], "mode string, part string, path string")
    out = head.unionByName(rows.select(F.lit("list").alias("mode"), "part", "path"))
    return out.join(titles, "path", "left").select("mode", "part", "path", "title", "type")
