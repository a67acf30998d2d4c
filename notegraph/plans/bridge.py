"""The star-schema tables as a knowledge graph of Markdown notes.

Regions and nations are indexes, customers wikis, orders claims, suppliers
sources and parts raw items.  The notes are rendered as text and parsed
again, so that a query over them exercises the whole path from text to
graph.  Every list of a note is as long as one customer's orders or one
order's suppliers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.operators import graph, incremental, status
from notegraph.operators.lookup import Index
from notegraph.plans.tables import Keeper, state_of
from notegraph.sources.notes import heads, typed

CLAIM_FILLER = "claim_type: fact\nsupport_state: supported\nverification_state: source_supported\nscope: all\nboundary_note: none\nclaim_origin: data\n"
COMMON_FILLER = "aliases: []\nupdated_at: 2024-01-01\nsee_also: []\ndepends_on: []\nsupports: []\n"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _render(*parts) -> Column:
    return F.concat(*[_text(p) if isinstance(p, (Column, str)) else p for p in parts])


def _items(key: str, names: Column) -> Column:
    """A front-matter list in block form."""
    return F.concat(F.lit(f"{key}:\n"), F.array_join(F.transform(names, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), ""))


def _when(cond: Column, text: Column | str) -> Column:
    return F.when(cond, _text(text)).otherwise("")


def _str(c: str) -> Column:
    return F.col(c).cast("string")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(n_nationkey, n_name, r_name)``."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(rel_path, text)`` of every note."""
    region = _read(spark, sf_dir, "region").select(
        F.format_string("知识簇/%s/_索引.md", "r_name").alias("rel_path"),
        _render("---\ntype: index\nstatus: reviewed\ntitle: ", F.col("r_name"), "\nconfidence: 1\n---\n# region\n").alias("text"),
    )
    where = places(spark, sf_dir)
    nation = where.select(
        F.format_string("知识簇/%s/%s/_索引.md", "r_name", "n_name").alias("rel_path"),
        _render("---\ntype: index\nstatus: reviewed\ntitle: \"", F.col("n_name"), "\"\nconfidence: 1.0\npart_of: [知识簇/", F.col("r_name"), "/_索引]\n---\n# nation\n").alias("text"),
    )
    where = F.broadcast(where)
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    own = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("os"))
    c = F.col("c_custkey")
    stems = F.transform(F.filter(F.coalesce("os", F.array().cast("array<bigint>")), lambda o: o % 2 == 0), lambda o: F.concat(F.lit("o"), o.cast("string")))
    fives = F.transform(F.filter(F.coalesce("os", F.array().cast("array<bigint>")), lambda o: o % 5 == 0), lambda o: F.concat(F.lit("o"), o.cast("string")))
    customers = _read(spark, sf_dir, "customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).join(own, "c_custkey", "left")
    wiki = customers.select(
        F.format_string("知识簇/%s/c%d.md", "r_name", "c_custkey").alias("rel_path"),
        _render(
            "---\n# a customer\ntype: wiki\ntitle: customer page ", _str("c_custkey"), "\nstatus: ",
            F.element_at(F.array(*map(F.lit, ("draft", "reviewed", "verified", "stale", "odd"))), (c % 5 + 1).cast("int")),
            "\ntags: [", F.lower("c_mktsegment"), ", customer]\n", COMMON_FILLER, "contradicts: []\nsource_refs: []\nconfidence: ", (c % 12 / 10).cast("decimal(3,1)").cast("string"),
            "\nreview_after: 2024-1-", (c % 28 + 1).cast("string"), "\npart_of:\n- ", F.col("n_name"), "\n", _when(c % 6 != 0, "core_focus: customers\n"), "draft_state: open\nversion_no: 1\nimportance: low\n",
            _items("claim_refs", stems), "summary_claim_refs: [", F.array_join(fives, ", "), "]\n---\n# page\n\nIn [[知识簇/", F.col("r_name"), "/_索引|", F.col("r_name"), "]]", _when(c % 7 == 0, F.concat(F.lit(" and [[gone "), _str("c_custkey"), F.lit("#x]]"))),
            "\n\n## 主线解释\nCustomer in ", F.col("n_name"), " buys.\n",
        ).alias("text"),
    )
    o = F.col("o_orderkey")
    sold = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct().groupBy("o_orderkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("ss"))
    region_of = _read(spark, sf_dir, "customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    paths = F.transform(F.coalesce("ss", F.array().cast("array<bigint>")), lambda s: F.concat(F.lit("_graphify/sources/s"), s.cast("string"), F.lit(".md")))
    claim = orders.join(region_of, "o_custkey").join(sold, "o_orderkey", "left").select(
        F.format_string("知识簇/%s/命题/o%d.md", "r_name", "o_orderkey").alias("rel_path"),
        _render(
            "---\ntype: claim\ntitle: order claim ", _str("o_orderkey"), "\nstatement: it was ordered\nstatus: ", F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "draft").otherwise("archived"),
            "\nclaim_status: ", F.when(o % 10 == 0, "outdated").when(o % 10 == 1, "disputed").when(o % 10 == 2, "gone").otherwise("active"), "\n", CLAIM_FILLER, COMMON_FILLER, "tags: [order]\nconfidence: 0.5\nreview_after: none\npart_of: []\n",
            _when(o % 3 == 0, "graph_role: standalone_claim\n"), _items("source_refs", paths),
            "conflict_refs: [", F.when(o % 8 == 1, F.concat(F.lit("o"), (o + 1).cast("string"))).when(o % 16 == 2, F.concat(F.when(o % 64 == 2, "./o").otherwise("o"), (o - 1).cast("string"))).otherwise(""), "]\n",
            "contradicts: [", F.when(o % 18 == 4, F.concat(F.lit("o"), (o + 9).cast("string"))).when(o % 36 == 13, F.concat(F.lit("O"), (o - 9).cast("string"), F.lit(".md"))).otherwise(""), "]\n---\n# claim\n",
            _when(o % 16 == 1, "\n## 可能冲突或待验证\nIt differs.\n"),
        ).alias("text"),
    )
    s = F.col("s_suppkey")
    source = _read(spark, sf_dir, "supplier").select(
        F.format_string("_graphify/sources/s%d.md", "s_suppkey").alias("rel_path"),
        _render("---\ntype: source\ntitle: supplier source ", _str("s_suppkey"), "\nstatus: reviewed\n", COMMON_FILLER, "contradicts: []\ntags: []\nreview_after:\nconfidence: ", F.when(s % 9 == 0, "high").otherwise("0.9"), "\npart_of: []\nsource_kind: report\n", _when(s % 4 != 0, "traceability_level: full\n"), "source_refs: [", _when(s % 3 != 0, F.concat(F.lit("raw/inbox/part-"), _str("s_suppkey"), F.lit(".md"))), "]\n---\n").alias("text"),
    )
    p = F.col("p_partkey")
    raw = _read(spark, sf_dir, "part").select(F.format_string("raw/inbox/part-%d.md", "p_partkey").alias("rel_path"), _render("---\ntitle: ", F.col("p_name"), "\n", _when(p % 5 == 0, "status: archived\n"), "---\n").alias("text"))
    out = region
    for part in (nation, wiki, claim, source, raw):
        out = out.union(part)
    return out


class Vault:
    """Parsed notes and the tables derived from them, each made when it is first asked for.

    ``keep`` writes a table that many plans read, or marks it as persistent;
    notes that are short plans over a kept table are ``kept`` already.
    """

    def __init__(self, notes: DataFrame, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist, kept: bool = False):
        self.notes = notes if kept else keep(notes)
        self.keep = keep

    @cached_property
    def nodes(self) -> DataFrame:
        # not kept: most plans read an id and a type of it, which the notes have
        return graph.nodes(self.notes)

    @cached_property
    def aliases(self) -> DataFrame:
        return self.keep(graph.alias_map(self.nodes))

    @cached_property
    def refs(self) -> DataFrame:
        # read twice, for its distinct texts and for its rows
        asked = self.keep(graph.references(self.notes))
        return self.keep(graph.resolve(asked, self.nodes, graph.asked_aliases(self.nodes, asked)))

    @cached_property
    def edges(self) -> DataFrame:
        return self.keep(graph.edges(self.refs))

    def updated(self, changes: DataFrame, texts: DataFrame) -> Vault:
        """The vault after a change set ``(path, change)`` with the texts of changed files."""
        return UpdatedVault(self, changes, texts)

    @cached_property
    def index(self) -> Index:
        """The lookup index, made when it is first asked for."""
        return Index(self.notes, self.keep)

    @cached_property
    def typed(self) -> DataFrame:
        """The edges with the types of both ends, for plans that ask for most of them."""
        return self.keep(graph.typed(self.edges, self.nodes))

    @cached_property
    def near(self) -> graph.Adjacency:
        """The edges by either end, made when they are first asked for."""
        return graph.Adjacency(self.edges, self.nodes, self.keep)


class UpdatedVault(Vault):
    """A vault after a change set; what isn't asked for is not brought up to date."""

    def __init__(self, old: Vault, changes: DataFrame, texts: DataFrame):
        self.keep = old.keep
        self.step = incremental.Update(old, changes, texts, self.keep)

    notes = cached_property(lambda self: self.step.notes)
    nodes = cached_property(lambda self: self.step.nodes)
    aliases = cached_property(lambda self: self.step.aliases)
    refs = cached_property(lambda self: self.step.refs)
    edges = cached_property(lambda self: self.step.edges)


_VAULTS: dict[tuple[str, str, str, int], Vault] = {}


def vault(spark: SparkSession, sf_dir: str) -> Vault:
    """The tables' vault, one for each session and state of the folder."""
    return _once(spark, sf_dir, "whole", lambda keep: _parsed(texts(spark, sf_dir), keep))


def _parsed(table: DataFrame, keep: Keeper) -> Vault:
    """The vault of ``(rel_path, text)``: heads are kept, a plan takes apart the values it asks for."""
    return Vault(typed(keep(heads(_dealt(keep(table))))), keep, kept=True)


def _dealt(table: DataFrame) -> DataFrame:
    """A kept table's rows on all cores: notes take long to parse for their bytes."""
    return table.repartition(4 * table.sparkSession.sparkContext.defaultParallelism, "rel_path")


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[Keeper], Vault]) -> Vault:
    key = (spark.sparkContext.applicationId, sf_dir, name, state_of(spark, sf_dir))
    if key not in _VAULTS:
        # the texts are a table of their own: else the parser is planned once
        # for each branch of the union
        _VAULTS[key] = make(Keeper(spark))
    return _VAULTS[key]


def earlier_texts(now: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(rel_path, text)`` of a state of the vault before changes of every kind.

    Some claims and raw items aren't there yet, some wikis have no claim
    list, some claims have other texts, and some notes that go later take
    the keys of claims and stand where references point.
    """
    n = F.regexp_extract("rel_path", r"([0-9]+)\.md$", 1).try_cast("bigint")
    claim, wiki, raw = F.col("rel_path").contains("/命题/"), F.col("rel_path").rlike("/c[0-9]+\\.md$"), F.col("rel_path").startswith("raw/")
    kept = now.where(~F.coalesce((claim & (n % 7 == 3)) | (raw & (n % 4 == 1)), F.lit(False)))
    text = F.when(wiki & (n % 5 == 2), F.replace("text", F.lit("\nclaim_refs:"), F.lit("\nolder_refs:"))).when(claim & (n % 9 == 4), F.concat("text", F.lit("\nAnd [[s1]] was seen.\n"))).otherwise(F.col("text"))
    orders = _read(spark, sf_dir, "orders")
    rival = orders.where("o_orderkey % 6 = 0").select(F.format_string("知识簇/gone/r%d.md", "o_orderkey").alias("rel_path"), F.concat(F.lit("---\ntype: wiki\ntitle: o"), _str("o_orderkey"), F.lit("\nsource_refs: [_graphify/sources/s1.md]\n---\n")).alias("text"))
    target = _read(spark, sf_dir, "customer").where("c_custkey % 14 = 0").select(F.format_string("知识簇/gone/gone %d.md", "c_custkey").alias("rel_path"), F.lit("---\ntype: wiki\n---\n").alias("text"))
    return kept.select("rel_path", text.alias("text")).union(rival).union(target)


def updated_vault(spark: SparkSession, sf_dir: str) -> Vault:
    """The tables' vault, brought up to date from its earlier state by tracked changes."""

    def snapshot(table: DataFrame) -> DataFrame:
        return table.select(F.col("rel_path").alias("path"), F.lit(0).alias("mtime"), F.length("text").alias("size"), F.sha2("text", 256).alias("sha256"))

    def make(keep: Keeper) -> Vault:
        now = keep(texts(spark, sf_dir))
        before = keep(earlier_texts(now, spark, sf_dir))
        return Vault(typed(keep(heads(_dealt(before)))), keep, kept=True).updated(status.changes(snapshot(before), snapshot(now)), now)

    return _once(spark, sf_dir, "updated", make)
