import datetime

from pyspark.sql import functions as F

from notegraph.functions import parsing as P
from notegraph.functions import refs as R
from notegraph.functions import scoring as S
from notegraph.sources import notes

NOTE = """---
# comment
type: claim
title: "Quoted: title"
aliases:
  - one
  - 'two'

tags: [a, b , true, 1.5]
confidence: 0.75
empty:
status:
dup: first
dup: second
odd line
  - not kept
review_after: 2024-1-5
---
# Heading

> [!note] 快速把握
> line one

> line two
after

See [[target#part|label]], ![[x]] and [[|none]] [[a
b]].

## First
alpha
### sub
beta

## Empty

## First
second
"""


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_front_matter(spark):
    fm = P.front_matter(F.col("t"))
    row = one(spark, NOTE, P.front_matter_fields(fm["head"]).alias("f"), fm["body"].alias("body"))
    f = row.f
    assert row.body.startswith("# Heading")
    assert f["title"].scalar == "Quoted: title" and f["aliases"]["items"] == ["one", "two"]
    assert f["tags"]["items"] == ["a", "b", "True", "1.5"]
    assert (f["confidence"].kind, f["confidence"].scalar) == ("float", "0.75")
    assert f["empty"]["items"] == [] and f["dup"].scalar == "second" and "odd line" not in f
    assert f["status"].kind == "list"
    for text in ("no front matter", "---\nkey: 1\n---", "", "---\n"):
        assert one(spark, text, P.front_matter(F.col("t")).alias("x")).x.body == text


def test_note_columns(spark):
    rows = [("知识簇/温室/命题/甲.md", NOTE), ("知识簇/温室/_索引.md", ""), ("知识簇/温室/页.md", "# Title here\n"), ("raw/inbox/pic.png", None), ("_graphify/sources/s.md", "---\nstatement: S\n---\n"), ("_graphify/indexes/i.md", "x")]
    got = {r.rel_path: r for r in notes.parse(spark.createDataFrame(rows, "rel_path string, text string")).collect()}
    claim = got["知识簇/温室/命题/甲.md"]
    assert (claim.kind, claim.note_type, claim.title, claim.status, claim.confidence) == ("claim", "claim", "Quoted: title", "[]", 0.75)
    assert claim.wikilinks == ["target", "x", "a\nb"]
    assert (got["知识簇/温室/_索引.md"].kind, got["知识簇/温室/_索引.md"].title) == ("index", "_索引")
    assert (got["知识簇/温室/页.md"].kind, got["知识簇/温室/页.md"].title) == ("wiki", "Title here")
    raw = got["raw/inbox/pic.png"]
    assert (raw.note_type, raw.status, raw.title, raw.source_type) == ("raw", "inbox", "pic", "raw")
    assert got["_graphify/sources/s.md"].title == "S" and got["_graphify/indexes/i.md"].source_type == "indexe"


def test_sections_callout_preview(spark):
    body = NOTE.split("\n---\n", 1)[1]
    row = one(spark, body, P.sections(F.col("t")).alias("s"), P.section(F.col("t"), "First").alias("one"), P.section(F.col("t"), "None").alias("none"), P.callout(F.col("t"), "快速把握").alias("c"), P.preview(F.col("t"), 20).alias("p"))
    assert [(x.heading, x.content) for x in row.s] == [("First", "alpha\n### sub\nbeta"), ("First", "second")]
    assert row.one == "alpha\n### sub\nbeta" and row.none == "" and row.c == "line one\nline two" and row.p == "# Heading > [!note] "


def test_references_and_dates(spark):
    row = one(
        spark, " /A\\B.MD/", R.normalize_ref(F.col("t")).alias("n"), R.clean_ref(F.lit("x.md#h|l")).alias("c"),
        R.candidate_keys(F.lit("raw/v1.0/README"), F.lit("T"), F.array(F.lit("Al"), F.lit(" "))).alias("k"), R.dedupe(F.array(*map(F.lit, ("b", "", "a", "b")))).alias("d"),
        P.is_due(F.lit("2024-1-5"), "2024-01-05").alias("due"), P.is_due(F.lit("soon"), "2024-01-05").alias("no"), S.tokens(F.lit("What is the Red-Widget/a_b of x")).alias("tok"),
    )
    assert (row.n, row.c) == ("a\\b.md/".replace("\\", "/").removesuffix(".md/"), "x.md") or row.n == "a/b"
    assert set(row.k) == {"readme", "raw/v1", "v1", "t", "al"} and row.d == ["b", "a"]
    assert row.due and not row.no and row.tok == ["red", "widget", "b", "x"]
    assert datetime.date(2024, 1, 5)


def test_checklist(spark):
    text = "- [ ] [[one|x]] and `no/wonder`\n  - [ ] `two.md`\n- [ ] raw/three.md # later\n- [x] done\n- [ ] [[one]]\n"
    got = notes.unticked(spark.createDataFrame([(text,)], "text string")).orderBy("pos").collect()
    assert [r.ref for r in got] == ["one", "no/wonder", "two.md", "raw/three.md"]


def test_files(spark, tmp_path):
    for path, text in (("知识簇/温室/页 a.md", "---\ntitle: T\n---\r\nbody"), ("raw/assets/x.md", "no"), ("raw/inbox/a.bin", "\x00"), ("other/x.md", "no"), ("知识簇/温室/_索引.md", "i"), ("_graphify/sources/s.markdown", "s")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = notes.read_files(spark, str(tmp_path))
    got = {r.rel_path: r.text for r in notes.texts_of(files).collect()}
    assert set(got) == {"知识簇/温室/页 a.md", "知识簇/温室/_索引.md", "raw/inbox/a.bin", "_graphify/sources/s.markdown"}
    assert got["raw/inbox/a.bin"] is None
    assert notes.snapshot(files).where("sha256 is null").count() == 0


def test_blanks_are_those_of_the_expressions(spark):
    """Stripping without an expression takes off the same characters."""
    every = spark.range(1, 0xFFFF).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    text = F.concat("c", F.lit("x y"), "c", "c")
    assert every.where(P.strip(text) != F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).count() == 0
    assert every.where(P.strip(F.concat("c", "c")) == "").count() == len(P.BLANKS) == 25


def test_blanks_around_keys_and_dashes(spark):
    head = "a: \u3000\n - \u2003one \n  - 'two' \n \t\n # note\nb:\t True \nc: [x , \"y\",]\u00a0\nd:\n\ne: -1.5\nf: /\n- \ng: '\n"
    row = spark.createDataFrame([(head,)], "head string").select(P.front_matter_fields(F.col("head")).alias("f")).first().f
    assert {k: (v.kind, v.scalar, v["items"]) for k, v in row.items()} == {
        "a": ("list", None, ["one", "two"]), "b": ("bool", "True", None), "c": ("list", None, ["x", "y", ""]), "d": ("list", None, []),
        "e": ("float", "-1.5", None), "f": ("str", "/", None), "g": ("str", "", None),
    }
