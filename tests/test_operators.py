from pathlib import Path

from pyspark.sql import functions as F

from notegraph.operators import graph, lint, lookup, media, status
from notegraph.plans.bridge import Vault
from notegraph.plans.tables import Keeper
from notegraph.sources import export
from notegraph.sources.notes import parse
from notegraph.streaming import changes

CLAIM = "type: claim\nstatus: draft\nclaim_status: {state}\nconfidence: 0.5\n{more}\n"


_MADE = {}


def vault_of(spark, files):
    if id(files) not in _MADE:
        _MADE[id(files)] = Vault(parse(spark.createDataFrame([(k, f"---\n{v}---\nbody of {k}\n") for k, v in files.items()], "rel_path string, text string")), Keeper(spark))
    return _MADE[id(files)]


FILES = {
    "知识簇/A/_索引.md": "type: index\nstatus: draft\nconfidence: 1\n",
    "知识簇/B/_索引.md": "type: index\nstatus: draft\nconfidence: 1\n",
    "知识簇/A/w.md": "type: wiki\nstatus: draft\nconfidence: 0.5\npart_of: [知识簇/A/_索引]\nclaim_refs: [a, b]\n",
    "知识簇/A/命题/a.md": CLAIM.format(state="active", more="title: Alpha mechanism\nconflict_refs: [b]\nsource_refs: [s]\nsupports: [w, _索引]"),
    "知识簇/A/命题/b.md": CLAIM.format(state="outdated", more="title: Other\ngraph_role: standalone_claim\ncontradicts: [c]"),
    "知识簇/A/命题/c.md": CLAIM.format(state="active", more="title: Third\nconflict_refs: [./知识簇/A/命题/a.md]"),
    "_graphify/sources/s.md": "type: source\nstatus: draft\nconfidence: x\nsource_refs: [raw/inbox/r.md]\n",
    "raw/inbox/r.md": "title: R\n",
    "raw/inbox/q.md": "title: Q\n",
}


def test_resolution_precedence(spark):
    v = vault_of(spark, FILES)
    got = {(r.rel_path.split("/")[-1], r.ref): r.target for r in v.refs.collect()}
    assert got["a.md", "_索引"] is None
    assert got["a.md", "b"] == "知识簇/A/命题/b.md" and got["a.md", "w"] == "知识簇/A/w.md"
    assert got["c.md", "./知识簇/A/命题/a.md"] == "知识簇/A/命题/a.md"
    assert got["w.md", "知识簇/A/_索引"] == "知识簇/A/_索引.md"


def test_impact_and_scope(spark):
    v = vault_of(spark, FILES)
    reached = {(r.layer, r.path.split("/")[-1]) for r in graph.impact(v.near, v.nodes.select(F.col('id').alias('target')), v.nodes).where("target like '%s.md'").collect()}
    assert reached == {("claims", "a.md"), ("wikis", "w.md"), ("indexes", "_索引.md")}
    seeds = spark.createDataFrame([("知识簇/A/命题/a.md",)], "path string")
    inside = {r.path.split("/")[-1] for r in graph.scope(seeds, v.near, v.nodes).collect()}
    assert inside == {"a.md", "b.md", "c.md", "s.md", "w.md", "_索引.md"}
    assert {r.rel_path for r in graph.orphans(v.notes, v.edges).collect()} == {"知识簇/B/_索引.md"}


def test_lint_rules(spark):
    v = vault_of(spark, FILES)
    found = {(r.rel_path.split("/")[-1], r.rule, r.detail.split("/")[-1]) for r in lint.lint(v.notes, v.refs, v.edges, "2024-01-01").collect()}
    for row in (("a.md", "one_sided_conflict", "b.md"), ("a.md", "broken_relation", "_索引"), ("w.md", "inactive_claim", "b.md outdated"), ("b.md", "absorbed_marked", ""), ("c.md", "standalone_unmarked", ""), ("s.md", "confidence_missing", ""), ("b.md", "one_sided_contradiction", "c.md"), ("a.md", "conflict_unexplained", "b.md")):
        assert row in found, row
    inside = spark.createDataFrame([("知识簇/A/命题/b.md",)], "path string")
    few = lint.lint(v.notes, v.refs, v.edges, "2024-01-01", scope=inside)
    assert {(r.rel_path, r.rule == "manifest_not_compared") for r in few.collect()} == {("知识簇/A/命题/b.md", False), ("", True)}
    assert "one_sided_contradiction" not in {r.rule for r in few.collect()}


def test_lookup_shows_forced_conflicts_beyond_the_limit(spark):
    v = vault_of(spark, FILES)
    asked = spark.createDataFrame([(1, "Alpha mechanism"), (2, "zzz")], "query_id int, query string")
    out = lookup.lookup(v.index, v.near, asked, limit=1).where("query_id = 1")
    rows = [(r.part, r.path.split("/")[-1]) for r in out.orderBy("part", "rank").collect()]
    assert ("knowledge", "a.md") in rows
    assert {p for k, p in rows if k == "related"} == {"w.md", "b.md", "c.md"}
    assert lookup.lookup(v.index, v.near, asked).where("query_id = 2").count() == 0


def test_status_and_changes(spark):
    v = vault_of(spark, FILES)
    assert [(r.rel_path, r.state) for r in status.pending(v.notes).collect()] == [("raw/inbox/q.md", "inbox")]
    schema = "path string, mtime bigint, size bigint, sha256 string"
    before = spark.createDataFrame([("a", 1, 5, "x"), ("b", 1, 5, None), ("c", 1, 5, "x"), ("d", 1, 5, "x")], schema)
    now = spark.createDataFrame([("a", 2, 5, "x"), ("b", 2, 5, "y"), ("c", 1, 5, "y"), ("e", 1, 5, "x")], schema)
    assert {r.path: r.change for r in status.changes(before, now).collect()} == {"b": "modified", "c": "modified", "d": "removed", "e": "added"}


def test_frames(spark):
    frames = spark.createDataFrame([("v", 0.0, 1, "x"), ("v", 1.0, 2, "x"), ("v", 2.0, 3, None), ("v", 3.0, 4, "x"), ("v", 12.5, 5, "y")], "video string, ts double, seq int, fingerprint string")
    got = [(r.fingerprint, r.cover_start, r.cover_end) for r in media.collapse_repeats(frames).orderBy("island").collect()]
    assert got == [("x", 0.0, 1.0), (None, 2.0, 3.0), ("y", 12.5, 12.5)] or got == [("x", 0.0, 1.0), ("x", 2.0, 3.0), ("y", 12.5, 12.5)]
    box = spark.range(1).select(media.normal_box(F.parse_json(F.lit("[10, 20, 200, 50]")), F.lit(100.0), F.lit(100.0))["bbox"].alias("b"), media.clock(F.lit(3723004)).alias("t")).first()
    assert box.b == [0.1, 0.2, 1.0, 0.5] and box.t == "01:02:03.004"
    regions = spark.createDataFrame([("f", 1, " 原声 x|", [0.0, 0.0, 1.0, 1.0], 0.9, False), ("f", 2, "ok", [0.0, 0.0, 1.0, 1.0], 0.5, False), ("f", 3, " ok", [0.0, 0.0, 1.0, 1.0], 0.5, False), ("f", 4, "12:30", [0.0, 0.0, 1.0, 1.0], 0.9, False), ("f", 5, "展开", None, 0.9, True)], "frame_id string, pos int, text string, bbox array<double>, score double, bbox_missing boolean")
    assert [(r.region_id, r.text, r.review) for r in media.filter_regions(regions).orderBy("region_id").collect()] == [("r01", "原声 x", "maybe_noise"), ("r02", "ok", "ocr_unclear")]


def test_boxes_and_recognised_shapes(spark):
    def run(text):
        row = spark.createDataFrame([(text,)], "r string").select(media.recognised(F.col("r"), F.lit(100.0), F.lit(50.0)).alias("x")).first()
        return [(x.text, x.bbox, x.bbox_missing, x.score) for x in row.x]

    full = [0.0, 0.0, 1.0, 1.0]
    assert run('[{"txt": " a  b ", "box": {"x1": 10, "y1": 10, "x2": 50, "y2": 60}, "score": 0, "confidence": 0.5}]') == [("a b", [0.1, 0.2, 0.5, 1.0], False, 0.5)]
    assert run('[[[[10, 5], [20, 5], [20, 10]], "t", "0.9"], ["u", 0.4], ["v", [0.1, 0.2, 0.3, 0.4], 0.7], "w", 5, ["x", 0.1, [0, 0, 1, 1]]]') == [("t", [0.1, 0.1, 0.2, 0.2], False, 0.9), ("u", full, True, 0.4), ("v", [0.1, 0.2, 0.3, 0.4], False, 0.7), ("w", full, True, None), ("x", full, False, 0.1)]
    assert run('{"txts": ["p", "q"], "scores": [0.5], "boxes": [[1, 1, 2, 2]]}') == [("p", [0.01, 0.02, 0.02, 0.04], False, 0.5), ("q", full, True, None)]
    assert run('"only text"') == [("only text", full, True, None)] and run("null") == [] and run(None) == [] and run("[]") == []


def test_names_of_compiled_media(spark):
    path = "raw/inbox/video-visual/a: b/clip? one.v2.mp4"
    row = spark.createDataFrame([(path,)], "p string").select(media.compile_mode(F.col("p")).alias("m"), media.note_path(F.col("p")).alias("n"), media.regions_path(F.col("p")).alias("r")).first()
    assert tuple(row) == ("video-visual", "raw/compiled/visual/a- b/clip- one.v2（视觉编译）.md", "raw/assets/video-visual/a- b/clip- one.v2/ocr_regions.json")


def test_compiled_media_with_all_kinds_of_frames(spark):
    """A frame with regions, an empty and a failed one; the note reads back."""
    import json

    video = "raw/inbox/video-visual/talks/clip one.mp4"
    frames = media.frame_records(spark.createDataFrame([(video, 12500, 12500, "OCR failed: x"), (video, 0, 1000, None), (video, 3_661_001, 3_662_000, "")], "video string, start_ms bigint, end_ms bigint, error string"))
    regions = spark.createDataFrame([(video, 1, "r01", [0.0, 0.0, 1.0, 1.0], "你好", None), (video, 1, "r02", [0.0, 0.5, 1.0, 1.0], "b", "ocr_unclear")], "video string, frame int, region_id string, bbox array<double>, text string, review string")
    got = [(r.frame, r.anchor, r.text, r.review, r.region_ids) for r in media.anchors(frames, regions).orderBy("anchor").collect()]
    assert got == [(1, "A01", "你好", "", ["r01"]), (1, "A02", "b", "ocr_unclear", ["r02"]), (2, "A03", "OCR failed: x", "ocr_unclear", []), (3, "A04", "未识别到明显文字", "layout_unclear", [])]
    doc = json.loads(media.sidecar(frames, regions, "video-visual", "2024-01-01T00:00:00Z").first().sidecar)
    assert doc["schema_version"] == "1" and doc["media"] == {"source_path": video, "mode": "video_visual", "title": "clip one"}
    assert [(f["frame_id"], f["cover_start"], f["cover_end"]) for f in doc["frames"]] == [("frame-0001", "00:00:00.000", "00:00:01.000"), ("frame-0002", "00:00:12.500", "00:00:12.500"), ("frame-0003", "01:01:01.001", "01:01:02.000")]
    assert doc["frames"][2]["image_path"] == "raw/assets/video-visual/talks/clip one/frame-0003-01-01-01-001.png" and doc["frames"][2]["regions"] == []
    assert doc["frames"][0]["regions"] == [{"region_id": "r01", "bbox": [0.0, 0.0, 1.0, 1.0], "text": "你好", "order": 1}, {"region_id": "r02", "bbox": [0.0, 0.5, 1.0, 1.0], "text": "b", "order": 2, "review": "ocr_unclear"}]
    made = media.compiled_notes(frames, regions, "2024-01-02")
    (row,) = made.collect()
    assert row.rel_path == "raw/compiled/visual/talks/clip one（视觉编译）.md"
    assert "## 内容记录\n\n### E01 | 你好 / b\nTime: 00:00:00.000-00:00:01.000\n- [A01] 你好\n- [A02] b\n\n### E02 | OCR failed: x\nTime: 00:00:12.500\n- [A03] OCR failed: x\n" in row.text
    assert "\n## 锚点附录\n\n### Frame 01\nCovers: 00:00:00.000-00:00:01.000\nImage: `raw/assets/video-visual/talks/clip one/frame-0001-00-00-00-000.png`\n![Frame 01](raw/assets/video-visual/talks/clip one/frame-0001-00-00-00-000.png)\n- [A01] 你好\n- [A02] b\n  Review: ocr_unclear\n" in row.text
    assert row.text.endswith("- [A04] 未识别到明显文字\n  Review: layout_unclear\n")
    (note,) = parse(made.select(F.lit("知识簇/v.md").alias("rel_path"), "text")).collect()
    assert (note.note_type, note.status, note.source_refs, note.tags, note.confidence, note.updated_at, note.review_after) == ("source", "draft", [video], ["source", "video-visual", "media-compiled"], 0.55, "2024-01-02", "2024-02-01")


def test_export_and_baselines(spark, tmp_path):
    import json
    import xml.etree.ElementTree as ET

    v = vault_of(spark, FILES)
    out = str(tmp_path / "out")
    now = spark.createDataFrame([("a.md", 1, 2, "x")], "path string, mtime bigint, size bigint, sha256 string")
    export.export(v.notes, v.refs, v.nodes, v.edges, now, out, "2024-01-01")

    def whole(name):
        parts = sorted(Path(export.part_path(spark, out, name)).glob("part-*"))
        return "".join(p.read_text() for p in parts)

    doc = json.loads(whole("graph.json"))
    assert len(doc["nodes"]) == 9 and len(doc["edges"]) == v.edges.count() and doc["generated_at"] == "2024-01-01"
    assert [n["id"] for n in doc["nodes"]] == sorted(n["id"] for n in doc["nodes"])
    tree = ET.fromstring(whole("graph.graphml"))
    assert len(list(tree.iter("{http://graphml.graphdrawing.org/xmlns}edge"))) == v.edges.count() and len(list(tree.iter("{http://graphml.graphdrawing.org/xmlns}key"))) == 8
    page = whole("graph-summary.md")
    assert "- claim: 3" in page and "- Orphan wiki notes: 1" in page and "- Stale wiki notes: 0" in page and page.startswith("# Graph Summary\n\nGenerated: 2024-01-01\n\n## Counts\n- Nodes: 9\n")
    assert "- [ ] `raw/inbox/q.md`" in whole("pending.md")
    assert export.read_manifest(spark, export.part_path(spark, out, "link-manifest.json")).where("target is not null").exceptAll(graph.manifest(v.refs)).count() == 0
    assert [tuple(r) for r in export.read_snapshot(spark, export.part_path(spark, out, "vault-state.json")).collect()] == [("a.md", 1, 2, "x")]
    old = tmp_path / "old.json"
    old.write_text('{"generated_at": "x", "files": {"a.md": {"mtime_ns": 1, "size": 2}, "b.md": {"mtime_ns": 1, "size": 2, "sha256": "y"}}}')
    before = export.read_snapshot(spark, str(old))
    assert {r.path: r.change for r in status.changes(before, now).collect()} == {"b.md": "removed"}
    links = tmp_path / "links.json"
    links.write_text('{"files": {"知识簇/A/w.md": {"wikilinks": ["gone.md"], "relations": {"part_of": ["知识簇/A/_索引.md"]}, "claim_links": {}}, "lost.md": {"wikilinks": []}}}')
    found = lint.lint(v.notes, v.refs, v.edges, "2024-01-01", before=export.read_manifest(spark, str(links)))
    assert {(r.rel_path, r.rule, r.detail) for r in found.where("rule like 'protected%'").collect()} == {("知识簇/A/w.md", "protected_link_lost", "wikilinks: gone.md"), ("lost.md", "protected_note_missing", "")}
    assert lint.verdict(found).first().passed is False


def test_outcomes_of_impact_and_scope(spark):
    v = vault_of(spark, FILES)
    refs = spark.createDataFrame([("s",), ("nothing",), ("raw/inbox/q.md",)], "ref string")
    got = graph.impact_of(refs, v.near, v.nodes, v.aliases)
    rows = {(r.ref, r.outcome, r.layer) for r in got.collect()}
    assert rows == {("s", "resolved", "claims"), ("s", "resolved", "wikis"), ("s", "resolved", "indexes"), ("nothing", "unresolved", None), ("raw/inbox/q.md", "resolved", None)}
    assert [(r.ref, r.step) for r in graph.sync_steps(got).orderBy("step").collect()] == [("s", i) for i in range(1, 6)]
    assert {r.mode for r in graph.scope_report(None, v.near, v.nodes, v.aliases).collect()} == {"full"}
    empty = graph.scope_report(spark.createDataFrame([("nothing",)], "ref string"), v.near, v.nodes, v.aliases).collect()
    assert [(r.mode, r.part) for r in empty] == [("list", None)]


def test_units_keep_the_first_of_a_heading(spark):
    texts = {"知识簇/A/w.md": "type: wiki\n---\n## H\none\n## H\ntwo\n## 用户提问与复盘\nx\n", "知识簇/A/命题/c.md": "type: claim\n---\n"}
    notes = parse(spark.createDataFrame([(k, f"---\n{t}") for k, t in texts.items()], "rel_path string, text string"))
    assert {(r.section, r.text) for r in lookup.units(notes).collect()} == {("H", "one"), ("正文预览", "## H one ## H two ## 用户提问与复盘 x")}


def test_vault_files_with_any_name(spark, tmp_path):
    from notegraph.sources import notes as N

    paths = ["知识簇/x/_claims/a.md", "知识簇/_索引.md", "知识簇/a/b/c/d/_索引.md", "_graphify/sources/_s.md", "raw/_r.md", "raw/.h.md", "知识簇/x/y.md", "raw/inbox/p.bin", "raw/assets/z.md", "raw/.DS_Store", "知识簇/.git/n.md", "_graphify/indexes/i.markdown", "other/o.md"]
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"---\ntitle: {p}\norigin: here\n---\nbody")
    files = N.read_files(spark, str(tmp_path))
    assert {r.rel_path for r in files.select("rel_path").collect()} == set(paths) - {"other/o.md"}
    # a mount table, which only Spark's file systems know
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.box.link./in", f"file://{tmp_path}")
    mounted = N.read_files(spark, "viewfs://box/in")
    assert {(r.rel_path, bytes(r.content)) for r in mounted.collect()} == {(r.rel_path, bytes(r.content)) for r in files.collect()}
    assert N.read_files(spark, str(tmp_path / "nothing")).count() == 0
    assert {(r.rel_path, r.size) for r in N.write_files(spark.createDataFrame([("raw/é.md", "ü"), ("raw/_n/_x.md", None)], "rel_path string, text string"), str(tmp_path / "w")).collect()} == {("raw/é.md", 2), ("raw/_n/_x.md", 0)}
    assert {(r.rel_path, bytes(r.content)) for r in N.read_files(spark, str(tmp_path / "w")).collect()} == {("raw/é.md", "ü".encode()), ("raw/_n/_x.md", b"")}
    got = {r.rel_path: (r.title, r.origin) for r in N.parse(N.texts_of(files)).collect()}
    assert set(got) == set(paths) - {"raw/assets/z.md", "raw/.DS_Store", "other/o.md"}
    assert got["知识簇/x/_claims/a.md"] == ("知识簇/x/_claims/a.md", "here") and got["raw/inbox/p.bin"] == ("p", "")
    assert N.snapshot(files).where("sha256 is null").count() == 0


def test_stream_of_texts(spark, tmp_path):
    rows = [("知识簇/A/x.md", "---\ntitle: T\n---\nsee [[y]]"), ("知识簇/A/x.md", "---\ntitle: T\n---\nsee [[y]]"), ("知识簇/A/x.md", "changed")]
    table = spark.createDataFrame(rows, "rel_path string, text string").withColumn("seen", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    for name, df, n in (("parsed", parse(stream).select("rel_path", "title"), 3), ("changed", changes.content_changes(stream), 2)):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == n


def test_saved_states_that_are_no_baseline(spark, tmp_path):
    now = spark.createDataFrame([("a.md", 1, 2, "x"), ("b.md", 5, 2, "y")], "path string, mtime bigint, size bigint, sha256 string")
    line = '{"path":"a.md","mtime_ns":1,"size":2,"sha256":"x"}'
    old = '{\n "generated_at": "t",\n "files": {\n  "a.md": {"mtime_ns": 1, "size": 2}\n }\n}\n'
    cases = {"empty": ("", "empty"), "lines": (line + "\n", "present"), "cut": (line + '\n{"path":"b.m', "corrupt"), "old": (old, "present"), "old-cut": (old[:40], "corrupt"), "old-none": ('{"files": {}}', "empty"), "text": ("hello\n", "corrupt")}
    for name, (text, state) in cases.items():
        (tmp_path / name).write_text(text)
        got, rows = export.tracked_changes(spark, now, str(tmp_path / name))
        assert got == state, name
        assert {r.path: r.change for r in rows.collect()} == ({"b.md": "added"} if state == "present" else {"a.md": "added", "b.md": "added"}), name
    assert export.tracked_changes(spark, now, str(tmp_path / "nowhere"))[0] == "missing"
    assert export.saved_manifest(spark, str(tmp_path / "nowhere"))[0] == "missing"


def test_files_to_changes_and_unlinked_notes(spark, tmp_path):
    from notegraph.sources import notes as N

    vault = tmp_path / "vault"
    for name, text in {"知识簇/A/x.md": "see [[y]]", "知识簇/A/y.md": "no link", "raw/q.md": "q"}.items():
        (vault / name).parent.mkdir(parents=True, exist_ok=True)
        (vault / name).write_text(text)
    state = str(tmp_path / "state")
    export.snapshot_json(N.snapshot(N.read_files(spark, str(vault)))).select("line").write.text(state)
    v = Vault(N.parse(N.texts_of(N.read_files(spark, str(vault)))), Keeper(spark))
    links = str(tmp_path / "links")
    export.manifest_json(v.notes, v.refs).select("line").write.text(links)
    (vault / "知识簇/A/x.md").write_text("see [[z]]")
    (vault / "知识簇/A/y.md").unlink()
    (vault / "知识簇/A/z.md").write_text("new")
    files = N.read_files(spark, str(vault))
    kind, rows = export.tracked_changes(spark, N.snapshot(files), state)
    assert kind == "present" and {r.path: r.change for r in rows.collect()} == {"知识簇/A/x.md": "modified", "知识簇/A/y.md": "removed", "知识簇/A/z.md": "added"}
    w = Vault(N.parse(N.texts_of(files)), Keeper(spark))
    found = lint.protected(export.read_manifest(spark, links), w.refs, w.notes)
    assert {(r.rel_path, r.rule) for r in found.collect()} == {("知识簇/A/x.md", "protected_link_lost"), ("知识簇/A/y.md", "protected_note_missing")}


def test_a_failed_export_leaves_the_last_one(spark, tmp_path, monkeypatch):
    import pytest

    v, out = vault_of(spark, FILES), str(tmp_path / "out")
    now = spark.createDataFrame([("a.md", 1, 2, "x")], "path string, mtime bigint, size bigint, sha256 string")
    assert export.latest(spark, out) is None
    first = export.export(v.notes, v.refs, v.nodes, v.edges, now, out, "2024-01-01", "2024-01-01T00:00:00Z")
    monkeypatch.setattr(export, "pending_page", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        export.export(v.notes, v.refs, v.nodes, v.edges, now, out, "2024-01-02")
    assert export.latest(spark, out)["version"] == first and export.latest(spark, out)["generated_at"] == "2024-01-01T00:00:00Z"
    monkeypatch.undo()
    second = export.export(v.notes, v.refs, v.nodes, v.edges, now.limit(0), out, "2024-01-02")
    assert export.latest(spark, out)["version"] == second != first and export.latest(spark, out)["seq"] == 1
    rows = {r.part: (r.rows, r.whole) for r in export.verify(spark, out).collect()}
    assert rows["vault-state.json"] == (0, True) and rows["link-manifest.json"] == (7, True) and all(w for _, w in rows.values())


def test_a_checklist_keeps_its_order(spark):
    from notegraph.sources.notes import unticked

    text = "- [ ] " + " ".join(f"[[n{i}]]" for i in range(1200)) + "\n- [ ] [[last]]\n"
    rows = unticked(spark.createDataFrame([(text,)], "text string")).orderBy("pos").collect()
    assert [r.ref for r in rows] == [f"n{i}" for i in range(1200)] + ["last"]


def test_scope_without_a_list_has_raw_items(spark):
    v = vault_of(spark, FILES)
    assert {r.path for r in graph.scope_report(None, v.near, v.nodes, v.aliases).collect()} == {r.id for r in v.nodes.collect()}


def test_hubs_in_blocks(spark):
    """A hub's edges are dealt over blocks, and nothing else changes."""
    edges = spark.createDataFrame([(f"w{i}", "hub", "wikilink") for i in range(50)] + [("hub", "c", "claim_ref"), ("hub", "c", "wikilink")], "source string, target string, kind string")
    nodes = spark.createDataFrame([(f"w{i}", "wiki") for i in range(50)] + [("hub", "wiki")], "id string, type string")
    near = graph.Adjacency(edges, nodes, block_edges=8)
    assert [(r.node, r.blocks) for r in near.hubs.collect()] == [("hub", 7)]
    assert near.ends.where("node = 'hub'").select("block").distinct().count() > 4
    got = {(r.other, r.kind, r.out, r.other_type) for r in near.of(spark.createDataFrame([("hub",), ("lost",)], "node string")).collect()}
    assert got == {(f"w{i}", "wikilink", False, "wiki") for i in range(50)} | {("c", "claim_ref", True, None), ("c", "wikilink", True, None)}


def test_frontier_joins_move_no_edges(spark):
    """Bucketed edges stand still: the plan exchanges the frontier alone."""
    v = vault_of(spark, FILES)
    near = graph.Adjacency(v.edges, v.nodes, Keeper(spark))
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = near.of(spark.createDataFrame([("知识簇/A/w.md",)], "node string"))
        joined.collect()
        plan = joined._jdf.queryExecution().optimizedPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "other_type" in line)
    assert "Bucketed: true" in scan


def test_updates_against_rebuilding(spark):
    """Random vaults and change sets: keys gain and lose owners, ids come and go."""
    import random

    rng = random.Random(7)
    names = ["a", "b", "c", "d", "e"]

    def note():
        links = " ".join(f"[[{rng.choice(['', './', 'K/'])}{rng.choice(names)}{rng.choice(['', '.md', '|x', '#h'])}]]" for _ in range(3))
        return f"---\ntype: wiki\ntitle: {rng.choice(names)}\naliases: [{rng.choice(names)}{rng.choice(['', '1'])}]\nsee_also: [{rng.choice(names)}1]\n---\n{links}\n"

    def rows(files):
        return spark.createDataFrame(list(files.items()), "rel_path string, text string")

    for _ in range(2):
        paths = [f"知识簇/{f}/{n}.md" for f in ("K", "L") for n in names] + ["raw/a.md"]
        before = {p: note() for p in rng.sample(paths, 8)}
        now = {p: t for p, t in before.items() if rng.random() > 0.25} | {p: note() for p in rng.sample(paths, 3)}
        change = status.changes(*[rows(x).selectExpr("rel_path path", "0 mtime", "0 size", "sha2(text, 256) sha256") for x in (before, now)])
        keep = Keeper(spark)
        got, want = Vault(parse(keep(rows(before))), keep).updated(change, rows(now)), Vault(parse(keep(rows(now))), keep)
        for table in ("notes", "nodes", "aliases", "refs", "edges"):
            x, y = getattr(got, table), getattr(want, table)
            assert sorted(map(repr, x.select(*y.columns).collect())) == sorted(map(repr, y.collect())), table


def test_a_text_that_comes_back(spark, tmp_path):
    """A, B, A are three changes, also where each comes with its own micro-batch; late rows tell nothing."""
    rows = [("p", "A", 1), ("p", "B", 2), ("p", "A", 3), ("p", "A", 4), ("q", None, 1), ("q", "", 2), ("p", "C", None), ("p", "Z", 2)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "rel_path string, text string, at int").select("rel_path", "text", F.timestamp_seconds("at").alias("seen")).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    source = spark.readStream.schema("rel_path string, text string, seen timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b*"))
    q = changes.content_changes(source).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sorted((r.rel_path, r.seen.second) for r in spark.table("told").collect()) == [("p", 1), ("p", 2), ("p", 3), ("q", 1)]


def test_tables_are_made_when_asked_for(spark):
    """A query that needs no references or edges makes none."""
    made = []

    def keep(table):
        made.append(set(table.columns))
        return table.persist()

    rows = [("知识簇/A/c1.md", "---\ntype: wiki\ntitle: one\npart_of: [o1]\n---\nred text\n"), ("知识簇/A/命题/o1.md", "---\ntype: claim\ntitle: claim\n---\nred claim\n")]
    table = lambda rows: spark.createDataFrame(rows, "rel_path string, text string")
    v = Vault(parse(table(rows)), keep)
    assert len(made) == 1
    change = spark.createDataFrame([("知识簇/A/c1.md", "modified")], "path string, change string")
    assert v.updated(change, table(rows)).aliases.where("key = 'one'").count() == 1
    asked = spark.createDataFrame([(1, "red")], "query_id int, query string")
    assert [r.rel_path for r in lookup.routes(v.index, asked).collect()] == ["知识簇/A/c1.md"]
    assert sum("unit" in c and "low" in c for c in made) == 1
    steps = lookup.next_steps(asked, lookup.first_matches(v.index, asked)).collect()
    assert [(r.outcome, r.start) for r in steps] == [("knowledge", "知识簇/A/c1.md")]
    assert not any("ref" in c or "source" in c for c in made)


def test_owners_take_one_shuffle(spark):
    out = graph.owners(spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("b", "y"), ("b", "y")], "id string, key string"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, out.collect())) == [("x", None, 2), ("y", "b", 1)]


def test_values_are_taken_apart_where_asked_for(spark, tmp_path):
    from notegraph.sources.notes import heads, typed

    texts = spark.createDataFrame([(k, f"---\n{v}---\nbody of {k}\n") for k, v in FILES.items()], "rel_path string, text string")
    heads(texts).write.parquet(str(tmp_path / "heads"))
    notes = typed(spark.read.parquet(str(tmp_path / "heads")))
    assert sorted(map(repr, notes.collect())) == sorted(map(repr, parse(texts).collect()))
    counted = graph.nodes(notes).groupBy("type", "status").count()
    assert "ReadSchema: struct<note_type:string,status:string>" in counted._jdf.queryExecution().executedPlan().toString()


def test_ends_reach_what_the_adjacency_reaches(spark):
    """Edges as they stand, typed or not, give what the index gives."""
    v = vault_of(spark, FILES)
    seeds = v.nodes.select(F.col("id").alias("target"))
    asked = v.nodes.select(F.col("id").alias("node"))
    rows = lambda table: sorted(map(repr, table.select(*sorted(table.columns)).collect()))
    for ends in (graph.Ends(v.edges, v.nodes, v.keep), graph.Ends(v.typed, v.nodes, v.keep)):
        assert rows(ends.of(asked)) == rows(v.near.of(asked)) != []
        assert rows(graph.impact(ends, seeds, v.nodes)) == rows(graph.impact(v.near, seeds, v.nodes))
        assert rows(graph.scope(asked.toDF("path"), ends, v.nodes)) == rows(graph.scope(asked.toDF("path"), v.near, v.nodes))


def test_seeds_ask_for_no_edges(spark):
    """The seeds of a list are told from nodes and the asked keys alone, ambiguous ones too."""
    made = []

    def keep(table):
        made.append(set(table.columns))
        return table.persist()

    texts = spark.createDataFrame([(k, f"---\n{v}---\nbody\n") for k, v in FILES.items()], "rel_path string, text string")
    v = Vault(parse(texts), keep)
    listed = spark.createDataFrame([("a",), ("_索引",), ("Third",), ("lost",), ("./知识簇/A/w.md",)], "ref string")
    got = graph.scope_report(listed, None, v.nodes, graph.asked_aliases(v.nodes, listed))
    assert sorted(r.path.split("/")[-1] for r in got.where("part = 'seed'").collect()) == ["a.md", "c.md", "w.md"]
    assert got.where("part is null").count() == 1 and got.count() == 4
    assert not any("ref" in c or "source" in c for c in made)


def test_hot_texts_are_dealt(spark, monkeypatch):
    """References of a text that many notes hold get its target; forms that a text lacks join nothing."""
    v = vault_of(spark, FILES)
    refs = spark.createDataFrame([(f"n{i}", "see_also", 0, r) for i in range(20) for r in ("b", "lost", "./知识簇/A/w.md", "", "_索引")], "rel_path string, field string, pos int, ref string")
    want = sorted(map(repr, graph.resolve(refs, v.nodes, v.aliases).collect()))
    monkeypatch.setattr(graph, "SALT_ROWS", 3)
    got = graph.resolve(refs, v.nodes, v.aliases)
    assert sorted(map(repr, got.collect())) == want and len(want) == 100
    assert {r.ref for r in got.where("target is not null").collect()} == {"b", "./知识簇/A/w.md"}


def test_units_that_no_query_tells_apart_are_scored_once(spark, monkeypatch):
    """Lookups by groups of alike units give what scoring every query on every unit gives."""
    from pyspark.sql import Window

    from notegraph.functions import scoring as S

    page = "---\ntype: wiki\ntitle: page {i}\ntags: [{t}]\n---\n# P\n\n## 主线解释\nall of {t} and {w}\n\n## H\n{w}\n"
    rows = [(f"知识簇/{'AB'[i % 2]}/c{i}.md", page.format(i=i, t=("red", "blue")[i % 3 == 0], w=("one", "page", "a-b")[i % 3])) for i in range(40)]
    rows += [(f"知识簇/A/命题/o{i}.md", f"---\ntype: claim\ntitle: claim {i}\nstatement: red {i % 4}\n---\nbody\n") for i in range(30)]
    rows += [("_graphify/sources/k.md", "---\ntype: claim\ntitle: claim k\npart_of: [知识簇/A/c1]\n---\nred page\n"), ("知识簇/A/c4.md", rows[4][1])]
    keep = Keeper(spark)
    notes = keep(parse(spark.createDataFrame(rows, "rel_path string, text string")))
    asked = spark.createDataFrame([(1, "Page 3"), (2, "red"), (2, "red"), (3, "nowhere"), (None, "red"), (4, None), (5, "a-b, of red red"), (6, "c"), (7, "page 3 claim 12 k"), (7, "blue"), (8, "A/c1.md"), (9, "")], "query_id int, query string")
    clusters = lookup.note_clusters(notes)
    score = lambda body: S.match_score(F.col("query"), F.col("title"), F.col("rel_path"), F.col("aliases"), F.col("tags"), body)
    told = lambda table, *cols: sorted(map(repr, table.select(*cols).collect()))
    about = notes.where("note_type in ('index', 'wiki')").crossJoin(asked.where("query_id is not null"))
    each = lookup.units(notes).crossJoin(asked.where("query_id is not null")).withColumn("score", score(F.col("text"))).where("score > 0")
    first = Window.partitionBy("query_id", "rel_path", "note_type").orderBy(F.desc("score"), S.section_priority(F.col("note_type"), F.col("section")), F.desc("section"))
    every = about.withColumn("score", score(lookup._joined(*lookup._route_parts()))).where("score > 0")
    each, every, index = keep(each), keep(every), lookup.Index(notes, keep)
    for few, limit in ((64, 3), (0, 2)):
        monkeypatch.setattr(lookup, "FEW_TERMS", few)
        routed = keep(lookup.routes(index, asked, limit))
        shown = ("query_id", "rel_path", "score", "rank")
        assert told(routed, *shown) == told(lookup._ranked(every, limit, F.asc("rel_path")), *shown) != []
        wanted = lookup.clusters_of(routed)
        inside = each.join(wanted.select("query_id").distinct(), "query_id", "left_anti").unionByName(each.join(clusters.join(wanted, "cluster").select("query_id", "rel_path").distinct(), ["query_id", "rel_path"], "left_semi"), allowMissingColumns=True)
        best = inside.withColumn("nth", F.row_number().over(first)).where("nth = 1")
        shown = ("query_id", "rel_path", "section", "score", "rank")
        assert told(lookup.knowledge(index, asked, routed, limit), *shown) == told(lookup._ranked(best, limit, F.asc("rel_path"), F.asc("section")), *shown) != []
    assert index.hits(asked.where("query_id = 2").limit(1), False, 1).count() < 30 < each.where("query_id = 2").count()


def test_an_update_makes_no_alias_table(spark):
    """References of changed notes ask for their keys alone."""
    made = []

    def keep(table):
        made.append(set(table.columns))
        return table.persist()

    table = lambda files: spark.createDataFrame([(k, f"---\n{v}---\nbody\n") for k, v in files.items()], "rel_path string, text string")
    now = {"知识簇/A/n.md": "type: wiki\ntitle: Third\nclaim_refs: [a, Third, o]\n", "知识簇/A/命题/o.md": CLAIM.format(state="active", more="title: Alpha mechanism")}
    change = spark.createDataFrame([(k, "added") for k in now], "path string, change string")
    new = Vault(parse(table(FILES)), keep).updated(change, table(now))
    got = {(r.ref, (r.target or "").split("/")[-1]) for r in new.refs.where("rel_path = '知识簇/A/n.md'").collect()}
    assert got == {("a", "a.md"), ("Third", ""), ("o", "o.md")}
    assert not any("n_owners" in c for c in made)


def test_field_rules_take_a_claims_values_once(spark):
    """A claim's value is written out a few times in the plan, not once for each use of its text."""
    from notegraph.sources.notes import heads, typed

    texts = spark.createDataFrame([("知识簇/A/命题/o.md", "---\ntype: claim\nsupport_state: poor\nclaim_status: [active]\nreview_after: none\n---\nx\n"), ("知识簇/A/w.md", "---\ntype: wiki\nsupport_state: poor\nreview_after: 2024-1-2\n---\nx\n")], "rel_path string, text string")
    notes = typed(Keeper(spark)(heads(texts)))
    found = lint.field_rules(notes, "2024-01-15")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[support_state]") < 10
    got = {(r.rel_path[-4:], r.rule, r.detail) for r in found.where("rule not like 'missing%'").collect()}
    assert got == {("o.md", "invalid_support_state", "poor"), ("o.md", "confidence_missing", ""), ("o.md", "invalid_claim_status", "['active']"), ("w.md", "confidence_missing", ""), ("w.md", "review_due", "2024-1-2")}
