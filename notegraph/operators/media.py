"""Frames, text regions and anchors of compiled media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions.parsing import let, stem

#: Largest gap between frames in seconds, most frames.
MAX_GAP, MAX_FRAMES = 15.0, 24


def collapse_repeats(frames: DataFrame) -> DataFrame:
    """``(video, island, fingerprint, cover_start, cover_end, n_frames)``.

    Runs of frames with the same fingerprint are one; a frame without a
    fingerprint (extraction failed) starts a run of its own, and the
    fingerprint before it stays the one to compare with.
    """
    order = Window.partitionBy("video").orderBy("ts", "seq")
    before = F.last("fingerprint", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("fingerprint").isNull() | before.isNull() | (F.col("fingerprint") != before)
    island = F.sum(F.when(fresh, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = frames.withColumn("island", island.cast("bigint"))
    return runs.groupBy("video", "island").agg(F.max("fingerprint").alias("fingerprint"), F.min("ts").alias("cover_start"), F.max("ts").alias("cover_end"), F.count(F.lit(1)).alias("n_frames"))


def normal_times(times: DataFrame) -> DataFrame:
    """``(video, ms)``: distinct nonnegative milliseconds, half to even."""
    return times.select("video", F.bround(F.greatest("ts", F.lit(0.0)) * 1000, 0).cast("bigint").alias("ms")).distinct()


def fill_gaps(times: DataFrame, gap_ms: int = int(MAX_GAP * 1000)) -> DataFrame:
    """``times(video, ms)`` with extra points so that no gap is longer."""
    after = F.lead("ms").over(Window.partitionBy("video").orderBy("ms"))
    points = F.when(after - F.col("ms") > gap_ms, F.sequence(F.col("ms"), after - 1, F.lit(gap_ms).cast("bigint"))).otherwise(F.array("ms"))
    return times.withColumn("p", points).select("video", F.explode("p").alias("ms")).distinct()


def downsample(times: DataFrame, most: int = MAX_FRAMES) -> DataFrame:
    """``(video, ms)``: at most ``most`` evenly spaced points of each video."""
    place = F.row_number().over(Window.partitionBy("video").orderBy("ms")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("video"))
    placed = times.withColumn("place", place.cast("bigint")).withColumn("n", n)
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (most - 1), 0).cast("bigint"))
    return placed.where((F.col("n") <= most) | F.array_contains(picks, F.col("place"))).select("video", "ms")


#: Recognised text that is page furniture, from its start.
NOISE = (
    r"\d{1,2}:\d{2}$",
    r"5G\d*$",
    r"\d+\s*%$",
    r"\d+\s*(天|小时|分钟)前$",
    r"@\S+·\d+\s*(天|小时|分钟)前$",
    r"第?\d+\s*(赞|评论|收藏|分享)?$",
    r"全屏观看$",
    r"点击推荐[>＞]?$",
    r"下一集[>＞]?$",
    r"第\d+集.*展开$",
    r"合集[·:：].*$",
    r"拍同款$",
    r"展开$",
    r"\d*个人观点，仅供参考$",
    r"搜索$",
    r"弹$",
    r"善语结善缘，恶言伤人心$",
    r"汽水音乐[>＞].*$",
)
#: Modes of compiled media, and the one that has frames.
MODES, VISUAL = ("video-visual", "video-audio", "audio"), "video-visual"


def ocr_text(text: Column) -> Column:
    """Recognised text with single blanks, without blanks and bars at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^[\x20｜|]+|[\x20｜|]+$", "")


def is_noise(text: Column, patterns: tuple[str, ...] = NOISE) -> Column:
    """Too short, digits or symbols only, or page furniture."""
    noise = (F.length(text) <= 1) | text.rlike(r"^[\d\s:：.·,，%]+$") | text.rlike(r"^[♡❤★☆💬↗+\-\d\s]+$")
    return noise | text.rlike("(?i)^(?:" + "|".join(patterns) + ")") if patterns else noise


def filter_regions(regions: DataFrame, patterns: tuple[str, ...] = NOISE) -> DataFrame:
    """``(frame_id, region_id, text, bbox, score, review)`` of regions kept.

    Repeats of a text at a place go, the rest are numbered in order; review
    marks doubtful text first, then a low score, then a missing box.
    """
    clean = regions.withColumn("text", ocr_text(F.col("text"))).where(~is_noise(F.col("text"), patterns))
    box = F.transform("bbox", lambda x: x.cast("string"))
    first = Window.partitionBy("frame_id", "text", F.array_join(box, ",")).orderBy("pos")
    own = clean.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    number = F.row_number().over(Window.partitionBy("frame_id").orderBy("pos"))
    review = F.when(F.col("text").rlike("^(?:原声|更多|置顶)"), "maybe_noise").when(F.col("score") < 0.6, "ocr_unclear").when(F.col("bbox_missing"), "layout_unclear")
    return own.select("frame_id", F.format_string("r%02d", number).alias("region_id"), "text", "bbox", "score", review.alias("review"))


def _number(v: Column) -> Column:
    """A variant's number, or null."""
    return F.try_variant_get(v, "$", "double")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def normal_box(box: Column, width: Column, height: Column) -> Column:
    """``(bbox, missing)``: a box as shares of the frame, within [0, 1].

    ``box`` is a variant: four numbers, an object of x1, y1, x2 and y2, or a
    list of points.  Anything else is the whole frame, marked as missing.
    """
    point = "array<struct<x:double,y:double>>"

    def at(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    corner = [F.try_variant_get(box, f"$.{k}", "double") for k in ("x1", "y1", "x2", "y2")]
    named = F.when(corner[0].isNotNull() & corner[1].isNotNull() & corner[2].isNotNull() & corner[3].isNotNull(), F.array(at(corner[0], corner[1]), at(corner[2], corner[3])).cast(point))

    def listed(items: Column) -> Column:
        numbers = F.transform(items, _number)
        points = F.filter(F.transform(items, lambda p: at(F.try_variant_get(p, "$[0]", "double"), F.try_variant_get(p, "$[1]", "double"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        four = (F.size(items) == 4) & F.forall(numbers, lambda x: x.isNotNull())
        return F.when(four, F.array(at(F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))), at(F.get(numbers, F.lit(2)), F.get(numbers, F.lit(3)))).cast(point)).otherwise(points.cast(point))

    def shares(points: Column) -> Column:
        every = F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))
        big = (F.array_max(F.transform(every, lambda x: F.abs(x))) > 1.5) & (width > 0) & (height > 0)

        def side(name: str, size: Column, pick) -> Column:
            return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pick(F.transform(points, lambda p: F.when(big, p[name] / size).otherwise(p[name]))))), 4)

        return F.array(side("x", width, F.array_min), side("y", height, F.array_min), side("x", width, F.array_max), side("y", height, F.array_max))

    coords = F.when(_is(box, "OBJECT"), named).when(_is(box, "ARRAY"), let(F.try_variant_get(box, "$", "array<variant>"), listed))
    full = F.struct(F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)]).alias("bbox"), F.lit(True).alias("missing"))
    return let(coords, lambda ps: F.when(F.coalesce(F.size(ps), F.lit(0)) > 0, F.struct(shares(ps).alias("bbox"), F.lit(False).alias("missing"))).otherwise(full))


def recognised(result: Column, width: Column, height: Column) -> Column:
    """Regions ``(text, bbox, bbox_missing, score)`` of one frame's result as JSON.

    A result is an object of ``txts``, ``scores`` and ``boxes``, a list of
    regions, or a text; a region is an object, a text, or a list that begins
    with its box or its text.
    """
    variants = "array<variant>"

    def field(v: Column, *names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in names])

    def region(text: Column, box: Column, score: Column) -> Column:
        return F.struct(text.cast("string").alias("text"), box.cast("variant").alias("box"), score.cast("double").alias("score"))

    none = F.lit(None)

    def of(v: Column) -> Column:
        first, second, third = (F.try_variant_get(v, f"$[{i}]", "variant") for i in range(3))
        beside = (_is(second, "ARRAY") | _is(second, "OBJECT"), _is(third, "ARRAY") | _is(third, "OBJECT"))
        text_second = _is(second, "STRING") & third.isNotNull()
        score = F.coalesce(F.nullif(_number(field(v, "score")), F.lit(0.0)), F.nullif(_number(field(v, "confidence")), F.lit(0.0)))
        texts = F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in ("text", "txt", "content")])
        return (
            F.when(_is(v, "OBJECT"), region(texts, field(v, "bbox", "box", "points"), score))
            .when(_is(v, "STRING"), region(F.try_variant_get(v, "$", "string"), none, none))
            .when(_is(v, "ARRAY") & text_second, region(F.try_variant_get(v, "$[1]", "string"), first, _number(third)))
            .when(_is(v, "ARRAY") & _is(first, "STRING"), region(F.try_variant_get(v, "$[0]", "string"), F.when(beside[0], second).when(beside[1], third), F.when(~beside[0], _number(second)).when(~beside[1], _number(third))))
        )

    def split(v: Column) -> Column:
        texts = F.coalesce(F.try_variant_get(v, "$.txts", variants), F.array().cast(variants))
        scores, boxes = (F.coalesce(F.try_variant_get(v, f"$.{k}", variants), F.array().cast(variants)) for k in ("scores", "boxes"))
        columns = F.transform(texts, lambda t, i: region(F.try_variant_get(t, "$", "string"), F.get(boxes, i), _number(F.get(scores, i))))
        return F.when(_is(v, "OBJECT"), columns).when(_is(v, "ARRAY"), F.transform(F.try_variant_get(v, "$", variants), of)).when(_is(v, "STRING"), F.array(region(F.try_variant_get(v, "$", "string"), none, none)))

    def row(r: Column) -> Column:
        return let(normal_box(r["box"], width, height), lambda b: F.struct(ocr_text(r["text"]).alias("text"), b["bbox"].alias("bbox"), b["missing"].alias("bbox_missing"), r["score"].alias("score")))

    found = let(F.try_parse_json(result), split)
    kept = F.filter(found, lambda r: F.coalesce(ocr_text(r["text"]), F.lit("")) != "")
    return F.coalesce(F.transform(kept, row), F.array().cast("array<struct<text:string,bbox:array<double>,bbox_missing:boolean,score:double>>"))


def fingerprint(content: Column) -> Column:
    """What tells frames apart: the SHA-1 of their bytes."""
    return F.sha1(content)


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\x{3400}-\x{9fff}]"), F.lit(False))


def keywords(texts: Column, lang: Column) -> Column:
    """The first two texts of a frame, at most 30 characters each."""
    short = F.transform(F.slice(texts, 1, 2), lambda t: let(ocr_text(t), lambda c: F.when(F.length(c) > 30, F.concat(F.rtrim(F.substring(c, 1, 27)), F.lit("..."))).otherwise(c)))
    return F.when(F.size(texts) > 0, F.array_join(short, " / ")).when(lang == "zh", "未识别文本").otherwise("No OCR text")


def file_name(text: Column) -> Column:
    """``text`` as a file name of at most 120 characters."""
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|]+', "-"), r"(?U)\s+", " ")), r"^\.+|\.+$", ""), 1, 120)


def compile_mode(path: Column) -> Column:
    """The mode of a file below ``raw/inbox/<mode>/``, or null."""
    p = F.split(path, "/")
    mode = F.get(p, F.lit(2))
    return F.when((F.get(p, F.lit(0)) == "raw") & (F.get(p, F.lit(1)) == "inbox") & mode.isin(*MODES), mode)


def _parts(path: Column) -> Column:
    """The clean names below the visual inbox, the last one without suffix."""
    below = F.regexp_replace(F.substring(path, len(f"raw/inbox/{VISUAL}/") + 1, 1 << 20), r"(?<=[^/])\.[^./]*$", "")
    return F.array_join(F.transform(F.split(below, "/"), file_name), "/")


def note_path(path: Column) -> Column:
    """Where the note of a compiled video goes."""
    return F.concat(F.lit("raw/compiled/visual/"), _parts(path), F.lit("（视觉编译）.md"))


def asset_folder(path: Column) -> Column:
    return F.concat(F.lit(f"raw/assets/{VISUAL}/"), _parts(path))


def regions_path(path: Column) -> Column:
    return F.concat(asset_folder(path), F.lit("/ocr_regions.json"))


def frame_records(islands: DataFrame) -> DataFrame:
    """``(video, frame, start_ms, end_ms, image_path, error)`` of ``(video, start_ms, end_ms, error)``.

    Frames are numbered by time from 1; their images are named by number and time.
    """
    number = F.row_number().over(Window.partitionBy("video").orderBy("start_ms", "end_ms", F.coalesce("error", F.lit(""))))
    image = F.concat(asset_folder(F.col("video")), F.format_string("/frame-%04d-", "frame"), time_token(F.col("start_ms")), F.lit(".png"))
    return islands.withColumn("frame", number).select("video", "frame", "start_ms", "end_ms", image.alias("image_path"), F.coalesce("error", F.lit("")).alias("error"))


#: What an anchor says where nothing was recognised, and how
#: anchors of failed and of empty frames are marked for review.
NO_TEXT, UNCLEAR, NO_LAYOUT = "未识别到明显文字", "ocr_unclear", "layout_unclear"


def anchors(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """``(video, frame, anchor, text, review, region_ids)`` of ``frame_records`` and their regions.

    Each region ``(video, frame, region_id, bbox, text, review)`` is an
    anchor; a frame without any has one that tells its error, or that no text
    was found.  Numbers run on across a video's frames.
    """
    rows = frames.select("video", "frame", "error").join(regions, ["video", "frame"], "left")
    empty, failed = F.col("region_id").isNull(), F.col("error") != ""
    number = F.row_number().over(Window.partitionBy("video").orderBy("frame", "region_id"))
    return rows.select(
        "video",
        "frame",
        F.format_string("A%02d", number).alias("anchor"),
        F.when(~empty, F.col("text")).when(failed, F.col("error")).otherwise(NO_TEXT).alias("text"),
        F.when(~empty, F.coalesce("review", F.lit(""))).when(failed, UNCLEAR).otherwise(NO_LAYOUT).alias("review"),
        F.when(empty, F.array().cast("array<string>")).otherwise(F.array("region_id")).alias("region_ids"),
    )


def _in_frames(frames: DataFrame, items: DataFrame, order: str, *columns: str) -> DataFrame:
    """``frames`` with ``items``: the rows of another table for each frame, in order."""
    own = items.groupBy("video", "frame").agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("items"))
    return frames.join(own, ["video", "frame"], "left")


def _in_videos(rows: DataFrame, *columns: str) -> DataFrame:
    """``(video, frames)``: a video's frames in order; it has at most ``MAX_FRAMES``, so a row stays small."""
    return rows.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("frame", *columns))).alias("frames"))


def sidecar(frames: DataFrame, regions: DataFrame, mode: str, compiled_at: str) -> DataFrame:
    """``(video, sidecar)``: each video's frames and their regions as one JSON text."""
    shaped = F.transform("items", lambda r, i: F.struct(r["region_id"].alias("region_id"), r["bbox"].alias("bbox"), r["text"].alias("text"), (i + 1).alias("order"), F.nullif(r["review"], F.lit("")).alias("review")))
    none = F.array().cast("array<struct<region_id:string,bbox:array<double>,text:string,order:int,review:string>>")
    rows = _in_frames(frames, regions, "region_id", "bbox", "text", "review")
    rows = rows.select("video", "frame", F.format_string("frame-%04d", "frame").alias("frame_id"), clock(F.col("start_ms")).alias("cover_start"), clock(F.col("end_ms")).alias("cover_end"), "image_path", F.coalesce(shaped, none).alias("regions"))
    fields = ("frame_id", "cover_start", "cover_end", "image_path", "regions")
    each = F.transform("frames", lambda f: F.struct(*[f[c].alias(c) for c in fields]))
    about = F.struct(F.col("video").alias("source_path"), F.lit(mode.replace("-", "_")).alias("mode"), stem(F.col("video")).alias("title"))
    whole = F.struct(F.lit("1").alias("schema_version"), F.lit(compiled_at).alias("compiled_at"), about.alias("media"), each.alias("frames"))
    return _in_videos(rows, *fields).select("video", F.to_json(whole).alias("sidecar"))


#: Front matter of a compiled note, after its source and before its lists.
NOTE_TAGS = ("source", VISUAL, "media-compiled")
NOTE_LISTS = ("see_also", "part_of", "depends_on", "supports", "contradicts")


def compiled_notes(frames: DataFrame, regions: DataFrame, compiled_on: str) -> DataFrame:
    """``(video, rel_path, text)``: the note of each compiled video.

    It records what each frame says, then, as an appendix, each frame's image
    and anchors with their marks.  Its front matter reads back through the
    parser.
    """
    noted = anchors(frames, regions)
    said = regions.groupBy("video", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("region_id", "text"))), lambda r: r["text"]).alias("texts"))
    rows = _in_frames(frames, noted.withColumn("n", F.substring("anchor", 2, 20).cast("bigint")), "n", "anchor", "text", "review").join(said, ["video", "frame"], "left")
    rows = _in_videos(rows.withColumn("own", F.coalesce("texts", F.transform("items", lambda a: a["text"]))), "start_ms", "end_ms", "image_path", "items", "own", "texts")
    samples = F.concat(F.array(stem(F.col("video"))), F.flatten(F.transform("frames", lambda f: F.coalesce(f["texts"], F.array().cast("array<string>")))))
    chinese = has_cjk(F.array_join(samples, "\n"))
    day = F.lit(compiled_on).cast("date")
    head = F.concat(
        F.lit("---\ntype: source\nstatus: draft\naliases: []\nsource_refs:\n  - "),
        "video",
        F.lit("\ntags:\n" + "".join(f"  - {t}\n" for t in NOTE_TAGS) + "confidence: 0.55\nupdated_at: "),
        day.cast("string"),
        F.lit("\nreview_after: "),
        F.date_add(day, 30).cast("string"),
        F.lit("\n" + "".join(f"{c}: []\n" for c in NOTE_LISTS) + "source_kind: extracted\ntraceability_level: anchor\n---\n\n## "),
    )

    def line(a: Column) -> Column:
        return F.concat(F.lit("\n- ["), a["anchor"], F.lit("] "), a["text"])

    def record(f: Column) -> Column:
        top = F.concat(F.format_string("\n\n### E%02d | ", f["frame"]), keywords(f["own"], F.when(chinese, "zh").otherwise("en")), F.lit("\nTime: "), time_span(f["start_ms"], f["end_ms"]))
        return F.concat(top, F.array_join(F.transform(f["items"], line), ""))

    def appendix(f: Column) -> Column:
        top = F.concat(F.format_string("\n\n### Frame %02d\nCovers: ", f["frame"]), time_span(f["start_ms"], f["end_ms"]), F.lit("\nImage: `"), f["image_path"], F.format_string("`\n![Frame %02d](", f["frame"]), f["image_path"], F.lit(")"))
        marked = F.transform(f["items"], lambda a: F.concat(line(a), F.when(a["review"] != "", F.concat(F.lit("\n  Review: "), a["review"])).otherwise("")))
        return F.concat(top, F.array_join(marked, ""))

    text = F.concat(
        head,
        F.when(chinese, "内容记录").otherwise("Content Records"),
        F.array_join(F.transform("frames", record), ""),
        F.lit("\n\n## "),
        F.when(chinese, "锚点附录").otherwise("Anchor Appendix"),
        F.array_join(F.transform("frames", appendix), ""),
        F.lit("\n"),
    )
    return rows.select("video", note_path(F.col("video")).alias("rel_path"), text.alias("text"))


def number_anchors(counts: DataFrame) -> DataFrame:
    """``(video, frame, first_anchor, last_anchor)`` from regions per frame.

    Anchors run on across the frames of a video; an empty frame has one.
    """
    order = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    own = F.greatest("n_regions", F.lit(1))
    last = F.sum(own).over(order).cast("bigint")
    name = lambda n: F.format_string("A%02d", n)
    return counts.select("video", "frame", name(last - own + 1).alias("first_anchor"), name(last).alias("last_anchor"))


def clock(ms: Column) -> Column:
    """Milliseconds as ``HH:MM:SS.mmm``."""
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000).cast("bigint"), F.floor(ms / 60000).cast("bigint") % 60, F.floor(ms / 1000).cast("bigint") % 60, ms % 1000)


def time_token(ms: Column) -> Column:
    """Milliseconds as ``HH-MM-SS-mmm``, for file names."""
    return F.translate(clock(ms), ":.", "--")


def time_span(start: Column, end: Column) -> Column:
    """A stretch of time, or its one point."""
    return F.when(start == end, clock(start)).otherwise(F.concat(clock(start), F.lit("-"), clock(end)))
