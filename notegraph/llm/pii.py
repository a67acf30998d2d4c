"""Personal data: exact base patterns plus boosted trees over candidates.

Base spans (email, ip, card, phone) follow fixed patterns and checks.  Wider
generators propose overlapping candidates that the base misses (obfuscated
addresses, local phone numbers, identity numbers, account numbers); boosted
trees score each by its format and its context, each kind has a threshold
calibrated on held-out findings, and of overlapping candidates the best one
stays.  Everything is one narrow projection of built-in expressions.

The patterns are possessive and guarded by lookbehinds, so that a scan is
linear in the text even for endless runs of digits or letters.

Defined results: null or empty text has no spans; spans are code points, end
exclusive; rows are independent, so ties and repeated rows are scanned each;
other columns pass through, whatever their names; an empty table gives an
empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.text import clusters, free_name, joined_spans, let, replaced, spans
from notegraph.llm.trees import as_vectors, ensemble, weighted_sum

#: The base patterns, in the order in which kinds are listed.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider patterns, proposing candidates of further kinds.
DOT = r"(?:\x20dot\x20|\x20?[(\[]dot[)\]]\x20?)"
WIDER = (
    ("email", rf"(?i)(?<![A-Z0-9._%+-])(?<!\x20dot\x20|[(\[]dot[)\]]|[(\[]dot[)\]]\x20)[A-Z0-9._%+-]++(?:{DOT}[A-Z0-9._%+-]++)*+\x20?(?:[(\[]at[)\]]|\x20at\x20)\x20?[A-Z0-9-]++(?:(?:{DOT}|\.)[A-Z0-9-]{{2,}}+)++", r"(?i)[(\[\x20]at[)\]\x20]"),
    ("phone", r"(?<![\p{L}0-9.+/-])(?<![0-9][\x20.-])(?:\([0-9]{2,5}\)[\x20.-]?|[0-9]{2,5}[\x20.-])[0-9]{2,5}(?:[\x20.-][0-9]{2,5})*+(?![0-9])(?!-[0-9])", r"[0-9]{2}[)\x20.-]{1,2}[0-9]{2}"),
    ("ssn", r"(?<![\p{L}0-9.-])(?<![0-9][\x20.-])[0-9]{3}(?:-[0-9]{2}-|\x20[0-9]{2}\x20)[0-9]{4}(?![\x20-]?[0-9])", r"[0-9][\x20-][0-9]{2}[\x20-][0-9]"),
    ("iban", r"(?<![\p{L}0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
)
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
#: Neighbouring words for and against each kind.
FOR = {
    "email": r"(?i)mail|contact|write|reach|correo|courriel|address",
    "phone": r"(?iu)phone|call|tel\b|tel[:.]|mobile|cell|fax|whatsapp|tel[eé]f|m[oó]vil|appel|reach|contact|ring|dial",
    "ssn": r"(?i)ssn|social|security|taxpayer|identity",
    "iban": r"(?i)iban|bank|account|konto|compte|cuenta|transfer",
}
AGAINST = r"(?i)date|year|between|from|total|price|order|invoice|isbn|version|serial|part|sku|ref|build|page|issue|ticket|model|code|tracking|item|batch|meet|look|arrive"
FEATURES = ("email", "phone", "ssn", "iban", "length", "digits", "groups", "distinct", "parens", "cue_for", "cue_against", "marked", "edge", "zeros", "first", "last", "trunk", "dated", "spelled", "verb")
RAW = "array<struct<kind:string,start:int,end:int,hit:string>>"


@dataclass(frozen=True)
class Boost:
    """Size of the ensemble and how thresholds are calibrated."""

    trees: int = 20
    depth: int = 4
    findings: int = 4000
    precision: float = 0.95
    context: int = 32
    seed: int = 3


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a
        + let(
            F.substring(digits, -i, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
        ),
    )
    return total % 10 == 0


def _ip_ok(hit: Column) -> Column:
    def small(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(short) <= 3) & (F.when(F.length(short) <= 3, short).otherwise("999").cast("int") <= 255)

    return F.forall(F.split(hit, r"\."), small)


def _card_ok(hit: Column) -> Column:
    digits = F.regexp_replace(hit, r"[\x20-]", "")
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


def _phone_ok(hit: Column) -> Column:
    return F.regexp_count(hit, F.lit("[0-9]")).between(9, 15)


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"))).cast(RAW)


def _checked(found: Column, ok) -> Column:
    return F.filter(found, lambda x: ok(x["hit"]))


def _of_kind(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: x["kind"] == kind)


def base_spans(text: Column) -> Column:
    """The checked base spans, by kind as listed, then by start."""
    kinds = (
        ("email", EMAIL, "@", None),
        ("ip", IP, r"[0-9]\.[0-9]", _ip_ok),
        ("card", CARD, "[0-9][\\x20-]?[0-9]", _card_ok),
        ("phone", PHONE, r"\+[0-9]", _phone_ok),
    )
    parts = []
    for kind, pattern, guard, ok in kinds:
        found = _named(spans(text, pattern, guard), kind)
        parts.append(found if ok is None else _checked(found, ok))
    return F.concat(*parts)


def candidates(text: Column) -> Column:
    """What the wider patterns propose, overlaps included; phones have 7 to 12 digits."""
    found = [_named(spans(text, pattern, guard), kind) for kind, pattern, guard in WIDER]
    phones = [i for i, (kind, _, _) in enumerate(WIDER) if kind == "phone"]
    for i in phones:
        found[i] = _checked(found[i], lambda hit: F.regexp_count(hit, F.lit("[0-9]")).between(7, 12))
    return F.concat(*found)


def features(text: Column, x: Column, context: int) -> Column:
    """Numbers about one candidate, by the names in ``FEATURES``."""
    hit, kind = x["hit"], x["kind"]
    before = F.substring(text, F.greatest(x["start"] - context, F.lit(0)) + 1, F.least(x["start"], F.lit(context)))
    after = F.substring(text, x["end"] + 1, 1)
    digits = F.regexp_replace(hit, "[^0-9]", "")

    def yes(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    cue = F.lit(False)
    for name, words in FOR.items():
        cue = cue | ((kind == name) & before.rlike(words))
    return F.struct(
        *[yes(kind == k).alias(k) for k in ("email", "phone", "ssn", "iban")],
        F.length(hit).cast("double").alias("length"),
        F.length(digits).cast("double").alias("digits"),
        F.size(F.split(hit, "[^A-Za-z0-9]+")).cast("double").alias("groups"),
        F.size(F.array_distinct(F.split(digits, ""))).cast("double").alias("distinct"),
        yes(hit.rlike(r"[(\[]")).alias("parens"),
        yes(cue).alias("cue_for"),
        yes(before.rlike(AGAINST)).alias("cue_against"),
        yes(before.rlike(r"[#$€%=/_]\s?$")).alias("marked"),
        yes(after.rlike(r"[\p{L}0-9/_=%]")).alias("edge"),
        yes(digits.rlike("^(?:0{3}|9{3})|0{4}$|^[0-9]{3}00")).alias("zeros"),
        F.length(F.regexp_extract(hit, "[0-9]+", 0)).cast("double").alias("first"),
        F.length(F.regexp_extract(hit, "([0-9]+)[^0-9]*$", 1)).cast("double").alias("last"),
        yes(hit.rlike(r"^\(?0[0-9]|\)")).alias("trunk"),
        yes(hit.rlike(r"^(?:19|20)[0-9]{2}[\x20.-]|^[0-9]{2}[.-][0-9]{2}[.-](?:19|20)[0-9]{2}")).alias("dated"),
        yes(hit.rlike(r"(?i)\x20dot\x20|[(\[]")).alias("spelled"),
        yes(hit.rlike(r"(?i)^(?:look|looking|arrive|arrives|meet|work|works|live|stay|stop|here|is|are|was)\x20at\x20")).alias("verb"),
    )


def labelled_findings(spark: SparkSession, n: int) -> DataFrame:
    """``(text, label, kind, part)``: a synthetic finding a row, half of them true.

    Digits come from hashes of the row number; the words around a value say
    whether it is somebody's number or that of an order, a part or a version.
    """
    i = F.col("id")
    d = F.lpad((F.abs(F.xxhash64(i)) % 10**18).cast("string"), 18, "7")
    cap = F.upper(F.translate(F.substring(F.sha2(i.cast("string"), 256), 1, 2), "0123456789", "QRSTUVWXYZ"))
    name = F.translate(F.substring(F.sha2(F.concat(F.lit("n"), i.cast("string")), 256), F.lit(1), (i % 7 + 4).cast("int")), "0123456789", "ghijklmnop")

    def cut(a: int, b: int) -> Column:
        return F.substring(d, a, b)

    def any_of(salt: int, *options) -> Column:
        return F.get(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(options))).cast("int"))

    def joined(sep: str, *groups: tuple[int, int]) -> Column:
        return F.concat_ws(sep, *[cut(a, n) for a, n in groups])

    area = F.concat(F.lit("("), cut(1, 3), F.lit(") "))
    trunk = F.concat(F.lit("0"), cut(1, 2))
    phone = any_of(7, F.concat(area, joined("-", (4, 3), (7, 4))), joined("-", (1, 3), (4, 3), (7, 4)), joined(".", (1, 3), (4, 3), (7, 4)), joined(" ", (1, 3), (4, 3), (7, 4)), F.concat(trunk, F.lit(" "), joined(" ", (3, 4), (7, 4))), F.concat(trunk, F.lit(" "), joined(" ", (3, 2), (5, 2), (7, 2), (9, 2))), F.concat(area, cut(4, 7)))
    ssn = any_of(8, joined("-", (1, 3), (4, 2), (6, 4)), joined(" ", (1, 3), (4, 2), (6, 4)))
    iban = any_of(9, F.concat(cap, cut(1, 2), F.lit(" "), joined(" ", (3, 4), (7, 4), (11, 4), (15, 4))), F.concat(cap, cut(1, 18)))
    top = any_of(10, "com", "org", "net", "co")
    local = any_of(11, name, F.concat(name, F.lit(" dot "), F.reverse(name)), F.substring(name, 1, 1), F.repeat(name, 12))
    mail = any_of(12, F.concat(local, F.lit(" (at) "), name, F.lit(" (dot) "), top), F.concat(local, F.lit("[at]"), name, F.lit("."), top), F.concat(local, F.lit(" at "), name, F.lit(" dot "), top), F.concat(local, F.lit("(at)"), name, F.lit("[dot]"), top))
    dated = any_of(13, F.concat(F.lit("20"), joined("-", (1, 2), (3, 2), (5, 2))), F.concat(joined(".", (1, 2), (3, 2)), F.lit(".20"), cut(5, 2)), F.concat(F.lit("19"), cut(1, 2), F.lit(" 20"), cut(3, 2)))
    # a few findings have no word that tells, and a few words mislead
    true = [F.concat(any_of(14, "call me at ", "my phone: ", "reach us on ", "móvil ", "tel. ", "dial ", "and so "), phone)] * 3 + [F.concat(any_of(15, "her ssn is ", "social security number ", "identity no. "), ssn)] * 2 + [F.concat(any_of(16, "bank account ", "pay to IBAN ", "konto ", "to "), iban)] * 2 + [F.concat(any_of(17, "mail me: ", "contact ", "write to ", "it was "), mail)] * 3
    false = [F.concat(any_of(18, "order no. ", "part ", "version ", "item ", "and so ", "tracking code "), phone)] * 2 + [F.concat(any_of(19, "on ", "the date ", "since ", "between "), dated)] * 2 + [F.concat(any_of(20, "sizes ", "pages ", "rows ", "the numbers "), joined(" ", (1, 2), (3, 2), (5, 2), (7, 2)))] + [F.concat(any_of(21, "serial ", "it was ", "part #", "model "), ssn)] * 2 + [F.concat(any_of(22, "tracking code ", "ref ", "batch "), iban)] * 2
    false += [F.concat(any_of(23, "we ", "they ", "please "), any_of(24, "look", "arrive", "meet", "live", "stop"), F.lit(" at "), name, F.lit("."), top)] * 2
    pick = F.pmod(F.xxhash64(i, F.lit(5)), F.lit(len(true) * len(false))).cast("int")
    text = F.when(i % 2 == 0, F.get(F.array(*true), pick % len(true))).otherwise(F.get(F.array(*false), pick % len(false)))
    kinds = F.array(*map(F.lit, ["phone"] * 3 + ["ssn"] * 2 + ["iban"] * 2 + ["email"] * 3))
    return spark.range(n).select(F.concat(F.lit("so the text says "), text, F.lit(" and more")).alias("text"), (1 - i % 2).cast("double").alias("label"), F.get(kinds, pick % len(true)).alias("kind"), (F.pmod(F.xxhash64(i, F.lit(6)), F.lit(4))).alias("part"))


def _precision(scores: list, at: float) -> float:
    taken = [y for s, y in scores if s >= at]
    return sum(taken) / len(taken) if taken else 0.0


def fit(findings: DataFrame, b: Boost) -> tuple[list[tuple[float, list[str]]], dict[str, float]]:
    """Trees and a threshold for each kind, from ``(text, label, kind, part)``.

    A candidate of another kind than a true finding's is a false one.  Rows of part 0 are held out of the trees; on them a kind's threshold is
    the lowest score of 0.5 or more at which the wanted precision is met.
    """
    found = findings.select("text", "label", "kind", "part", F.explode(candidates(F.col("text"))).alias("x"))
    found = found.withColumn("label", F.when(F.col("x.kind") == F.col("kind"), F.col("label")).otherwise(0.0))
    rows = found.select("label", "part", F.col("x.kind").alias("kind"), features(F.col("text"), F.col("x"), b.context).alias("f")).select("label", "part", F.col("kind").alias("of"), "f.*")
    trainer = GBTRegressor(maxIter=b.trees, maxDepth=b.depth, stepSize=0.3, seed=b.seed, checkpointInterval=-1)
    trees = ensemble(trainer.fit(as_vectors(rows.where("part <> 0"), FEATURES).coalesce(1)))
    held = rows.where("part = 0").select("of", "label", F.round(weighted_sum(trees, [F.col(c) for c in FEATURES]), 3).alias("score"))
    limits = {}
    for kind, scores in held.groupBy("of").agg(F.collect_list(F.struct("score", "label"))).collect():
        limits[kind] = next((at for at in sorted({max(s, 0.5) for s, _ in scores}) if _precision(scores, at) >= b.precision), float("inf"))
    return trees, limits


def _overlaps(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def selected(text: Column, base: Column, trees: list[tuple[float, list[str]]], limits: dict[str, float], b: Boost) -> Column:
    """Candidates over their threshold that overlap no base span.

    Where candidates overlap, the one with the highest margin stays, ties
    going to the earlier, then the longer, then the first kind by name.
    """

    def margin(x: Column) -> Column:
        score = let(features(text, x, b.context), lambda v: weighted_sum(trees, [v[n] for n in FEATURES]))
        at = F.lit(float("inf"))
        for kind, level in limits.items():
            at = F.when(x["kind"] == kind, F.lit(level)).otherwise(at)
        return score - at

    scored = F.transform(candidates(text), lambda x: F.struct((-margin(x)).alias("m"), x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"), x["end"].alias("end"), x["hit"].alias("hit")))
    good = F.filter(scored, lambda x: (x["m"] <= 0) & ~F.exists(base, lambda y: _overlaps(x, y)))
    by_start = F.array_sort(F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["back"].alias("back"), x["m"].alias("m"), x["kind"].alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"))))

    def best(group: Column) -> Column:
        ordered = F.array_sort(F.transform(group, lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), x["back"].alias("back"), x["kind"].alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"))))
        return F.aggregate(
            ordered,
            F.array().cast(RAW),
            lambda a, x: F.when(F.exists(a, lambda y: _overlaps(x, y)), a).otherwise(F.concat(a, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"))))),
        )

    return F.flatten(F.transform(clusters(by_start), best))


def find(docs: DataFrame, model: tuple[list[tuple[float, list[str]]], dict[str, float]], text_col: str = "text", b: Boost = Boost(), names: tuple[str, str, str] = ("base", "more", "spans")) -> DataFrame:
    """Add the ``names``: base spans, selected ones, and both in listed order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, more, every = names
    out = docs.withColumn(base, base_spans(text))
    out = out.withColumn(more, F.when(text.rlike(r"[0-9]{2}|(?i:[\x20(\[]at[\x20)\]])"), selected(text, F.col(base), *model, b)).otherwise(F.array().cast(RAW)))
    both = F.concat(base, more)
    return out.withColumn(every, F.when(F.size(more) == 0, F.col(base)).otherwise(F.concat(*[F.array_sort(_of_kind(both, k)) for k in KINDS])))


def redact(docs: DataFrame, model: tuple[list[tuple[float, list[str]]], dict[str, float]], text_col: str = "text", b: Boost = Boost()) -> DataFrame:
    """The documents with each span replaced by its kind in brackets.

    Of overlapping base spans of different kinds the first and longest is
    the one whose label is put.
    """
    names = tuple(free_name(docs, n) for n in ("base", "more", "spans"))
    ordered = F.array_sort(F.transform(names[2], lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"), x["end"].alias("end"))))
    kind = "array<struct<kind:string,start:int,end:int>>"

    def first(group: Column) -> Column:
        return F.aggregate(
            group,
            F.array().cast(kind),
            lambda a, x: F.when(F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(0)) > x["start"], a).otherwise(F.concat(a, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))),
        )

    disjoint = F.flatten(F.transform(clusters(ordered), first))
    out = find(docs, model, text_col, b, names)
    return out.withColumn(text_col, replaced(F.col(text_col), disjoint, lambda x: F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))).select(*docs.columns)


def digest(docs: DataFrame, b: Boost = Boost()) -> DataFrame:
    """The rows of the ``op4`` query."""
    model = fit(labelled_findings(docs.sparkSession, b.findings), b)
    out = find(docs.select("doc_id", "text"), model, b=b)
    counts = [F.size(_of_kind(F.col("base"), k)).cast("bigint").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), F.size("more").cast("bigint").alias("n_added"))
