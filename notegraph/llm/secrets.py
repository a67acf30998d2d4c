"""Secret scanning with a random forest against false positives.

High-recall patterns propose candidate strings; a forest trained on labelled
findings scores each by its length, character transitions, dictionary
coverage, path form and neighbouring words.  Scanning, features, forest and
redaction are one narrow projection of built-in expressions.

Dictionary coverage counts the corpus's own most frequent words.  Every
candidate is scored, however long and wherever it overlaps; those over
the threshold are united where they overlap, so no part of a secret is left.

Defined results: null or empty text has no candidates; rows are independent,
so ties and repeated rows are scanned each; other columns pass through,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.text import clusters, free_name, joined_spans, let, replaced, spans
from notegraph.llm.trees import as_vectors, ensemble, weighted_sum

#: Formats of credentials, by name.
CUES = r"password|passwd|passwort|passphrase|pwd|kennwort|contrase(?:ña|na)|clave|senha|mot[\x20_]de[\x20_]passe|mdp|пароль|密码|パスワード|secret|token|api[_-]?key|access[_-]?key|auth"
KEYED = rf"""(?iu)(?<![\p{{L}}\p{{N}}])(?:{CUES})["']?[\x20\t]*+[:=][\x20\t]*+["']?([^\s"',;&<>]{{3,}}+)"""
IN_URL = r"(?i)(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s/:@]*+:([^\s/@]++)@"
OPAQUE = r"(?:(?<![A-Za-z0-9_+/.-])|(?<=\.[a-z]{2,10}/))(?=[A-Za-z_+/-]*+[0-9]|[A-Z_+/-]*+[a-z_+/-]++[A-Z]|[a-z]{24})[A-Za-z0-9_+/-]{16,}+={0,2}"
TOKEN = r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++"
PEM = r"-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z0-9]++ )*?PRIVATE KEY-----"
CUT_PEM = r"-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY-----(?:\s?[A-Za-z0-9+/=]){16,}+"
PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|sk-|sk_live_|xox[abprs]-|AIza|eyJ|glpat-|npm_)"
#: Neighbouring words that speak for and against a secret.
FOR = rf"(?iu){CUES}|credential|bearer|private"
AGAINST = r"(?i)commit|sha-?\d*\b|checksum|digest|md5|uuid|guid|revision|build|version|example|sample|dummy|placeholder|isbn|integrity|blob|etag"
#: Words that identifiers and placeholders are made of.
DICTIONARY = tuple(
    "access admin alpha application array auth base beta block button cache change changeme char check class client code color config connection content context count create current data date default delete demo design document domain download element email error event example field file filter final folder format function global group handler header height host image index info input integer invalid item json kernel label language layout length level library line link list local login main manager message method mode model module name network node null number object option order output package page panel parameter parent password path pattern placeholder point position post prefix private process product profile project property public query random record release remote replace report request response result return root sample schema script search secret section select server service session setting size source start state static status storage stream string style success suffix system table target template test text thread time title token type update upload user utility value variable version video view widget width window worker your".split()
)
FEATURES = ("length", "transitions", "digits", "uppers", "hexed", "distinct", "coverage", "path", "dots", "cue_for", "cue_against", "assigned", "known", "quoted", "in_url", "empty")
RAW = "array<struct<start:int,end:int,hit:string>>"


@dataclass(frozen=True)
class Forest:
    """Size of the forest and the score from which a candidate is a secret."""

    trees: int = 20
    depth: int = 5
    threshold: float = 0.5
    findings: int = 4000
    context: int = 40
    words: int = 4000
    least: int = 10
    seed: int = 5


def dictionary(docs: DataFrame, f: Forest = Forest(), text_col: str = "text") -> str:
    """The most frequent words of the whole corpus and those of ``DICTIONARY``, between blanks.

    At most ``words`` words of three letters or more that occur ``least``
    times or more, ties by the word.
    """
    each = F.explode(F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+"), lambda w: F.length(w).between(3, 24))).alias("word")
    top = docs.select(each).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= f.least).orderBy(F.desc("n"), "word").limit(f.words)
    return f" {' '.join(sorted({r['word'] for r in top.collect()} | set(DICTIONARY)))} "


#: The words of ``DICTIONARY`` alone, for texts without a corpus.
KNOWN = f" {' '.join(DICTIONARY)} "


def candidates(text: Column) -> Column:
    """Candidate spans of every generator, by start, overlaps included."""
    text = F.coalesce(text, F.lit(""))

    def value(pattern: str, tail: int) -> Callable[[Column], Column]:
        def part(x: Column) -> Column:
            hit = F.regexp_extract(x["hit"], pattern, 1)
            return F.struct((x["end"] - F.length(hit) - tail).alias("start"), (x["end"] - tail).alias("end"), hit.alias("hit"))

        return part

    keyed = F.concat(F.transform(spans(text, KEYED, "[:=]"), value(KEYED, 0)), F.transform(spans(text, IN_URL, "://"), value(IN_URL, 1)))
    opaque = spans(text, OPAQUE, r"[A-Za-z0-9_+/-]{16}")
    token = spans(text, TOKEN, "eyJ")
    pem = F.concat(spans(text, PEM, "PRIVATE KEY-----[\\s\\S]*-----END"), spans(text, CUT_PEM, "PRIVATE KEY"))
    return F.array_sort(F.array_distinct(F.concat(keyed, opaque, token, pem))).cast(RAW)


def features(text: Column, x: Column, context: int, known_words: str = KNOWN) -> Column:
    """Numbers about one candidate, by the names in ``FEATURES``."""
    hit = x["hit"]
    before = F.substring(text, F.greatest(x["start"] - context, F.lit(0)) + 1, F.least(x["start"], F.lit(context)))
    after = F.substring(text, x["end"] + 1, 8)
    n = F.greatest(F.length(hit), F.lit(1)).cast("double")
    # one letter for each class of character, so that a transition is a
    # place where two letters differ
    form = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "_+/-=.", "______")
    runs = F.length(F.regexp_replace(form, r"(.)\1*+", "x")).cast("double")
    letters = F.filter(F.split(F.lower(F.regexp_replace(hit, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+"), lambda w: F.length(w) >= 3)
    known = F.aggregate(F.filter(letters, lambda w: F.lit(known_words).contains(F.concat(F.lit(" "), w, F.lit(" ")))), F.lit(0), lambda a, w: a + F.length(w)).cast("double")

    def yes(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    return F.struct(
        n.alias("length"),
        (runs / n).alias("transitions"),
        (F.regexp_count(hit, F.lit("[0-9]")) / n).alias("digits"),
        (F.regexp_count(hit, F.lit("[A-Z]")) / n).alias("uppers"),
        yes(hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hexed"),
        F.size(F.array_distinct(F.split(hit, ""))).cast("double").alias("distinct"),
        (known / n).alias("coverage"),
        yes(before.rlike(r"[/\\.~]$|://\S*$") | hit.rlike(r"/[^/]+/|\.[a-z]{1,4}$") | after.rlike(r"^[/\\]|^\.[a-z]{1,4}\b")).alias("path"),
        F.regexp_count(hit, F.lit("[./_-]")).cast("double").alias("dots"),
        yes(before.rlike(FOR)).alias("cue_for"),
        yes(before.rlike(AGAINST) | hit.rlike("(?i)example|xxxx|your")).alias("cue_against"),
        yes(before.rlike(r"[:=]\s*[\"']?$")).alias("assigned"),
        yes(hit.rlike(PREFIX) | hit.startswith("-----BEGIN")).alias("known"),
        yes(before.rlike("[\"']$")).alias("quoted"),
        yes(before.rlike(r"://[^\s/@]*$") & after.startswith("@")).alias("in_url"),
        yes(hit.rlike(r"(?i)^[<{$%(\[]|^(?:none|null|true|false|undefined|changeme|secret|password|token|value|string)$|\(\)$|\*\*\*")).alias("empty"),
    )


def labelled_findings(spark: SparkSession, n: int) -> DataFrame:
    """``(text, label)``: one synthetic finding a row, half of them secrets.

    Random strings come from hashes of the row number.  Secrets are opaque
    strings after a credential word or with an issuer's prefix; the others
    are what scanners report by mistake: digests, identifiers, paths,
    placeholders, versions and long words with digits.
    """
    i = F.col("id")
    hexed, more = F.sha2(i.cast("string"), 256), F.sha2(F.concat(F.lit("b"), i.cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(hexed)), "[+/=]", "Q")
    upper = F.upper(F.regexp_replace(F.base64(F.unhex(more)), "[+/=]", "Z"))
    word = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(i), F.lit(len(DICTIONARY))) + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(i, F.lit(1)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    third = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(i, F.lit(2)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    size = F.pmod(F.xxhash64(i, F.lit(3)), F.lit(25)).cast("int")
    true = (
        F.concat(F.lit('token = "'), F.substring(hexed, 1, 40), F.lit('"')),
        F.concat(F.lit("password="), F.substring(hexed, F.lit(1), size + 10)),
        F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)),
        F.concat(F.lit("the key is ghp_"), F.substring(mixed, 1, 36)),
        F.concat(F.lit("api_key: "), F.substring(mixed, F.lit(1), size + 16)),
        F.concat(F.lit("secret: "), F.substring(mixed, F.lit(1), size + 12)),
        F.concat(F.lit("sk-"), F.substring(mixed, 1, 40)),
        F.concat(F.lit("Bearer eyJ"), mixed),
        F.concat(F.lit("passwd='"), F.substring(mixed, F.lit(1), size % 10 + 8), F.lit("'")),
        F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), mixed, F.lit("\n-----END PRIVATE KEY-----")),
        F.concat(F.lit("password="), word, other, third),
        F.concat(F.lit("contraseña: "), word, (size + 10).cast("string")),
        F.concat(F.lit("pwd="), F.substring(mixed, F.lit(1), size % 4 + 3)),
        F.concat(F.lit("postgres://"), word, F.lit(":"), F.substring(mixed, F.lit(1), size % 12 + 5), F.lit("@"), other, F.lit(".local/db")),
        F.concat(F.lit("mysql://root:"), word, other, F.lit("@"), third),
        F.concat(F.lit("https://hooks."), word, F.lit(".com/services/T"), F.substring(upper, 1, 8), F.lit("/B"), F.substring(upper, 9, 8), F.lit("/"), F.substring(mixed, 1, 24)),
        F.concat(F.lit("secret key "), F.translate(F.substring(hexed, 1, 32), "0123456789", "ghijklmnop")),
    )
    false = (
        F.concat(F.lit("fixed in commit "), F.substring(hexed, 1, 40)),
        F.concat(F.lit("sha256 checksum "), hexed),
        F.concat(F.lit("uuid "), F.substring(hexed, 1, 8), F.lit("-"), F.substring(hexed, 9, 4), F.lit("-"), F.substring(hexed, 13, 4), F.lit("-"), F.substring(hexed, 17, 12)),
        F.concat(F.lit("see https://host/"), word, F.lit("/"), other, F.lit("/"), F.substring(hexed, 1, 20)),
        F.concat(F.lit("/usr/"), word, F.lit("/"), other, F.lit("_"), third, F.lit("2")),
        F.concat(F.lit("password=<"), word, F.lit(">")),
        F.concat(F.lit("password: "), F.element_at(F.array(*map(F.lit, ("none", "null", "changeme", "${PASSWORD}", "getenv()", "true", "********"))), (size % 7 + 1).cast("int"))),
        F.concat(F.lit("token = "), word, F.initcap(other), F.initcap(third), F.lit("()")),
        F.concat(F.lit("http://"), word, F.lit(":80/"), other, F.lit("@2x")),
        F.concat(F.lit("https://www."), word, F.lit(".org/"), other, F.lit("/"), third, F.lit("-"), word, F.lit("-2024")),
        F.concat(word, other, third, word),
        F.concat(F.lit("api_key: your-"), word, F.lit("-here-"), other),
        F.concat(word, other, F.lit("_"), third, F.lit("_v2_"), (size + 1).cast("string")),
        F.concat(F.lit("order "), F.lpad((F.abs(F.xxhash64(i, F.lit(4))) % 10**16).cast("string"), 18, "1")),
        F.concat(F.lit("secret = xxxxxxxxxxxxxxxx"), (size % 10).cast("string")),
        F.concat(F.lit("20240101-"), word, F.lit("-"), other, F.lit("-build"), (size + 1).cast("string")),
    )
    pick = F.pmod(F.xxhash64(i, F.lit(5)), F.lit(len(true) * len(false))).cast("int")
    text = F.when(i % 2 == 0, F.get(F.array(*true), pick % len(true))).otherwise(F.get(F.array(*false), pick % len(false)))
    return spark.range(n).select(F.concat(F.lit("in the notes "), text, F.lit(" and more")).alias("text"), (1 - i % 2).cast("double").alias("label"))


def fit(findings: DataFrame, f: Forest, known_words: str = KNOWN) -> list[tuple[float, list[str]]]:
    """Trees fitted on ``(text, label)`` rows, one finding each."""
    found = findings.select("text", "label", F.explode(candidates(F.col("text"))).alias("x"))
    rows = found.select("label", features(F.col("text"), F.col("x"), f.context, known_words).alias("f")).select("label", "f.*")
    trainer = RandomForestRegressor(numTrees=f.trees, maxDepth=f.depth, seed=f.seed, featureSubsetStrategy="onethird", subsamplingRate=0.8)
    return ensemble(trainer.fit(as_vectors(rows, FEATURES).coalesce(1)))


def scored(text: Column, trees: list[tuple[float, list[str]]], f: Forest, known_words: str = KNOWN) -> Column:
    """Candidates of a text with the forest's score."""
    text = F.coalesce(text, F.lit(""))
    total = sum(w for w, _ in trees)

    def score(v: Column) -> Column:
        return weighted_sum(trees, [v[name] for name in FEATURES]) / total

    return F.transform(
        candidates(text),
        lambda x: F.struct(F.lit("secret").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), let(features(text, x, f.context, known_words), score).alias("score")),
    )


def united(found: Column, f: Forest) -> Column:
    """Candidates over the threshold, united where they overlap."""
    good = F.filter(found, lambda x: x["score"] >= f.threshold)
    whole = F.transform(clusters(good), lambda g: F.struct(F.lit("secret").alias("kind"), g[0]["start"].alias("start"), F.array_max(F.transform(g, lambda x: x["end"])).alias("end")))
    return F.when(F.size(good) > 0, whole).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))


def scan(docs: DataFrame, trees: list[tuple[float, list[str]]], text_col: str = "text", f: Forest = Forest(), names: tuple[str, str] = ("found", "secrets"), known_words: str = KNOWN) -> DataFrame:
    """Add the two ``names``: every candidate, and the spans that are secrets."""
    return docs.withColumn(names[0], scored(F.col(text_col), trees, f, known_words)).withColumn(names[1], united(F.col(names[0]), f))


def redact(docs: DataFrame, trees: list[tuple[float, list[str]]], text_col: str = "text", f: Forest = Forest(), known_words: str = KNOWN) -> DataFrame:
    """The documents with each secret replaced by ``<SECRET>``."""
    names = free_name(docs, "found"), free_name(docs, "secrets")
    clean = replaced(F.col(text_col), F.col(names[1]), lambda x: F.lit("<SECRET>"))
    return scan(docs, trees, text_col, f, names, known_words).withColumn(text_col, clean).select(*docs.columns)


def digest(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """One row per document: candidates, secrets and where they are."""
    known_words = dictionary(docs, f)
    trees = fit(labelled_findings(docs.sparkSession, f.findings), f, known_words)
    out = scan(docs.select("doc_id", "text"), trees, f=f, known_words=known_words)
    return out.select(
        "doc_id",
        F.size("found").cast("bigint").alias("n_candidates"),
        F.size("secrets").cast("bigint").alias("n_secrets"),
        joined_spans(F.col("secrets")).alias("spans"),
        F.array_max(F.transform("found", lambda x: x["score"])).alias("top_score"),
    )
