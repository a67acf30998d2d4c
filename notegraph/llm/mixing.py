"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table gives each document posterior
probabilities of the domains.  Nonnegative document rates are then fitted by
projected-gradient least squares, so that the expected number of tokens of
each domain (rate x tokens x posterior, summed) meets its target.

A gradient needs only the domains' token totals, so one iteration is one
aggregation of the small (tokens, posteriors) table; a document's rate is
the projected sum of the steps so far, an expression over a literal array.
Only the totals, one number for each domain, reach the driver.

Defined results: null or empty text has no tokens, a rate as its posteriors
demand, and no weight in the totals; a domain without labelled rows takes no
part and its target is spread over the others; with fewer than two labelled
domains all rates are 1; repeated rows get the same rate; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.llm.scratch import Scratch
from notegraph.llm.text import words


@dataclass(frozen=True)
class Mixture:
    """Size of the classifier's sample and features, and the steps."""

    sample: int = 4000
    features: int = 8192
    iterations: int = 60
    step: float = 1.0
    tolerance: float = 1e-4


def _vectors(docs: DataFrame, m: Mixture) -> DataFrame:
    counted = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=m.features).transform(docs.withColumn("__words", words(F.col("text"))))
    return Normalizer(inputCol="__counts", outputCol="__features", p=2.0).transform(counted)


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], m: Mixture) -> DataFrame:
    """Add ``n_tokens`` and ``posterior`` (by the order of ``domains``).

    ``labelled`` has ``(doc_id, domain)``; at most ``sample`` of its rows, in
    the order of a hash of the id, are fitted.
    """
    place = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    chosen = labelled.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(m.sample)
    # bounded by ``sample``, so that the documents are filtered where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", place.cast("double").alias("label"))), "doc_id")
    train = _vectors(rows, m).select(F.col("__features").alias("features"), "label").coalesce(8).cache()
    model = LogisticRegression(maxIter=30, regParam=1e-4, family="multinomial", probabilityCol="__p").setFeaturesCol("features").fit(train)
    train.unpersist()
    scored = model.setFeaturesCol("__features").transform(_vectors(docs, m))
    return scored.withColumn("n_tokens", F.size("__words").cast("bigint")).withColumn("posterior", F.concat(vector_to_array("__p"), F.array_repeat(F.lit(0.0), len(domains) - model.numClasses)))


def _rate(posterior: Column, steps: list[list[float]]) -> Column:
    """The projected sum of the steps, from a rate of 1."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*[F.array(*map(F.lit, s)) for s in steps])

    def dot(s: Column) -> Column:
        return F.aggregate(F.zip_with(posterior, s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)

    return F.aggregate(table, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def fit_rates(soft: DataFrame, shares: list[float], m: Mixture) -> list[list[float]]:
    """Steps whose projected sum is each document's rate.

    Minimises the squared relative misses of the domains' token totals.  The
    gradient is scaled by each document's tokens and by the domains' totals
    (a diagonal metric, in which projecting to nonnegative rates is still
    exact); the step halves whenever the misses grow.
    """
    k = len(shares)
    base = soft.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * F.col("posterior")[i]) for i in range(k)]).first()
    total = float(base[0] or 0)
    if not total:
        return []
    have = [max(float(x), 1e-9 * total) for x in base[1:]]
    want = [s / sum(shares) * total for s in shares]
    steps: list[list[float]] = []
    step, last = m.step, float("inf")
    sums = have
    for _ in range(m.iterations):
        miss = [(s - w) / total for s, w in zip(sums, want, strict=True)]
        size = sum(x * x for x in miss) ** 0.5
        if size < m.tolerance:
            break
        if size > last:
            step /= 2
        last = size
        steps.append([step * x * total / h for x, h in zip(miss, have, strict=True)])
        rate = _rate(F.col("posterior"), steps)
        weighted = soft.select(F.col("posterior"), (rate * F.col("n_tokens")).alias("t"))
        sums = [float(x) for x in weighted.agg(*[F.sum(F.col("t") * F.col("posterior")[i]) for i in range(k)]).first()]
    return steps


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], m: Mixture = Mixture(), carry: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``mix_tokens``, ``mix_p_<domain>`` and ``mix_rate``.

    ``carry`` names the columns of ``docs`` to return (all if None); columns
    of the four new names are replaced.  The scored table is written once, so
    that the iterations read only its two small columns.
    """
    names = sorted(targets)
    new = ["mix_tokens", *[f"mix_p_{d}" for d in names], "mix_rate"]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in new]
    seen = labelled.where(F.col("domain").isin(*names)).join(docs.select("doc_id"), "doc_id", "left_semi")
    present = {r[0] for r in seen.select("domain").distinct().collect()}
    domains = [d for d in names if d in present]
    if len(domains) < 2:
        count = F.size(words(F.col("text"))).cast("bigint").alias("mix_tokens")
        return docs.select(*kept, count, *[F.lit(1.0 if d in present else 0.0).alias(f"mix_p_{d}") for d in names], F.lit(1.0).alias("mix_rate"))
    packed = docs.select(F.struct(*kept).alias("__row"), F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession)
    soft = scratch.keep(posteriors(packed, labelled, domains, m).select("__row", "n_tokens", "posterior"), "soft")
    steps = fit_rates(soft, [targets[d] for d in domains], m)
    shares = [(F.col("posterior")[domains.index(d)] if d in domains else F.lit(0.0)).alias(f"mix_p_{d}") for d in names]
    return soft.select("__row.*", F.col("n_tokens").alias("mix_tokens"), *shares, _rate(F.col("posterior"), steps).alias("mix_rate"))


#: Shares of expected tokens that the registered query and the pipeline ask for.
TARGETS = {"plain": 0.9, "poor": 0.08, "toxic": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` from the quality and toxicity labels."""
    return labels.where("quality is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("plain").alias("domain"))
