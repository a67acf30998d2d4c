from pyspark.sql import functions as F

from notegraph.llm import mixing

A, B = "apple pear plum cherry fig", "bolt nut screw nail rivet"


def table(n_a, n_b):
    return [(i, (A + " ") * (1 + i % 4)) for i in range(n_a)] + [(1000 + i, (B + " ") * (1 + i % 3)) for i in range(n_b)]


def test_expected_token_shares_meet_targets(spark, docs_of):
    docs = docs_of(table(160, 40) + [(5000, None), (5001, ""), (0, A + " ")])
    labelled = docs.where("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") < 1000, "a").otherwise("b").alias("domain"))
    out = mixing.mix(docs, labelled, {"a": 0.3, "b": 0.7})
    assert out.columns == [*docs.columns, "mix_tokens", "mix_p_a", "mix_p_b", "mix_rate"]
    assert out.count() == 203
    share = out.agg((F.sum(F.expr("mix_rate * mix_tokens * mix_p_b")) / F.sum(F.expr("mix_tokens"))).alias("b"), F.min("mix_rate").alias("low")).first()
    assert abs(share.b - 0.7) < 0.01 and share.low >= 0
    assert out.where("doc_id between 1 and 150 and mix_p_a < 0.7").count() == 0


def test_unreachable_target_keeps_rates_nonnegative(spark, docs_of):
    docs = docs_of(table(100, 50))
    labelled = docs.select("doc_id", F.when(F.col("doc_id") < 1000, "a").otherwise("b").alias("domain"))
    out = mixing.mix(docs, labelled, {"a": 0.0, "b": 1.0}, carry=["doc_id"])
    low, high = out.agg(F.min("mix_rate"), F.max("mix_rate")).first()
    assert 0 <= low < 0.01 and high > 1


def test_one_or_no_domain_and_empty_tables(spark, docs_of):
    docs = docs_of(table(4, 0))
    labelled = docs.select("doc_id", F.lit("a").alias("domain"))
    for some in (labelled, labelled.where("false"), labelled.withColumn("domain", F.lit(None).cast("string"))):
        assert {r.mix_rate for r in mixing.mix(docs, some, {"a": 0.5, "b": 0.5}).collect()} == {1.0}
    assert mixing.mix(docs_of([]), labelled, {"a": 0.5, "b": 0.5}).count() == 0
    clash = docs.withColumn("mix_rate", F.lit("x")).withColumn("posterior", F.lit("x"))
    assert mixing.mix(clash, labelled, {"a": 0.5, "b": 0.5}).where("posterior = 'x' and mix_rate = 1").count() == 4


def test_rates_against_plain_projected_gradient(spark):
    """The rates are those of numpy's projected gradient over all documents, and the targets are met."""
    import numpy as np

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(docs, mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet")), mixing.TARGETS, carry=["doc_id"]).toPandas()
    p, t = out[[f"mix_p_{d}" for d in sorted(mixing.TARGETS)]].to_numpy(), out["mix_tokens"].to_numpy(float)
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-9 and docs.count() == len(out)
    m, total, have = mixing.Mixture(), t.sum(), p.T @ t
    want = np.array([mixing.TARGETS[d] for d in sorted(mixing.TARGETS)]) * total
    rate, step, last = np.ones(len(t)), m.step, np.inf
    for _ in range(m.iterations):
        miss = (p.T @ (t * rate) - want) / total
        size = np.linalg.norm(miss)
        if size < m.tolerance:
            break
        step, last = (step / 2 if size > last else step), size
        rate = np.maximum(0, rate - p @ (step * miss * total / have))
    assert np.abs(rate - out["mix_rate"].to_numpy()).max() < 1e-6
    assert np.abs(p.T @ (t * rate) - want).max() / total < 0.01
