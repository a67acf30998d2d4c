"""The training-text pipeline: five stages over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it
keeps, with the columns of ``documents``; the last one adds the mixture
rates.  ``run`` writes each stage's result as Parquet into the session's
shared folder and reads it again, so a lost executor costs one stage at most.

Defined results: a stage given an empty table returns an empty one; null
texts have no words and go in the first stage; rows that agree in id and
text are copies of one another, and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm import decontaminate, minhash, mixing, quality_rules, secrets
from notegraph.llm.scratch import Scratch

#: Near duplicates share 0.8 of their five-word shingles; 25 bands of 5 values
#: link them with probability 0.99995.
NEAR = minhash.MinMax(words=5, percent=80, permutations=64, rows=5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without their failing lines."""
    return quality_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    forest = secrets.Forest()
    known = secrets.dictionary(docs, forest)
    trees = secrets.fit(secrets.labelled_findings(spark, forest.findings), forest, known)
    return secrets.redact(docs, trees, f=forest, known_words=known)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their rates; those of rate 0 go."""
    labelled = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, labelled, TARGETS).where(F.col("mix_rate") > 0)


#: Shares of expected tokens asked of the last stage; poor documents are gone.
TARGETS = {"plain": 0.95, "toxic": 0.05}

STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
]

#: Trained models and near-duplicate components are beyond SQL; the stages
#: are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
