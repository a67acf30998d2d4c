"""Fitted trees of ``pyspark.ml`` as column expressions.

A fitted ensemble becomes a sum of nested CASE expressions, so that scoring
is part of the projection that holds the candidates: no model object reaches
a task, and rows need not be exploded and gathered again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tree(lines: list[str], features: Sequence[Column]) -> Column:
    """The expression of one tree's indented description; eats its lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    _, _, index, _, limit = line.replace("(", "").replace(")", "").split()
    yes = _tree(lines, features)
    lines.pop(0)  # the Else line of the same test
    no = _tree(lines, features)
    return F.when(features[int(index)] <= float(limit), yes).otherwise(no)


def ensemble(model) -> list[tuple[float, list[str]]]:
    """Weight and description of each tree of a fitted model."""
    return [(float(w), t.toDebugString.splitlines()[1:]) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def weighted_sum(trees: list[tuple[float, list[str]]], features: Sequence[Column]) -> Column:
    """The trees' weighted sum for one row's features."""
    out = F.lit(0.0)
    for weight, lines in trees:
        out = out + weight * _tree(list(lines), features)
    return out


def as_vectors(examples: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(features, label)`` as the trainers take them."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(examples).select("features", F.col("label").cast("double").alias("label"))
