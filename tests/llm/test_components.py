"""Connected components against a plain union of sets."""

import random

import numpy as np
import pytest

from notegraph.llm import components as cc
from notegraph.llm.scratch import Scratch


def brute(edges):
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def graphs():
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(300)]
    rng.shuffle(chain)
    hub = [(1000, i) for i in range(200)] + [(i, 1000) for i in range(50)]
    loose = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    return {"none": [], "loops": [(1, 1), (2, 2)], "chain": chain, "hub": hub, "loose": loose * 2, "negative": [(-5, 3), (3, 7), (9, 8)]}


@pytest.mark.parametrize("name", list(graphs()))
def test_components_match_brute_force(spark, name):
    edges = graphs()[name]
    rows = spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)
    found = [(r.id, r.component) for r in cc.components(rows, Scratch(spark)).collect()]
    assert len(found) == len(set(found))
    assert dict(found) == brute(edges)


def test_forest_of_blocks():
    edges = graphs()["loose"]
    u, v = (np.array(x) for x in zip(*[e for e in edges if e[0] != e[1]], strict=True))
    nodes, roots = cc.forest(u, v)
    whole = brute(edges)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {k: r for k, r in whole.items() if k != r}
