import random

import numpy as np
import pytest

from tallyspark.llm.components import components, stars


def brute(edges):
    of = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                of[k] = x
    return {k: min(v) for k, v in of.items()}


def graphs():
    rng = random.Random(5)
    chain = list(range(-60, 60))
    rng.shuffle(chain)
    return {
        "none": [],
        "null and equal ends": [(None, 1), (2, None), (3, 3), (5, 4), (4, 5), (5, 4)],
        "hub in the middle": [(50, i) for i in range(100)] + [(1000, 99), (1000, 1001)],
        "chain": list(zip(chain, chain[1:], strict=False)),
        "random": [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(170)],
        "far apart": [(-(2**63), 2**63 - 1), (2**63 - 1, 0)],
    }


@pytest.mark.parametrize("name,task_edges,hubs", [*((name, 1, 1) for name in graphs()), ("random", 1_000_000, 1000)])
def test_components_are_those_of_brute_force(spark, name, task_edges, hubs):
    edges = graphs()[name]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3), task_edges=task_edges, hubs=hubs).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == brute(edges)


def test_stars_connect_what_the_edges_connect():
    for edges in graphs().values():
        edges = [e for e in edges if None not in e]
        u, v = np.array(edges, dtype=np.int64).reshape(-1, 2).T
        node, root = stars(u, v)
        want = brute(edges)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {k: c for k, c in want.items() if k != c}


def test_few_edges_need_no_round(spark):
    chain = list(range(300))
    random.Random(7).shuffle(chain)
    edges = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a long, b long").repartition(7)
    got = components(edges, most_rounds=1)  # a chain over several tasks takes more rounds than one
    assert got.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, got.collect())) == [(k, 0) for k in range(300)]
