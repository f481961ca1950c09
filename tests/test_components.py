"""Connected components against union-find."""

import random

import pytest

from tracewright.operators.components import components


def brute(edges):
    root = {}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        root.setdefault(a, a)
        root.setdefault(b, b)
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(-40, 40), r.randint(-40, 40)) for _ in range(45)]
    edges += [(100, 100 + i) for i in range(30)] + [(200 + i, 201 + i) for i in range(30)] + [(1, 1), (None, 3), edges[0]]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({x.node for x in got})
    assert {x.node: x.root for x in got} == brute(edges)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
