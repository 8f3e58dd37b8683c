import random

import pytest

from fieldloom.llm import graph


def expected(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((i, find(i)) for i in root if find(i) != i)


def cases():
    rng = random.Random(4)
    yield [(i, i + 1) for i in range(60)]                                       # a long chain
    yield [(0, i) for i in range(1, 80)] + [(100, 100), (None, 5), (5, None)]   # a hub, a loop, nulls
    yield [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] * 2    # repeated links
    yield []


@pytest.mark.parametrize("per_task", [500_000, 9])
@pytest.mark.parametrize("edges", cases(), ids=["chain", "hub", "random", "empty"])
def test_components(spark, monkeypatch, edges, per_task):
    monkeypatch.setattr(graph, "LINKS_PER_TASK", per_task)
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == expected(edges)
