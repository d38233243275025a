import random

from planeframe.llm.components import components


def test_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((40, 30), (60, 120), (300, 299)):
        edges = [(k, k + 1) for k in range(n)] if m == 299 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n + 1))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        got = {r.node: r.component for r in components(spark.createDataFrame(edges + [(None, 1), (2, None)], "a long, b long")).collect()}
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {x: find(x) for x in linked}


def test_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
