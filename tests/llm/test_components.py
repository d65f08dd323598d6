import random

from tessera.llm.components import components


def find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    rng.shuffle(chain)
    star = [(5000, 5000 + i) for i in range(1, 300)]
    random_edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges = [e for e in chain + star + random_edges + random_edges if e[0] != e[1]]
    df = spark.createDataFrame([*edges, (7, 7), (None, 1), (2, None)], "a long, b long")
    assert {r.node: r.comp for r in components(df).collect()} == find(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
