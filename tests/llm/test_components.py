import random

from lattica.llm.components import connected_components, no_edges


def test_chain_star_and_random(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + k) for k in range(1, 80)] + [(random.randrange(1000, 1100), random.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (None, 3), (3, None), (3, 4), (4, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(no_edges(spark)).count() == 0
