import random

from copytrace.llm.components import components


def test_against_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 640)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(260)] + [(7, 7), (-3, 9), (9, -3)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for a, b in edges:
        if a != b:
            x, y = root[a], root[b]
            root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == root and len(found) == len(root)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
