import random

from tidemark.llm.components import connected_components


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            r, s = find(a), find(b)
            parent[max(r, s)] = min(r, s)
    return {x: find(x) for x in parent}


def run(spark, links):
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got})
    return {r["node"]: r["component"] for r in got}


def test_random_graph_chain_and_star(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)]
    links += [(1000 + i, 1001 + i) for i in range(60)]                      # a chain
    links += [(5000, 5001 + i) for i in range(300)] + [(5001, 4999)]        # a hub
    assert run(spark, links) == brute(links)


def test_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, 1), (2, None), (3, 4), (4, 3), (3, 4)]) == {3: 3, 4: 3}
