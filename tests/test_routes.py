"""Visibility, spanning forests and Steiner trees against brute force."""

import random

from trenchwork.operators import network, routes


def kruskal(edges):
    parent, total = {}, 0.0

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b, m in sorted(edges, key=lambda e: e[2]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            total += m
    return total


def test_spanning_forest(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 30), r.randint(0, 30), float(r.randint(1, 9))) for _ in range(70)]
    got = network.spanning_forest(spark.createDataFrame(edges, "a long, b long, metres double")).collect()
    assert sum(e["metres"] for e in got) == kruskal([e for e in edges if e[0] != e[1]])


def test_legs_go_around(spark):
    block = spark.createDataFrame([(1, [(4.0, 0.0), (6.0, 0.0), (6.0, 5.0), (4.0, 5.0), (4.0, 0.0)])], "polygon int, ring array<struct<x:double,y:double>>")
    corners = {(r["x"], r["y"]) for r in routes.corners(block, 1.0).collect()}
    assert corners == {(3.0, -1.0), (7.0, -1.0), (7.0, 6.0), (3.0, 6.0)}
    points = [(1, 0.0, 2.0), (2, 10.0, 2.0)] + [(3 + i, *c) for i, c in enumerate(sorted(corners))]
    legs = routes.legs(spark.createDataFrame(points, "id long, x double, y double"), block, 20.0)
    pairs = {(r["a"], r["b"]) for r in legs.collect()}
    assert (1, 2) not in pairs and (1, 3) in pairs and (1, 4) in pairs
    far = network.shortest_paths(legs, spark.createDataFrame([(1,)], "node long")).where("node = 2").first()["metres"]
    assert abs(far - (2 * 18**0.5 + 4)) < 1e-9


def test_steiner_forest(spark):
    """On a grid the forest joins all terminals, has no cycle and is within twice the best spanning tree."""
    size, edges = 6, []
    for i in range(size):
        for j in range(size):
            v = i * size + j
            edges += [(v, v + 1, 1.0)] * (j + 1 < size) + [(v, v + size, 1.0)] * (i + 1 < size)
    terminals, roots = [0, 5, 30, 35, 14], [2, 3]
    df = spark.createDataFrame(edges, "a long, b long, metres double")
    tree = routes.steiner_forest(df, spark.createDataFrame([(t,) for t in terminals], "node long"), spark.createDataFrame([(t,) for t in roots], "node long"))
    rows = {r["node"]: (r["parent"], r["length"]) for r in tree.collect()}
    for t in terminals:
        seen = set()
        while rows[t][0] is not None:
            assert t not in seen
            seen.add(t)
            t = rows[t][0]
        assert t in roots
    assert sum(length for _, length in rows.values()) <= 2 * 17
    demand = spark.createDataFrame([(t, 5.0) for t in terminals], "node long, flow double")
    pipes = routes.sized(tree, demand).collect()
    assert sum(p["flow"] for p in pipes if p["parent"] in roots) == 25
    assert all(p["dn"] >= 65 and p["cost"] > 0 for p in pipes)


def test_rooted_trees(spark):
    """Trees of any depth are seen from their roots; one without a root is left out."""
    chain = [(i, i + 1, 1.0) for i in range(200)]
    star = [(300, 300 + i, 2.0) for i in range(1, 5)] + [(303, 310, 1.0)]
    ring_free = [(500, 501, 1.0), (501, 502, 1.0)]
    df = spark.createDataFrame(chain + star + ring_free, "a long, b long, metres double")
    got = {x["node"]: (x["parent"], x["length"]) for x in network.rooted(df, spark.createDataFrame([(50,), (300,)], "node long")).collect()}
    assert got[50] == (None, 0) and got[300] == (None, 0) and got[310] == (303, 1) and 501 not in got
    assert all(got[i] == (i - 1, 1) for i in range(51, 201)) and all(got[i] == (i + 1, 1) for i in range(50))
    ways = {x["node"]: (x["source"], x["hops"]) for x in network.to_source(network.rooted(df, spark.createDataFrame([(50,)], "node long"))).collect()}
    assert ways[200] == (50, 150) and ways[0] == (50, 50)


def test_points_of_one_place_are_one_corner(spark):
    """Consumers of one place and a root there are joined by legs of 0 m; n of them make n legs, not n * n."""
    n, away = 60, [(100 + i, 5.0, 0.0) for i in range(60)]
    at_root = [(1, 0.0, 0.0), (2, 0.0, 0.0), (900, 0.0, 0.0), (901, 9.0, 0.0)]
    points = spark.createDataFrame(at_root + away, "id long, x double, y double")
    none = spark.createDataFrame([], "polygon long, ring array<struct<x:double,y:double>>")
    legs = routes.legs(points, none, 6.0)
    assert sorted((x["a"], x["b"], x["metres"]) for x in legs.collect()) == sorted([(1, 2, 0.0), (1, 900, 0.0), (1, 100, 5.0), (100, 901, 4.0)] + [(100, 100 + i, 0.0) for i in range(1, n)])
    # The root has a greater id than a consumer of its place; another root is farther away.
    nodes = lambda ids: spark.createDataFrame([(i,) for i in ids], "node long")
    tree = {x["node"]: (x["parent"], x["length"]) for x in routes.steiner_forest(legs, nodes([1, 2] + [100 + i for i in range(n)]), nodes([900, 901])).collect()}
    assert {1, 2, 900, *range(100, 100 + n)} <= set(tree) and sum(length for _, length in tree.values()) == 4.0
    for v in (1, 2, 100, 100 + n - 1):
        while tree[v][0] is not None:
            v = tree[v][0]
        assert v in (900, 901)
