"""Sizing, orientation and small helpers of scenes against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from trenchwork.functions import geometry as g
from trenchwork.functions import rules as r
from trenchwork.operators import costing, crossings, network, topology


def sized_by_paths(tree):
    """Rows of equal flow that hang together have one diameter: the first, from the greatest that lies below them or that their
    flow asks for, whose limit no path downwards from their top exceeds. Runs are added up along every path."""
    pipes = {v: row for v, row in tree.items() if row[0] is not None}
    known = [(d[0], d[1], d[2]) for d in r.DIAMETERS]

    def top_of(v):
        while (up := pipes[v][0]) in pipes and abs(pipes[up][2] - pipes[v][2]) < 1e-6:
            v = up
        return v

    def hops(v):
        n = 0
        while v in pipes:
            v, n = pipes[v][0], n + 1
        return n

    rows = {}
    for v in pipes:
        rows.setdefault(top_of(v), []).append(v)
    dn = {}

    def runs():
        found = {}
        for v in dn:
            total, at = 0.0, v
            while at in dn and dn[at] == dn[v]:
                total += pipes[at][1]
                found[at] = max(found.get(at, 0.0), total)
                at = pipes[at][0]
        return found

    for top in sorted(rows, key=hops, reverse=True):
        below = [dn[v] for v in pipes if v in dn and pipes[v][0] in rows[top]]
        least = max([next((d for d, most, _ in known if pipes[top][2] <= most + 1e-9), known[-1][0]), *below])
        for d, _, limit in (x for x in known if x[0] >= least):
            dn.update(dict.fromkeys(rows[top], d))
            if runs()[top] <= limit + 1e-6:
                break
    return {v: (dn[v], round(run, 6)) for v, run in runs().items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_run_limits(spark, seed):
    rnd = random.Random(seed)
    parent = {0: None} | {i: rnd.choice([i - 1, i - 1, rnd.randrange(i)]) for i in range(1, 60)}
    own = {i: rnd.choice([0.0, 0.0, 2.0, 7.0]) for i in parent}
    flow = dict(own)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            flow[parent[i]] += flow[i]
    tree = {i: (parent[i], 0.0 if parent[i] is None else float(rnd.randint(5, 220)), flow[i]) for i in parent}
    tree = {i: t for i, t in tree.items() if t[2] > 0 or t[0] is None}
    df = spark.createDataFrame([(i, *t) for i, t in tree.items()], "node long, parent long, length double, flow double")
    got = {x["node"]: x["dn"] for x in network.run_limited_dn(df).collect()}
    assert got == {v: d for v, (d, _) in sized_by_paths(tree | {0: (None, 0.0, flow[0])}).items()}


def test_run_limit_case(spark):
    df = spark.createDataFrame([(0, None, 0.0, 10.0), (1, 0, 200.0, 10.0), (2, 1, 200.0, 10.0)], "node long, parent long, length double, flow double")
    assert {x["node"]: x["dn"] for x in network.run_limited_dn(df).collect()} == {1: 100, 2: 100}
    assert network.run_limited_dn(df.limit(0)).count() == 0


def test_orientation(spark):
    segments = [("A", 1, 2, 5.0, None), ("B", 3, 2, 5.0, None), ("C", 3, 4, 0.0, "given"), ("D", 8, 9, 1.0, None)]
    df = spark.createDataFrame(segments, "segment string, a long, b long, length double, next_id string")
    got = {x["segment"]: (x["up"], x["next_id"]) for x in topology.oriented(df, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {"A": (1, "node 1"), "B": (2, "A"), "C": (3, "given"), "D": (None, None)}


def test_small_helpers(spark):
    assert costing.strategies([]) == ["mincost", "mintaps", "minrecon"]
    assert costing.strategies(["mintaps", "x", "mintaps"]) == ["mintaps"] and costing.strategies(["x"]) == ["mincost"]
    path = spark.createDataFrame([([(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (0.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert [tuple(p) for p in path.select(g.without_repeats(F.col("p"))).first()[0]] == [(0, 0), (1, 0), (0, 0)]
    at = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    turns = spark.range(1).select(g.turn(at(0, 0), at(1, 0), at(1, 1)), g.turn(at(0, 0), at(1, 0), at(2, 0)), g.turn(at(0, 0), at(0, 0), at(2, 0)), g.touches(at(0, 0), at(2, 0), at(1, 0), at(1, 5))).first()
    assert turns[0] == pytest.approx(90) and turns[1] == pytest.approx(0) and turns[2] == 0 and turns[3]


def test_exits_and_spans(spark):
    taps = spark.createDataFrame([(1, 0.0, 5.0, 0.0, 0.0, "s"), (2, 5.0, 1.0, 0.0, 0.0, "s")], "id int, x double, y double, tx double, ty double, site string")
    pieces = spark.createDataFrame([(7, -5.0, 0.0, 5.0, 0.0, "s"), (8, -5.0, 9.0, 5.0, 9.0, "s")], "piece int, x0 double, y0 double, x1 double, y1 double, site string")
    got = {x["id"]: (x["piece"], x["admissible"]) for x in crossings.exit_angles(taps, pieces).collect()}
    assert got == {1: (7, True), 2: (7, False)}
    legs = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (1, 2, 10.0, 0.0, 10.0, 10.0)], "path int, ord int, x0 double, y0 double, x1 double, y1 double")
    zones = spark.createDataFrame([(1, 5.0, -1.0, 5.0, 1.0, 1.6, 3.0, 0.7), (2, 9.0, 9.5, 11.0, 9.5, 1.25, 2.0, 0.7)], "zone int, zx0 double, zy0 double, zx1 double, zy1 double, k double, extend double, least_sine double")
    spans = crossings.zone_spans(legs, zones)
    assert sorted((x["zone"], x["s0"], x["s1"], x["shallow"]) for x in spans.collect()) == [(1, 2.0, 8.0, False), (2, 17.5, 20.0, False)]
    assert crossings.crossing_extra(spans).first()["extra"] == pytest.approx(0.6 * 6 + 0.25 * 2.5)
