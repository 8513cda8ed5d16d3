"""Pinned cases of crossings, depths along ways, areas and titles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trenchwork.operators import costing, crossings, network, utilities

LEGS = "path long, ord int, x0 double, y0 double, x1 double, y1 double, dn int"
UTILITIES = "obstacle string, kind string, area boolean, dn int, top double, ox0 double, oy0 double, ox1 double, oy1 double"
JOINTS = "path long, obstacle string, at_start boolean"


def way(spark, *points, dn=100):
    return spark.createDataFrame([(1, i, *map(float, a), *map(float, b), dn) for i, (a, b) in enumerate(zip(points, points[1:]))], LEGS)


def lines(spark, *rows):
    return spark.createDataFrame([(n, k, k == "ROAD", dn, None, *map(float, xy)) for n, k, dn, *xy in rows], UTILITIES)


def laid(legs, lines, joints, ends=None):
    return utilities.laid(*utilities.bounds(legs, lines, joints), ends)


def profile(pieces):
    rows = pieces.orderBy("s0").collect()
    return [(r["s0"], r["depth_from"]) for r in rows] + [(rows[-1]["s1"], rows[-1]["depth_to"])]


def depth_at(knots, s):
    (a, h), (b, g) = next(p for p in zip(knots, knots[1:]) if p[0][0] - 1e-9 <= s <= p[1][0] + 1e-9)
    return h + (s - a) / (b - a) * (g - h) if b > a else h


def test_a_gas_main_is_passed_above(spark):
    none = spark.createDataFrame([], JOINTS)
    legs, gas = way(spark, (500_000, 0), (500_100, 0)), lines(spark, ("g", "GAS", None, 500_050, -20, 500_050, 20))
    pin = utilities.utility_pins(legs, gas, none).first()
    assert (pin["above_max"], pin["below_min"]) == pytest.approx((2.42, 3.4)) and (pin["s0"], pin["s1"]) == pytest.approx((50 - 0.455, 50 + 0.455))
    knots = profile(laid(legs, gas, none))
    assert depth_at(knots, 50) == pytest.approx(2.42) and knots[0] == (0, 3) and knots[-1] == (100, 3)
    assert len(knots) == 6 and all(abs(g - h) <= 0.1 * (b - a) + 1e-9 for (a, h), (b, g) in zip(knots, knots[1:]))


def test_an_end_that_joins_the_network_is_no_crossing(spark):
    legs, net = way(spark, (50, 40), (50, 0)), lines(spark, ("net", "HEAT", 200, 0, 0, 100, 0))
    joints = spark.createDataFrame([(1, "net", False)], JOINTS)
    assert profile(laid(legs, net, joints)) == [(0, 3), (40, 3)]
    assert len(profile(laid(legs, net, joints.where("at_start")))) > 2
    gas = lines(spark, ("net", "GAS", None, 0, 0, 100, 0))
    assert utilities.utility_pins(legs, gas, joints).count() == 1  # only heat networks are joined


@pytest.mark.parametrize(("dn", "line", "want"), [(100, ("n", "HEAT", 200, 40, -20, 40, 20), 2.32), (1400, ("c", "CABLE", None, 40, -10, 40, 10), 3.4), (100, ("n", "HEAT", None, 40, -20, 40, 20), 2.32)])
def test_crossings_above_and_below(spark, dn, line, want):
    knots = profile(laid(way(spark, (0, 0), (80, 0), dn=dn), lines(spark, line), spark.createDataFrame([], JOINTS)))
    assert depth_at(knots, 40) == pytest.approx(want)
    assert not any(min(h, g) < 2.999 and max(h, g) > 3.001 for (_, h), (_, g) in zip(knots, knots[1:]))


def test_a_road_does_not_deepen_what_lies_deep_enough(spark):
    road = lines(spark, ("r", "ROAD", None, 40, 10, 60, 10), ("r", "ROAD", None, 60, 10, 60, 30), ("r", "ROAD", None, 60, 30, 40, 30), ("r", "ROAD", None, 40, 30, 40, 10))
    legs = way(spark, (0, 20), (100, 20))
    assert profile(laid(legs, road, spark.createDataFrame([], JOINTS))) == [(0, 3), (100, 3)]
    cover = utilities.covers(legs, road).first()
    assert (cover["c0"], cover["c1"], cover["cover"]) == pytest.approx((40 - 0.255, 60 + 0.255, 1.0))


def test_ramp_pieces_and_slices(spark):
    pins = spark.createDataFrame([(1, 50.0, 50.0, 2.0, 2.0)], "path long, s0 double, s1 double, low double, high double")
    lengths = spark.createDataFrame([(1, 100.0), (2, 7.0)], "path long, total double")
    knots = utilities.knots(pins, lengths)
    assert [tuple(r) for r in knots.orderBy("path", "s").collect()] == [pytest.approx(x) for x in [(1, 0, 3), (1, 40, 3), (1, 50, 2), (1, 60, 3), (1, 100, 3), (2, 0, 3), (2, 7, 3)]]
    pieces = utilities.profile_pieces(knots).where("path = 1")
    cut = utilities.sliced(way(spark, (0, 0), (45, 0), (45, 55)), pieces).orderBy("ord").collect()
    assert [(r["piece"], round(r["x1"]), round(r["y1"])) for r in cut] == [(1, 40, 0), (2, 45, 0), (2, 45, 5), (3, 45, 15), (4, 45, 55)]
    assert [r["x0"] for r in cut][1:] == pytest.approx([r["x1"] for r in cut][:-1])


def test_bounds_from_other_pipes(spark):
    """A pin at the end of one pipe of ten metres is felt in the next. Pipes are built at 0.99 of the slope, so that 2.99 is left at its other end."""
    tree = spark.createDataFrame([(1, None, 0.0), (2, 1, 10.0), (3, 2, 10.0)], "node long, parent long, length double")
    at = network.spread(tree, spark.createDataFrame([(3, 1.0, 1.0)], "node long, low double, high double"), 0.1)
    assert {r["node"]: (round(r["low"], 9), round(r["high"], 9)) for r in at.collect()} == {1: (-1, 3), 2: (0, 2), 3: (1, 1)}
    ends = at.where("node < 3").select(F.lit(1).cast("long").alias("path"), (F.col("node") == 1).alias("at_start"), "low", "high")
    none = spark.createDataFrame([], UTILITIES)
    assert profile(laid(way(spark, (0, 0), (10, 0)), none, spark.createDataFrame([], JOINTS), ends)) == [pytest.approx((0, 2.99)), pytest.approx((10, 2))]


def test_tree_distances_between_trees_and_within(spark):
    rnd = random.Random(4)
    parent = {i: (None if i < 2 else rnd.choice([i - 1, rnd.randrange(i)])) for i in range(90)}
    size = {i: float(1 + i % 7) for i in parent}

    def ways(v):
        out, far = {}, 0.0
        while v is not None:
            out[v], far, v = far, far + size[v], parent[v]
        return out

    pairs = [(rnd.randrange(90), rnd.randrange(95)) for _ in range(150)] + [(5, 5), (0, 1)]
    tree = spark.createDataFrame([(i, p, size[i]) for i, p in parent.items()], "node long, parent long, length double")
    got = {(r["a"], r["b"]): (r["meet"], r["metres"]) for r in network.tree_distances(tree, spark.createDataFrame(list(set(pairs)), "a long, b long")).collect()}
    for a, b in pairs:
        x, y = ways(a), ways(b) if b < 90 else {}
        both = sorted((x[v] + y[v], v) for v in x.keys() & y.keys())
        assert got[a, b] == ((both[0][1], both[0][0]) if both else (None, None))


def square(x, y, side):
    corners = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]


def zones(spark, edges, area=True, existing=False, extend=3.0, k=1.6, angle=45.0, clear=1.94):
    return spark.createDataFrame([(1, *map(float, e), area, existing, k, extend, math.sin(math.radians(angle)), clear) for e in edges], "zone int, ox0 double, oy0 double, ox1 double, oy1 double, area boolean, existing boolean, k double, extend double, least_sine double, clear double")


def leg(spark, *xy, tap0=False, tap1=False):
    return spark.createDataFrame([(1, *map(float, xy), tap0, tap1)], "id int, x0 double, y0 double, x1 double, y1 double, tap0 boolean, tap1 boolean")


def test_road_crossings(spark):
    road = zones(spark, square(10, 0, 20))
    into = crossings.zone_bands(leg(spark, 0, 10, 20, 10, tap1=True), road).first()
    over = crossings.zone_bands(leg(spark, 0, 10, 40, 10), road).first()
    assert (into["special"], into["first"], into["last"], into["admissible"]) == pytest.approx((13, 7, 20, True))
    assert (over["special"], over["first"], over["last"]) == pytest.approx((26, 7, 33))
    extra = lambda one, z: crossings.zone_costs(one, z).first()["extra"]
    assert extra(leg(spark, 0, 10, 40, 10), road) == pytest.approx(0.6 * 26)
    assert extra(leg(spark, 0, -1, 40, -1), road) is None  # within the band, but not across
    assert extra(leg(spark, 0, -5, 40, -5), road) == 0
    assert extra(leg(spark, 5, 16, 14, 24), road) is None  # round a corner within the band
    assert extra(leg(spark, 5, -3, 35, 4), road) is None  # at less than 45 degrees


def test_line_crossings(spark):
    rail = zones(spark, [(10, -20, 10, 20)], area=False, extend=2.0)
    extra = lambda one, z=rail: crossings.zone_costs(one, z).first()["extra"]
    assert extra(leg(spark, 0, 0, 20, 0)) == pytest.approx(0.6 * 4)
    assert extra(leg(spark, 0, 0, 9, 0)) is None  # ends within the band
    assert extra(leg(spark, 0, 0, 30, 25)) is not None
    net = zones(spark, [(10, -20, 10, 20)], area=False, existing=True, extend=2.0)
    assert extra(leg(spark, 10, 0, 30, 0, tap0=True), net) == 0  # leaves the network that it joins
    assert extra(leg(spark, 10, 0, 30, 0), net) is None or extra(leg(spark, 10, 0, 30, 0), net) > 0


def test_areas_with_holes_by_even_odd(spark):
    rnd = random.Random(6)
    ring = [(math.cos(t) * (20 + 8 * (i % 2)), math.sin(t) * (20 + 8 * (i % 2))) for i, t in enumerate(x * math.pi / 8 for x in range(16))]
    hole = [(4, 4), (-4, 4), (-4, -4), (4, -4)]
    edges = [(*a, *b) for r in (ring, hole) for a, b in zip(r, r[1:] + r[:1])]
    legs = [(i, 0, *(rnd.uniform(-35, 35) for _ in range(4)), 100) for i in range(12)] + [(50, 0, -40.0, 4.0, 40.0, 4.0, 100), (51, 0, 0.0, 0.0, 0.0, 0.0, 100)]

    def inside(x, y):
        return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in edges) % 2 == 1

    got = {i: 0.0 for i, *_ in legs}
    for r in utilities.inside_spans(spark.createDataFrame(legs, LEGS), spark.createDataFrame([(7, *map(float, e)) for e in edges], "obstacle int, ox0 double, oy0 double, ox1 double, oy1 double"), cell=9.0).collect():
        got[r["path"]] += r["t1"] - r["t0"]
    for i, _, x0, y0, x1, y1, _ in legs[:-2]:
        n, far = 4000, math.hypot(x1 - x0, y1 - y0)
        assert got[i] == pytest.approx(sum(inside(x0 + (k + 0.5) / n * (x1 - x0), y0 + (k + 0.5) / n * (y1 - y0)) for k in range(n)) * far / n, abs=0.1)
    assert got[51] == 0


LEAST, TAPS, LENGTH, MORE = costing.LEAST_COST, costing.FEWEST_TAPS, costing.LEAST_LENGTH, costing.ADDITIONAL


@pytest.mark.parametrize(
    ("plans", "want"),
    [
        ([("mincost", LEAST, 235e6, 2, 1000.0), ("minrecon", "own", 184e6, 2, 1000.0)], [MORE, LEAST]),
        ([("mincost", LEAST, 235e6, 1, 1000.0), ("minrecon", "own", 184e6, 2, 1000.0)], [TAPS, LEAST]),
        ([("mincost", LEAST, 235e6, 2, 900.0), ("mintaps", "own", 184e6, 1, 1000.0)], [LENGTH, LEAST]),
        ([("mintaps", LEAST, 235e6, 2, 900.0), ("minrecon", "own", 184e6, 1, 1000.0)], [LEAST, "own"]),  # least cost was not asked for
        ([("mincost", LEAST, 200e6, 2, 1000.0), ("mintaps", "own", 200e6, 1, 1000.0)], [MORE, LEAST]),  # of equals, fewer taps
        ([("mincost", LEAST, 1e6, 2, 9000.0), ("mintaps", "own", 9e6, 1, 1000.0)], [MORE, LEAST]),  # by score, not by cost
    ],
)
def test_titles(spark, plans, want):
    df = spark.createDataFrame([(1, *p) for p in plans], "run int, code string, title string, cost double, taps int, length double")
    got = {r["code"]: r["title"] for r in costing.titled(df, "run").collect()}
    assert [got[p[0]] for p in plans] == want
