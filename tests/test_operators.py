"""Pinned cases of spans, depths, ranking, costs, spatial joins and networks."""

import pytest

from trenchwork.operators import costing, depth, intervals, network, spatial


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize(
    ("spans", "want"),
    [
        ([(0.0, 10.0, 1.60, 1), (10.0, 20.0, 1.60, 2)], [(0, 10, 1.60), (10, 20, 1.60)]),
        ([(0.0, 10.0, 1.05, 4), (10.0, 18.0, 1.05, 4)], [(0, 18, 1.05)]),
        ([(0.0, 10.0, 1.60, 1), (6.0, 14.0, 1.75, 2)], [(0, 6, 1.60), (6, 10, 1.75), (10, 14, 1.75)]),
        ([(0.0, 1.0, 1.05, 1), (5.0, 6.0, 1.05, 1)], [(0, 1, 1.05), (5, 6, 1.05)]),
        ([], []),
    ],
)
def test_merge_spans(spark, spans, want):
    df = spark.createDataFrame([(1, *s) for s in spans], "path int, s0 double, s1 double, k double, zone int")
    assert [r[1:] for r in rows(intervals.merge_spans(df, "path"), "start")] == want


def test_union_intervals(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.04, 2.0), (1, 2.1, 3.0), (1, 0.5, 0.6)], "path int, s0 double, s1 double")
    assert rows(intervals.union_intervals(df, "path"), "start") == [(1, 0.0, 2.0, 3), (1, 2.1, 3.0, 1)]


@pytest.mark.parametrize(("bands", "want"), [([(2.42, 3.4)], 2.42), ([(0.6, 3.4)], 3.4), ([(1.0, 5.0), (0.5, 4.0)], 5.0)])
def test_choose_depth(spark, bands, want):
    df = spark.createDataFrame([(1, *b) for b in bands], "id int, above_max double, below_min double")
    assert depth.choose_depth(df, "id").first()["depth"] == pytest.approx(want)


def test_depth_ramp(spark):
    stations = spark.createDataFrame([(1, float(s)) for s in (0, 40, 45, 50, 60)], "edge int, s double")
    pins = spark.createDataFrame([(1, 50.0, 2.0, 2.0)], "edge int, at double, low double, high double")
    assert [r[2] for r in rows(depth.profile(stations, pins, "edge"), "s")] == pytest.approx([3, 3, 2.5, 2, 3])


def plans(spark, data):
    return spark.createDataFrame([(1, *d) for d in data], "run int, code string, cost double, taps int, length double, unconnected int")


def test_dominance(spark):
    kept = costing.undominated(plans(spark, [("mincost", 235e6, 2, 1000.0, 0), ("mintaps", 216e6, 1, 1000.0, 0), ("minrecon", 184e6, 2, 1000.0, 0)]), "run")
    assert {r["code"] for r in kept.collect()} == {"mintaps", "minrecon"}
    both = costing.undominated(plans(spark, [("mincost", 200e6, 1, 1800.0, 0), ("minrecon", 230e6, 1, 1700.0, 0)]), "run")
    assert both.count() == 2
    assert {r["code"] for r in costing.undominated(kept, "run").collect()} == {"mintaps", "minrecon"}


def test_published_scores(spark):
    got = costing.ranked(plans(spark, [("a", 249_753_200.0, 0, 1771.4, 0), ("b", 253_326_117.0, 0, 1819.4, 0), ("c", 274_609_901.0, 0, 1690.9, 0)]), "run")
    assert [(r["code"], round(r["score"], 3)) for r in got.orderBy("rank").collect()] == [("a", 12.307), ("b", 12.551), ("c", 12.762)]


def test_roll_up_identity(spark):
    segments = spark.createDataFrame([(1, "A", "B", 100.0, 100, 0.0, None, None), (1, "B", "C", 10.0, 200, 1.6, 3.0, 3.4)], "plan int, from_id string, to_id string, length double, dn int, k_spec double, depth_from double, depth_to double")
    chambers = spark.createDataFrame([(1, "B", None), (1, "Z", None)], "plan int, id string, dn int")
    ties = spark.createDataFrame([(1,)], "plan int")
    left = spark.createDataFrame([(2, 3.0)], "plan int, flow double")
    one, two = costing.roll_up(segments, chambers, ties, left, "plan").orderBy("plan").collect()
    assert one["pipes"] == pytest.approx(100 * 89_748 + 10 * 120_275 * 1.6 * 1.02)
    assert (one["chambers"], one["tie_ins"], one["penalty"], one["length"]) == (6e6, 5e6, 0, 110)
    assert one["total"] == pytest.approx(one["pipes"] + 11e6)
    assert (two["penalty"], two["total"]) == (101.5e6, 101.5e6)


def test_points_inside_and_near(spark):
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 2.0, 9.0)], "id int, x double, y double")
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 6.0), (0.0, 10.0), (0.0, 0.0)]
    polygons = spark.createDataFrame([("p", ring)], "polygon string, ring array<struct<x:double,y:double>>")
    assert rows(spatial.points_inside(points, polygons, 4.0), "id") == [(1, "p")]
    near = spatial.nearest_within(points, spark.createDataFrame([(7, 5.0, 9.0), (8, 5.0, 1.0)], "id int, x double, y double"), 4.0)
    assert rows(near, "left_id") == [(1, 7, 4.0), (3, 7, 3.0)]


def test_network(spark):
    tree = spark.createDataFrame([(1, None, 0, 0.0), (2, 1, 10, 1.0), (3, 2, 5, 2.0), (4, 1, 7, 4.0)], "node int, parent int, length int, flow double")
    assert rows(network.to_source(tree), "node") == [(1, 1, 0, 0.0), (2, 1, 1, 10.0), (3, 1, 2, 15.0), (4, 1, 1, 7.0)]
    assert rows(network.subtree_sums(tree, "flow"), "node") == [(1, 7.0, 4), (2, 3.0, 2), (3, 2.0, 1), (4, 4.0, 1)]
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0)], "a int, b int, metres double")
    got = network.shortest_paths(edges, spark.createDataFrame([(1,)], "node int"), 4)
    assert rows(got, "node") == [(1, 0.0, 1, None), (2, 1.0, 1, 1), (3, 2.0, 1, 2), (4, 3.0, 1, 3)]


def test_every_query_has_the_oracles_columns(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() > 0
