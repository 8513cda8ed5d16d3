"""Steps whose rows must not grow faster than their input: points of one place, paths cut at spans."""

from trenchwork.operators import crossings, network, spatial
from trenchwork.store import by_key


def test_nearest_within_compares_places(spark, monkeypatch):
    """Many points of few places: pairs of places are compared, and every point has the least id of the nearest place."""
    seen, real = [], spatial.within

    def counted(left, right, radius):
        seen.append((left.count(), right.count()))
        return real(left, right, radius)

    monkeypatch.setattr(spatial, "within", counted)
    left = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(300)], "id long, x double, y double")
    right = spark.createDataFrame([(i, float(i % 2) + 0.25, 0.0) for i in range(1000, 1200)], "id long, x double, y double")
    got = {r["left_id"]: (r["right_id"], r["d"]) for r in spatial.nearest_within(left, right, 1.0).collect()}
    assert seen == [(3, 2)]
    assert got == {i: [(1000, 0.25), (1001, 0.25), (1001, 0.75)][i % 3] for i in range(300)}


def test_by_key_keeps_its_tasks(spark):
    """As many tasks as asked for, also above a shuffle by the same key, which AQE makes smaller."""
    rows = spark.range(1000).selectExpr("id % 50 AS k", "id").groupBy("k").count()
    assert by_key(rows, "k").rdd.getNumPartitions() == 5 and by_key(rows, "k", rows=5).rdd.getNumPartitions() == 10


def test_zone_spans_move_no_pairs(spark):
    """Legs are moved once; pairs of legs and zones are not."""
    legs = spark.createDataFrame([(p, o, float(o), 0.0, float(o + 1), 0.0) for p in range(3) for o in range(4)], "path long, ord long, x0 double, y0 double, x1 double, y1 double")
    zones = spark.createDataFrame([(1, 2.5, -9.0, 2.5, 9.0, 1.6, 0.25, 0.7)], "zone int, zx0 double, zy0 double, zx1 double, zy1 double, k double, extend double, least_sine double")
    spans = crossings.zone_spans(legs, zones, 1.0)
    assert sorted(map(tuple, spans.select("path", "s0", "s1", "zone", "shallow").collect())) == [(p, 2.25, 2.75, 1, False) for p in range(3)]
    assert spans._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_cut_at_spans(spark):
    """Spans, what lies between and behind them, and paths without any."""
    legs = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0), (2, 0, 0.0, 0.0, 5.0, 0.0)], "path long, ord long, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 2.0, 3.0, 1.6), (1, 3.0, 4.0, 1.75), (1, 6.0, 10.0, 1.6)], "path long, start double, end double, k double")
    got = sorted(map(tuple, crossings.cut_at_spans(legs, spans).collect()))
    assert got == [(1, 0.0, 2.0, 1.0), (1, 2.0, 3.0, 1.6), (1, 3.0, 4.0, 1.75), (1, 4.0, 6.0, 1.0), (1, 6.0, 10.0, 1.6), (2, 0.0, 5.0, 1.0)]


def test_joins_in_rounds_pass_the_driver_when_small_only(spark, monkeypatch):
    """Beyond the bound a join is shuffled, also where Spark itself would broadcast."""
    a, b = spark.range(100).selectExpr("id AS node"), spark.range(50).selectExpr("id AS node", "id * 2 AS to")
    plan = lambda: network.join_small(a, b, "node")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(network, "ROUND_ROWS", 10)
    assert "SortMergeJoin" in plan() and "Broadcast" not in plan()
