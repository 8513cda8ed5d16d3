"""From a file to a plan."""

import json

import pytest

from trenchwork.plans.run import run
from trenchwork.sources import geojson


def feature(kind, shape, coordinates, **more):
    return {"type": "Feature", "geometry": {"type": shape, "coordinates": coordinates}, "properties": {"feature_type": kind, **more}}


def square(x, y, side):
    return [[[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]]


def test_plan_of_a_file(spark, tmp_path):
    items = [
        feature("source", "Point", [1000.0, 1000.0], id="boiler"),
        feature("oks_future", "Polygon", square(1300, 990, 20), id="north", flow_tph=9.0),
        feature("oks_connection_point", "Point", [1300.0, 1000.0], id="gate", oks_id="north"),
        feature("oks_future", "Polygon", square(1000, 1200, 20), id=55, flow_tph="3,5"),
        feature("restriction", "Polygon", square(1100, 960, 80), id="yard", restriction_type="park"),
        feature("oks_future", "Polygon", square(990, 380, 20), id="far", flow_tph=1.0),
    ]
    path = tmp_path / "in.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "name": "n", "features": items}))
    got = run(spark, str(path), to=str(tmp_path / "out"))
    pipes = got.pipes.collect()
    assert {p["from_id"] for p in pipes} >= {"north", "55"} and any(p["to_id"] == "boiler" for p in pipes)
    way = sum(p["length"] for p in pipes if p["flow"] == 9.0)
    assert 300 < way < 320  # round the yard, not through it
    plan = got.plan.first()
    assert plan["unconnected"] == 0 and plan["penalty"] == 0 and [round(p["length"]) for p in pipes if p["from_id"] == "far"] == [610]
    assert plan["pipes"] == pytest.approx(sum(p["cost"] for p in pipes), abs=0.05)
    assert plan["total"] == pytest.approx(plan["pipes"] + plan["chambers"] + plan["tie_ins"] + plan["penalty"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*/part-*")))
    features = json.loads(text)["features"]
    kinds = [f["properties"]["object_type"] for f in features]
    assert kinds == sorted(kinds, key=["heat_network", "heat_chamber", "technical_node", "variant_summary"].index) and kinds[-1] == "variant_summary"
    assert {f["properties"].get("end_node_id") for f in features} >= {"north", 55}
    with pytest.raises(ValueError):
        run(spark, str(path), "OTHER")


def written(tmp_path, items, name="in"):
    (tmp_path / name).mkdir(exist_ok=True)
    path = tmp_path / name / f"{len(list((tmp_path / name).iterdir()))}.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "name": "n", "features": items}))
    return str(tmp_path / name)


def distance(p, q, x, y):
    (ax, ay), (bx, by) = p, q
    t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
    return ((ax + t * (bx - ax) - x) ** 2 + (ay + t * (by - ay) - y) ** 2) ** 0.5


@pytest.mark.parametrize("turn", [1, -1])
def test_clearance_whatever_the_ring_turns(spark, tmp_path, turn):
    """A park whose wall lies half a metre beside the straight way: pipes keep a metre and half of their width from it."""
    park = [square(1040, 1000.5, 60)[0][::turn]]
    town = [feature("source", "Point", [1000.0, 1000.0], id="s"), feature("oks_connection_point", "Point", [1150.0, 1000.0], id="p", oks_id="b", flow_tph=3.0)]
    got = run(spark, written(tmp_path, [*town, feature("restriction", "Polygon", park, restriction_type="park")]))
    pipes = got.pipes.collect()
    assert got.plan.first()["unconnected"] == 0 and len(pipes) > 1
    walls = [(x, 1000.5) for x in range(1040, 1101)]
    assert min(distance((p["path"][0]["x"], p["path"][0]["y"]), (p["path"][1]["x"], p["path"][1]["y"]), *w) for p in pipes for w in walls) >= 1.2 - 1e-6


def test_a_tap_on_an_existing_pipe_and_depths(spark, tmp_path):
    """Two files are one scene; the nearest root is a place on the pipe, where a chamber is built. A gas main on the way is passed above."""
    written(tmp_path, [feature("source", "Point", [1000.0, 1000.0], id="s"), feature("heat_network", "LineString", [[1000.0, 1000.0], [1400.0, 1000.0]], id="net", dn=200, flow_tph=40.0)])
    path = written(tmp_path, [feature("oks_future", "Polygon", square(1200, 1100, 20), id="b", flow_tph=20.0), feature("restriction", "LineString", [[1150.0, 1050.0], [1250.0, 1050.0]], restriction_type="gas_pipeline"), feature("heat_network", "LineString", [[0.0, 0.0], [0.0, 5.0]], id="far", dn=100)])
    got = run(spark, path, "PLAN_3D", to=str(tmp_path / "out"))
    pipes = sorted(got.pipes.collect(), key=lambda p: p["piece"])
    assert sum(p["length"] for p in pipes) == pytest.approx(110) and {round(p["k_spec"] * 110, 6) for p in pipes} == {110 + 0.25 * 4} and got.plan.first()["chambers"] == 3e6
    assert min(p["depth_from"] for p in pipes) == pytest.approx(2.42) and pipes[0]["depth_to"] == pipes[-1]["depth_from"] == 3
    assert [p["to_id"] for p in pipes[1:]] == [p["from_id"] for p in pipes[:-1]] and pipes[-1]["from_id"] == "b"
    features = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("*/part-*"))))["features"]
    by_kind = {}
    for f in features:
        by_kind.setdefault(f["properties"]["object_type"], []).append(f)
    assert {k: len(v) for k, v in by_kind.items()} == {"heat_network": 5, "heat_chamber": 1, "technical_node": 4, "variant_summary": 1}
    pipe, chamber, summary = (by_kind[k][0]["properties"] for k in ("heat_network", "heat_chamber", "variant_summary"))
    assert set(pipe) == {"id", "object_type", "variant_id", "start_node_id", "end_node_id", "flow_tph", "diameter", "length", "laying_method", "depth_start", "depth_end", "cost"} and pipe["diameter"] == 100
    assert chamber["diameter"] == 200 and summary["id"] == "summary_1" and summary["rank"] == 1 and summary["unconnected_oks_ids"] == []
    assert summary["new_network_length"] == 110 and summary["calculated_cost"] == pytest.approx(summary["construction_cost"] + 3e6)


def test_special_crossings_are_priced_and_steep(spark, tmp_path):
    """A road across the way: 20 m inside and 3 m on either side cost 1.6 times; a second consumer's straight way would cross at a low angle."""
    road = [[[1040.0, 900.0], [1060.0, 900.0], [1060.0, 1100.0], [1040.0, 1100.0], [1040.0, 900.0]]]
    town = [feature("source", "Point", [1000.0, 1000.0], id="s"), feature("oks_connection_point", "Point", [1100.0, 1000.0], id="p", oks_id="b", flow_tph=3.0)]
    path = written(tmp_path, [*town, feature("restriction", "Polygon", road, restriction_type="road")])
    pipes = run(spark, path).pipes.collect()
    assert sum(p["length"] for p in pipes) == pytest.approx(100) and sum(p["length"] * p["k_spec"] for p in pipes) == pytest.approx(100 + 0.6 * 26)
    assert sum(p["cost"] for p in pipes) == pytest.approx((100 + 0.6 * 26) * 74023) and {p["laying_method"] for p in pipes} == {"special"}


def test_collections_with_equal_and_no_orders(spark, tmp_path):
    rows = spark.createDataFrame([(None, "1"), ("a", "2"), ("a", "3"), ("a", "4"), ("b", "5"), (None, "6")], "k string, feature string").repartition(3)
    geojson.write_collection(rows, "k", str(tmp_path), "n")
    found = json.loads("".join(p.read_text() for p in sorted(tmp_path.glob("*/part-*"))))["features"]
    assert set(found[:2]) == {1, 6} and set(found[2:5]) == {2, 3, 4} and found[5] == 5
