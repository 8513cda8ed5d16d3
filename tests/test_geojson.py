"""Reading and writing feature collections."""

import json

from pyspark.sql import functions as F

from trenchwork.sources import geojson
from trenchwork.streaming.arrivals import arriving_kinds

FEATURES = [
    {"type": "Feature", "id": "boiler", "geometry": {"type": "Point", "coordinates": [30.1, 59.9]}, "properties": {"feature_type": "source", "id": "boiler"}},
    {"type": "Feature", "id": "main-4", "geometry": {"type": "LineString", "coordinates": [[30.1, 59.9, 1.5], [30.2, 59.8]]}, "properties": {"feature_type": "existing_segment", "dn": 300, "existing_flow": "61,25"}},
    {"type": "Feature", "id": 81, "geometry": {"type": "Polygon", "coordinates": [[[5, 2], [9, 2], [9, 6], [5, 2]], [[7, 3], [8, 3], [8, 4], [7, 3]]]}, "properties": {"feature_type": "oks", "design_flow": 3.75}},
    {"type": "Feature", "geometry": None, "properties": {"note": "nothing"}},
]


def test_read(spark, tmp_path):
    path = tmp_path / "in.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "name": "n", "features": FEATURES}))
    got = geojson.read_features(spark, str(path)).orderBy("ord").collect()
    assert [(r["id"], r["kind"]) for r in got] == [("boiler", "SOURCE"), ("main-4", "EXISTING_SEGMENT"), ("81", "OKS_PROSPECTIVE"), (None, "UNKNOWN")]
    assert (got[1]["dn"], got[1]["flow"], got[2]["flow"]) == (300, 61.25, 3.75)
    assert [tuple(p) for p in got[1]["path"]] == [(30.1, 59.9), (30.2, 59.8)]
    assert (got[2]["min_x"], got[2]["max_y"], got[3]["min_x"]) == (5, 6, None)
    stats = {r["kind"]: (r["n"], r["max_x"]) for r in geojson.ingest_stats(geojson.read_features(spark, str(path))).collect()}
    assert stats == {"SOURCE": (1, 30.1), "EXISTING_SEGMENT": (1, 30.2), "OKS_PROSPECTIVE": (1, 9), "UNKNOWN": (1, None), "ALL": (4, 30.2)}
    lines = tmp_path / "in.jsonl"
    lines.write_text("\n".join(map(json.dumps, FEATURES)))
    assert [r["id"] for r in geojson.read_feature_lines(spark, str(lines)).orderBy("ord").collect()] == ["boiler", "main-4", "81", None]


def test_rings_keep_apart(spark):
    shapes = [("Point", "[1, 2]"), ("LineString", "[[1,2],[3,4]]"), ("Polygon", "[[[0,0],[4,0],[4,4],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]"), ("MultiPolygon", "[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5,9],[6,5],[6,6],[5,5]]]]"), (None, None)]
    df = spark.createDataFrame(shapes, "geometry_type string, coordinates string")
    got = [r[0] for r in df.select(geojson.rings(F.col("geometry_type"), F.col("coordinates"))).collect()]
    assert [None if g is None else [(r["part"], r["ring"], len(r["path"])) for r in g] for g in got] == [[(0, 0, 1)], [(0, 0, 2)], [(0, 0, 4), (0, 1, 4)], [(0, 0, 4), (1, 0, 4)], None]
    assert tuple(got[3][1]["path"][0]) == (5, 5)
    text = df.where("geometry_type = 'Polygon'").select(geojson.geometry_text(F.col("geometry_type"), geojson.rings(F.col("geometry_type"), F.col("coordinates")))).first()[0]
    assert json.loads(text) == {"type": "Polygon", "coordinates": json.loads(shapes[2][1])}


def test_ids(spark):
    ids = ["7", "-12", "007", "NS-1", "1234567890123456789"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(geojson.json_id(F.col("i"))).collect()]
    assert got == ["7", "-12", "007", '"NS-1"', '"1234567890123456789"']


def test_collection(spark, tmp_path):
    """A collection is its head, sorted parts of features and its tail, which read as one text."""
    df = spark.createDataFrame([(i, f'{{"id":{i}}}') for i in (2, 1, 4, 3)], "ord int, feature string")
    geojson.write_collection(df, "ord", str(tmp_path / "out"), "result")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*/part-*")))
    got = json.loads(text)
    assert [f["id"] for f in got["features"]] == [1, 2, 3, 4] and got["name"] == "result"


def test_arrivals(spark, tmp_path):
    folder = tmp_path / "arrivals"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(f) for f in FEATURES[:2]))
    stream = arriving_kinds(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("kinds").start()
    stream.processAllAvailable()
    (folder / "b.json").write_text(json.dumps(FEATURES[0]))
    stream.processAllAvailable()
    stream.stop()
    assert {r["kind"]: r["n"] for r in spark.table("kinds").collect()} == {"SOURCE": 2, "EXISTING_SEGMENT": 1}
