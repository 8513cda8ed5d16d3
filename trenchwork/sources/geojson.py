"""GeoJSON feature collections to a features table and back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as r
from ..store import materialize

# The property names that each field may have, in order.
ALIASES = {
    "id": ["id", "ID", "object_id", "OBJECTID", "fid"],
    "kind": ["object_type", "feature_type", "type", "layer", "class", "kind"],
    "dn": ["diameter", "dn", "DN", "diametr", "d_u", "Dy"],
    "flow": ["flow_tph", "flow", "q", "G", "existing_flow", "design_flow"],
    "next_id": ["upstream_object_id", "next_id", "nextId", "next_object_id", "id_next"],
    "heat_load": ["heat_load", "Q", "nagruzka"],
    "oks_id": ["oks_id", "oksId", "building_id", "id_oks", "parent_id"],
    "constraint_type": ["restriction_type", "constraint_type", "type"],
    "name": ["name", "title", "nazvanie", "address"],
}
_FILE = "type string, name string, features array<struct<type string, id string, geometry struct<type string, coordinates string>, properties string>>"


def _numbers(text: Column) -> Column:
    """The first two numbers of each position, flat: every position of any shape is ``[x, y, ...]``."""
    positions = F.regexp_extract_all(text, F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(0))
    return F.transform(positions, lambda p: F.struct(F.regexp_extract(p, r"\[\s*(-?[0-9.eE+-]+)", 1).cast("double").alias("x"), F.regexp_extract(p, r",\s*(-?[0-9.eE+-]+)", 1).cast("double").alias("y")))


def features_of(raw: DataFrame) -> DataFrame:
    """Rows of struct ``f`` (type, id, geometry, properties) and ``ord`` to typed features."""
    props = F.from_json("f.properties", "map<string,string>")
    base = raw.select("ord", F.col("f.id").alias("feature_id"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.coalesce(props, F.create_map().cast("map<string,string>")).alias("props"))
    text, number = (lambda n: r.alias_text(F.col("props"), ALIASES[n])), (lambda n: r.alias_number(F.col("props"), ALIASES[n]))
    typed = base.select(
        "ord", F.coalesce(text("id"), "feature_id").alias("id"), text("name").alias("name"), text("kind").alias("kind_text"),
        number("dn").cast("int").alias("dn"), number("flow").alias("flow"), number("heat_load").alias("heat_load"), text("next_id").alias("next_id"),
        text("oks_id").alias("oks_id"), text("constraint_type").alias("constraint_text"), "geometry_type", _numbers(F.col("coordinates")).alias("path"), "coordinates",
    )
    kind = r.feature_kind(F.col("kind_text"), F.col("geometry_type"), F.col("flow"), F.col("next_id"), F.col("oks_id"))
    edge = lambda f, a: f(F.transform("path", lambda p: p[a]))
    return typed.withColumn("kind", kind).withColumns({"min_x": edge(F.array_min, "x"), "min_y": edge(F.array_min, "y"), "max_x": edge(F.array_max, "x"), "max_y": edge(F.array_max, "y")})


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The features of FeatureCollection files, in file order; mixed shapes stay text until typed."""
    files = spark.read.option("multiLine", True).schema(_FILE).json(path)
    return features_of(files.select(F.posexplode("features").alias("ord", "f")))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of newline-delimited files, one a line: these split, so one file can use many tasks."""
    schema = "type string, id string, geometry struct<type string, coordinates string>, properties string"
    lines = spark.read.schema(schema).json(path)
    return features_of(lines.select(F.monotonically_increasing_id().alias("ord"), F.struct("type", "id", "geometry", "properties").alias("f")))


def ingest_stats(features: DataFrame) -> DataFrame:
    """(kind, n, min_x, min_y, max_x, max_y) for each kind, UNKNOWN among them, and for all as ``ALL``."""
    sums = [F.count("*").alias("n"), *[getattr(F, c[:3])(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]]
    by_kind = features.groupBy("kind").agg(*sums)
    return by_kind.unionByName(by_kind.groupBy(F.lit("ALL").alias("kind")).agg(F.sum("n").alias("n"), *sums[1:]))


def page(features: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit in the stable order of a column."""
    return features.orderBy(order).offset(max(0, offset)).limit(max(1, limit))


def json_id(text: Column) -> Column:
    """An id as JSON: a number if it looks like one of at most 18 digits, else a string."""
    return F.when(text.rlike(r"^-?[0-9]{1,18}$"), text).otherwise(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"')))


def own_id(variant: Column, text: Column, created: Column) -> Column:
    """Ids made in a variant get its prefix, ids of the input stay."""
    return F.when(created, F.concat(variant.cast("string"), F.lit("-"), text)).otherwise(text)


def write_collection(features: DataFrame, order: str, path: str, name: str) -> None:
    """Feature texts (column ``feature``) in the order of a column, as the parts of one FeatureCollection: a head, sorted
    parts and a tail, whose texts in the order of their paths are the file. No part holds more than its range.

    Rows of equal order stand together in no order, those without one come first. Sorted rows are numbered by their places,
    so that every feature but one has a comma before it, whatever their orders are.
    """
    spark = features.sparkSession
    sorted_ = features.repartitionByRange(F.asc_nulls_first(order)).sortWithinPartitions(F.asc_nulls_first(order))
    placed = materialize(sorted_.select("feature", F.monotonically_increasing_id().alias("place")), "collection")
    first = placed.agg(F.min("place")).first()[0]
    lines = placed.repartitionByRange("place").sortWithinPartitions("place")
    lines.select(F.concat(F.when(F.col("place") == F.lit(first), "").otherwise(","), "feature").alias("value")).write.mode("overwrite").text(f"{path}/1-features")
    for part, text in (("0-head", f'{{"type":"FeatureCollection","name":{json.dumps(name)},"features":['), ("2-tail", "]}")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{part}")


_POINT = "array<double>"
_NESTING = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def rings(kind: Column, coordinates: Column) -> Column:
    """The lines or rings of a geometry's coordinates, as an array of (part, ring, path): a polygon's part is its place
    in a multi-polygon, and its first ring the outer one; null for other shapes. A third coordinate is left out."""
    place = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line = lambda part, ring, path: F.struct(part.cast("int").alias("part"), ring.cast("int").alias("ring"), F.transform(path, place).alias("path"))
    read = lambda depth: F.from_json(coordinates, "array<" * depth + _POINT + ">" * depth)
    zero = F.lit(0)
    out = F.lit(None)
    for shape, depth in _NESTING.items():
        text = read(depth)
        if depth == 0:
            value = F.array(line(zero, zero, F.array(text)))
        elif depth == 1:
            value = F.array(line(zero, zero, text))
        elif depth == 2:
            value = F.transform(text, lambda ring, i: line(zero, i, ring))
        else:
            value = F.flatten(F.transform(text, lambda polygon, p: F.transform(polygon, lambda ring, i: line(p, i, ring))))
        out = F.when(kind == shape, value).otherwise(out)
    return out


def geometry_text(kind: Column, lines: Column) -> Column:
    """GeoJSON of the shapes that ``rings`` reads, each with the nesting that its type demands."""
    position = lambda p: F.array(p["x"], p["y"])
    paths = lambda found: F.transform(found, lambda r: F.transform(r["path"], position))
    parts = F.transform(F.sequence(F.lit(0), F.array_max(F.transform(lines, lambda r: r["part"]))), lambda p: paths(F.filter(lines, lambda r: r["part"] == p)))
    body = (
        F.when(kind == "Point", F.to_json(paths(lines)[0][0])).when(kind.isin("LineString", "MultiPoint"), F.to_json(paths(lines)[0]))
        .when(kind == "MultiPolygon", F.to_json(parts)).otherwise(F.to_json(paths(lines)))
    )
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), body, F.lit("}"))


# Properties of result features, in the order of the contract.
PIPE_FIELDS = ("flow_tph", "diameter", "length", "laying_method", "depth_start", "depth_end", "cost")
SUMMARY_FIELDS = (
    "rank", "construction_cost", "chamber_construction_cost", "existing_chamber_tie_in_count", "existing_chamber_tie_in_cost", "unconnected_penalty", "calculated_cost", "new_network_length", "score", "unconnected_oks_ids",
)


def summaries(variants: DataFrame) -> DataFrame:
    """The summary feature of each variant (variant_id, rank, pipes, chambers, tie_in_count, tie_ins, penalty, total, length, score,
    unconnected: ids), money to hundredths and the score to thousandths. Its id is ``summary_`` and the variant's number."""
    money = lambda c: r.rounded(F.col(c).cast("double"), 2)
    return variants.select(
        F.lit(4).alias("ord"), F.lit("variant_summary").alias("object_type"), "variant_id", json_id(F.concat(F.lit("summary_"), F.col("variant_id").cast("string"))).alias("id"),
        F.col("rank").cast("int").alias("rank"), money("pipes").alias("construction_cost"), money("chambers").alias("chamber_construction_cost"),
        F.col("tie_in_count").cast("long").alias("existing_chamber_tie_in_count"), money("tie_ins").alias("existing_chamber_tie_in_cost"), money("penalty").alias("unconnected_penalty"),
        money("total").alias("calculated_cost"), money("length").alias("new_network_length"), r.rounded(F.col("score"), 3).alias("score"), F.array_sort("unconnected").alias("unconnected_oks_ids"),
    )


def exported(segments: DataFrame, chambers: DataFrame, nodes: DataFrame, variants: DataFrame, most: int = 3) -> DataFrame:
    """The features of the ``most`` best variants by rank (variants: see ``summaries``), with all fields of the contract: those
    of ``result_features``, pipes with flow_tph, diameter and laying_method (of segments with flow, dn, laying_method), chambers
    with their diameter, and the summaries."""
    best = variants.where(F.col("rank") <= most)
    of_best = lambda df: df.join(best.select("variant_id"), "variant_id", "left_semi")
    segments, chambers, nodes = of_best(segments), of_best(chambers), of_best(nodes)
    rows = result_features(segments, chambers, nodes).where("ord < 4")
    own = json_id(own_id(F.col("variant_id"), F.col("id"), F.lit(True)))
    more = segments.select("variant_id", own.alias("id"), F.lit(1).alias("ord"), r.rounded(F.col("flow"), 3).alias("flow_tph"), F.col("dn").alias("diameter"), "laying_method")
    more = more.unionByName(chambers.select("variant_id", own.alias("id"), F.lit(2).alias("ord"), F.col("dn").alias("diameter")), allowMissingColumns=True)
    return rows.join(more, ["variant_id", "id", "ord"], "left").unionByName(summaries(best), allowMissingColumns=True)


def result_features(segments: DataFrame, chambers: DataFrame, nodes: DataFrame) -> DataFrame:
    """The features of a combined result (ord, object_type, variant_id, id, start_node_id, end_node_id, length, depth_start,
    depth_end, cost): pipes from the network's side on, chambers, technical nodes, and a summary of each variant.

    Ids of chambers and nodes made in a variant get its number before them, wherever they stand; other ids are the input's.
    A depth that is known at one end only holds at the other too.
    """
    own = chambers.select("variant_id", "id").unionByName(nodes.select("variant_id", "id")).distinct()
    end = lambda c: own.select("variant_id", F.col("id").alias(c), F.lit(True).alias(f"_{c}"))
    joined = segments.join(end("from_id"), ["variant_id", "from_id"], "left").join(end("to_id"), ["variant_id", "to_id"], "left")
    out = lambda c: json_id(own_id(F.col("variant_id"), F.col(c), F.coalesce(f"_{c}", F.lit(False))))
    made = json_id(own_id(F.col("variant_id"), F.col("id"), F.lit(True)))
    pipes = joined.select(
        F.lit(1).alias("ord"), F.lit("heat_network").alias("object_type"), "variant_id", made.alias("id"), out("to_id").alias("start_node_id"), out("from_id").alias("end_node_id"),
        r.rounded(F.col("length"), 2).alias("length"), r.rounded(F.coalesce("depth_to", "depth_from"), 4).alias("depth_start"), r.rounded(F.coalesce("depth_from", "depth_to"), 4).alias("depth_end"), r.rounded(F.col("cost"), 2).alias("cost"),
    )
    built = chambers.select(F.lit(2).alias("ord"), F.lit("heat_chamber").alias("object_type"), "variant_id", made.alias("id"), r.rounded(F.col("cost"), 2).alias("cost"))
    technical = nodes.select(F.lit(3).alias("ord"), F.lit("technical_node").alias("object_type"), "variant_id", made.alias("id"))
    hundredths = lambda c: (F.sum(F.floor(F.col(c) * 100 + 0.5)).cast("double") / 100).alias(c)
    summary = segments.groupBy("variant_id").agg(hundredths("length"), hundredths("cost")).select(F.lit(4).alias("ord"), F.lit("variant_summary").alias("object_type"), "variant_id", json_id(F.col("variant_id").cast("string")).alias("id"), "length", "cost")
    features = pipes
    for part in (built, technical, summary):
        features = features.unionByName(part, allowMissingColumns=True)
    return features
