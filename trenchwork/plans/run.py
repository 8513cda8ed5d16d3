"""From a GeoJSON file to a priced plan and its features: ``run(spark, path)``.

Sources, chambers, places on existing pipes and consumers become nodes; corners of what must be kept clear of become nodes too.
The forest over the legs between them is sized, priced, laid and put out as result features.

Defined results: files of a folder are one scene; features without a geometry, or of one that is not known, take no part; a
null or repeated id changes nothing, as nodes have numbers of their own; a consumer without a flow needs 0; a scene without
sources or chambers leaves all consumers unconnected, one without consumers gives a plan without pipes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..functions import geometry as g
from ..functions import rules as r
from ..operators import costing, crossings, depth, network, routes, spatial, topology, utilities
from ..sources import geojson
from ..store import materialize

MODES = ("PLAN_2D", "PLAN_3D")


@dataclass(frozen=True)
class Result:
    """A row for the plan (costs and score), its pipes, and the features as GeoJSON texts (ord, feature)."""

    plan: DataFrame
    pipes: DataFrame
    features: DataFrame


def _projected(features: DataFrame) -> tuple[DataFrame, bool]:
    """Features with their lines and rings in metres (``lines``), and whether the file is in degrees."""
    box = features.agg(F.min("min_x").alias("a"), F.min("min_y").alias("b"), F.max("max_x").alias("c"), F.max("max_y").alias("d"))
    degrees = bool(box.select(crs.is_geographic(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0])

    def place(p):
        x, y = crs.to_metres(p["x"], p["y"]) if degrees else (p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    read = geojson.rings(F.col("geometry_type"), F.col("coordinates"))
    moved = F.transform(read, lambda line: F.struct(line["part"].alias("part"), line["ring"].alias("ring"), F.transform(line["path"], place).alias("path")))
    return features.withColumn("lines", moved).withColumn("node", F.monotonically_increasing_id()), degrees


def _middle(path):
    """The mean of a path's points (of a closed ring, of all but the last)."""
    n = F.greatest(F.size(path) - F.when(F.size(path) > 1, F.when(path[0] == path[F.size(path) - 1], 1).otherwise(0)).otherwise(0), F.lit(1))
    total = lambda axis: F.aggregate(F.slice(path, F.lit(1), n), F.lit(0.0), lambda s, p: s + p[axis]) / n
    return total("x"), total("y")


#: Up to so many places, all are joined with each other; beyond, those within REACH, with a lattice of STEP metres between them.
FEW, REACH, STEP = 8000, 500.0, 400.0
#: Consumers look so far for existing pipes to join.
TAP_REACH = 250.0


def _edges(lines: DataFrame, *more: str) -> DataFrame:
    """(node, more, ord, x0, y0, x1, y1): the edges of lines and rings."""
    each = lines.select("node", *more, F.explode("lines").alias("line"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("line.path") - 1), lambda i: F.struct(i.alias("ord"), F.col("line.path")[i - 1].alias("a"), F.col("line.path")[i].alias("b")))
    e = each.where(F.size("line.path") > 1).select("node", *more, F.explode(pairs).alias("e"))
    return e.select("node", *more, "e.ord", *[F.col(f"e.{p}.{axis}").alias(f"{axis}{k}") for k, p in enumerate("ab") for axis in "xy"])


def _taps(consumers: DataFrame, chambers: DataFrame, pipes: DataFrame) -> DataFrame:
    """(node, x, y, dn): the nearest place of an existing pipe to each consumer, where a chamber would be built. Nodes are negative."""
    legs = pipes.select(F.struct("node", "ord").alias("site"), "x0", "y0", "x1", "y1")
    ends = pipes.select(F.col("node").alias("segment"), "dn", "x0", "y0", "x1", "y1")
    places = chambers.select(F.col("node").alias("id"), "x", "y").join(topology.chamber_adjacency(chambers.select(F.col("node").alias("id"), "x", "y"), ends), "id")
    known = places.select(F.struct(F.col("id").alias("node"), F.lit(0).alias("ord")).alias("site"), "x", "y", F.col("incident").alias("degree"))
    options = spatial.tie_in_options(consumers.select(F.col("node").alias("id"), "x", "y"), known, legs, TAP_REACH).where("at is not null")
    best = spatial.ranked_options(options, 1).join(pipes.select(F.struct("node", "ord").alias("site"), "x0", "y0", "x1", "y1", "dn"), "site")
    along = lambda axis: F.col(f"{axis}0") + F.col("at") * (F.col(f"{axis}1") - F.col(f"{axis}0"))
    return best.select((-F.pmod(F.xxhash64(F.lit("tap"), "site", "at"), F.lit(1 << 61)) - 1 - (1 << 61)).alias("node"), along("x").alias("x"), along("y").alias("y"), "dn").dropDuplicates(["node"])


def _zones(features: DataFrame, existing: DataFrame, dn: int, rules: r.Rules) -> DataFrame:
    """The edges of zones that may be crossed at a price, as ``crossings.zone_bands`` takes them; existing pipes are such zones too."""
    c = F.col
    value = lambda place, kind: r.restriction_value(c("rule"), place, rules).cast(kind)
    special = features.where(c("kind") == "CONSTRAINT").withColumn("rule", r.restriction_rule(F.coalesce("constraint_text", F.lit("default")), rules))
    special = special.where(value(1, "string") != "AVOID").withColumn("area", F.lower("geometry_type").contains("polygon"))
    lines = _edges(special, "rule", "area").select("node", "rule", "area", F.lit(False).alias("existing"), F.lit(0.0).alias("foreign"), "x0", "y0", "x1", "y1")
    old = existing.select("node", F.lit("heat_network").alias("rule"), F.lit(False).alias("area"), F.lit(True).alias("existing"), r.pipe_width(F.coalesce("dn", F.lit(depth.HEAT_DN)), rules).cast("double").alias("foreign"), "x0", "y0", "x1", "y1")
    clear = crossings.needed_clearance(c("rule"), F.lit(dn), c("foreign"), rules).cast("double")
    return lines.unionByName(old).select(
        c("node").alias("zone"), c("x0").alias("ox0"), c("y0").alias("oy0"), c("x1").alias("ox1"), c("y1").alias("oy1"), "area", "existing",
        F.greatest(value(4, "double"), F.lit(1.0)).alias("k"), value(5, "double").alias("extend"), F.sin(F.radians(value(6, "double"))).alias("least_sine"), clear.alias("clear"),
    )


def _admissible(legs: DataFrame, places: DataFrame, ends: DataFrame, joined: DataFrame, zones: DataFrame) -> DataFrame:
    """(a, b, far, metres, k_spec) of the legs that cross zones as they must: their length, the same in metres of plain pipe, and
    the factor that makes their price that of their special and plain parts together.

    A leg that begins or ends within a band, at a consumer or a root, may leave it without crossing the zone.
    """
    c = F.col
    spot = lambda name, k: places.select(c("node").alias(name), c("x").alias(f"x{k}"), c("y").alias(f"y{k}"))
    mark = lambda df, name, out: df.select(c("node").alias(name), F.lit(True).alias(out)).distinct()
    placed = legs.join(spot("a", 0), "a").join(spot("b", 1), "b")
    for name, tap, end in (("a", "tap0", "_end0"), ("b", "tap1", "_end1")):
        placed = placed.join(mark(joined, name, tap), name, "left").join(mark(ends, name, end), name, "left")
    placed = placed.fillna(False, ["tap0", "tap1", "_end0", "_end1"]).withColumn("id", F.struct("a", "b"))
    placed = materialize(placed.select("id", "x0", "y0", "x1", "y1", "tap0", "tap1", "_end0", "_end1", c("metres").alias("far")), "plan-legs-placed")
    bands = materialize(crossings.zone_bands(placed.drop("_end0", "_end1", "far"), zones), "plan-bands")
    at_end = (c("_end0") & (c("b0") <= 1e-6)) | (c("_end1") & (c("b1") >= c("far") - 1e-6))
    seen = bands.join(placed.select("id", "far", "_end0", "_end1"), "id")
    refused = seen.where(~c("admissible") & ~(at_end & (c("special") == 0) & c("first").isNull())).select("id").distinct()
    spans = bands.where("special > 0").select(c("id").alias("path"), c("first").alias("s0"), c("last").alias("s1"), "k", "zone")
    extra = crossings.crossing_extra(spans).select(c("path").alias("id"), "extra")
    kept = placed.join(refused, "id", "left_anti").join(extra, "id", "left").fillna(0.0, ["extra"])
    return kept.select("id.a", "id.b", "far", (c("far") + c("extra")).alias("metres"), (1 + c("extra") / c("far")).alias("k_spec"))


def run(spark: SparkSession, path: str, mode: str = "PLAN_2D", to: str | None = None, rules: r.Rules = r.DEFAULT) -> Result:
    """Read the files, connect every prospective building that can be reached, and price the plan.

    Pipes keep the clearance that the rules demand for the diameter of the whole demand. In mode PLAN_3D they are laid past
    the utilities that they cross. ``to`` names a folder for the collection.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    features, degrees = _projected(geojson.read_features(spark, path))
    features = materialize(features.where("lines is not null and size(lines) > 0"), "scene")
    x, y = _middle(F.col("lines")[0]["path"])
    of = lambda *kinds: features.where(F.col("kind").isin(*kinds))
    points = of("CONNECTION_POINT").select(F.struct(x.alias("x"), y.alias("y")).alias("point"), "oks_id", "id", "flow", "node")
    buildings = of("OKS_PROSPECTIVE").select("node", "id", "flow", x.alias("mx"), y.alias("my"))
    # The connection point of a building, or else its middle; a point without a building is a consumer by itself.
    first = points.groupBy("oks_id").agg(F.min(F.struct("point", "flow")).alias("p")).where("oks_id is not null")
    joined = buildings.join(first.select(F.col("oks_id").alias("id"), F.col("p.point").alias("point"), F.col("p.flow").alias("_flow")), "id", "left")
    flow = F.when(F.coalesce("flow", F.lit(0.0)) > 0, F.col("flow")).otherwise(F.coalesce("_flow", "flow", F.lit(0.0)))
    consumers = joined.select("node", "id", flow.alias("flow"), F.coalesce("point.x", "mx").alias("x"), F.coalesce("point.y", "my").alias("y"))
    alone = points.join(buildings.select(F.col("id").alias("oks_id")), "oks_id", "left_anti")
    consumers = consumers.unionByName(alone.select("node", F.coalesce("oks_id", "id").alias("id"), F.coalesce("flow", F.lit(0.0)).alias("flow"), F.col("point.x").alias("x"), F.col("point.y").alias("y")))
    consumers = materialize(consumers, "consumers")
    existing = materialize(_edges(of("EXISTING_SEGMENT"), "id", "dn"), "existing")
    chambers = of("CHAMBER").select("node", "id", x.alias("x"), y.alias("y"))
    taps = materialize(_taps(consumers, chambers, existing), "taps")
    roots = of("SOURCE").select("node", "id", x.alias("x"), y.alias("y")).unionByName(chambers).unionByName(taps.select("node", F.lit(None).cast("string").alias("id"), "x", "y"))
    roots = materialize(roots, "roots")
    widest = costing.design_dn(consumers.select(F.lit(1).alias("plan"), "flow", F.lit(True).alias("connected")), "plan", rules).first()
    dn = widest["dn"] if widest else rules.diameters[0][0]
    rule = r.restriction_rule(F.coalesce("constraint_text", F.when(F.col("kind") == "OKS_EXISTING", "oks_existing"), F.lit("default")), rules)
    avoided = of("CONSTRAINT", "OKS_EXISTING").where(F.lower("geometry_type").contains("polygon")).withColumn("rule", rule).where(r.restriction_value(F.col("rule"), 1, rules) == "AVOID")
    kept_clear = avoided.select("node", F.explode("lines").alias("line"), crossings.needed_clearance(F.col("rule"), F.lit(dn), F.lit(0.0), rules).cast("double").alias("clear"))
    areas = materialize(kept_clear.select(F.concat_ws("-", "node", "line.part").alias("polygon"), F.col("line.path").alias("ring"), (F.col("line.ring") > 0).alias("inner"), "clear"), "areas")
    walls = routes.walls_of(areas)
    ends = materialize(roots.select("node", "x", "y").unionByName(consumers.select("node", "x", "y")), "ends")
    numbered = lambda df: df.select((-F.pmod(F.xxhash64("x", "y"), F.lit(1 << 61)) - 1).alias("node"), "x", "y").dropDuplicates(["node"])
    free = lambda df: df.join(routes.too_near(df.withColumnRenamed("node", "id"), walls, 50.0).select(F.col("id").alias("node")).distinct(), "node", "left_anti")
    shell = materialize(free(numbered(routes.corners(areas, F.col("clear")))), "corners")
    if ends.count() + shell.count() <= FEW:
        box = ends.unionByName(shell).agg((F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("far")).first()["far"]
        places, reach = ends.unionByName(shell), max(box or 0.0, 1.0)
    else:
        more = routes.corners(areas, F.col("clear"), STEP).select("x", "y").unionByName(routes.lattice(ends, STEP))
        places, reach = ends.unionByName(free(numbered(more))), REACH
    places = materialize(places, "places")
    legs = materialize(routes.legs(places.withColumnRenamed("node", "id"), areas, reach), "plan-legs")
    zones = materialize(_zones(features, existing, dn, rules), "zones")
    legs = materialize(_admissible(legs, places, ends, chambers.select("node").unionByName(taps.select("node")), zones), "plan-admissible")
    tree = routes.steiner_forest(legs.select("a", "b", "metres"), consumers.select("node"), roots.select("node"))
    # The search goes by metres of plain pipe; a pipe is as long as it is, and its special metres have their own price.
    own = legs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("parent")), F.struct(F.col("b").alias("node"), F.col("a").alias("parent")))).alias("e"), F.col("far").alias("length"), "k_spec").select("e.*", "length", "k_spec")
    tree = tree.drop("length").join(own, ["node", "parent"], "left").withColumns({"length": F.coalesce("length", F.lit(0.0)), "k_spec": F.coalesce("k_spec", F.lit(1.0))})
    tree = materialize(tree, "plan-tree")
    carried = tree.join(consumers.select("node", "flow"), "node", "left").fillna(0.0, ["flow"])
    flows = network.subtree_sums(carried, "flow").select("node", F.col("total").alias("flow"))
    sized = network.run_limited_dn(tree.join(flows, "node"), rules)
    spot = lambda name: places.select(F.col("node").alias(name), F.struct("x", "y").alias(f"_{name}"))
    pipes = tree.where("parent is not null").join(flows, "node").join(sized, "node").join(spot("node"), "node").join(spot("parent"), "parent")
    pipes = materialize(pipes.select("node", "parent", "length", "k_spec", "flow", "dn", "_node", "_parent"), "plan-pipes")
    named = roots.select("node", "id").unionByName(consumers.select("node", "id")).where("id is not null").dropDuplicates(["node"])
    label = lambda c: F.coalesce(F.col(f"_{c}_id"), F.concat(F.lit("P"), F.abs(F.col(c)).cast("string")))
    for c in ("node", "parent"):
        pipes = pipes.join(named.select(F.col("node").alias(c), F.col("id").alias(f"_{c}_id")), c, "left")
    pipes = pipes.select("*", label("node").alias("from_id"), label("parent").alias("to_id"))
    if mode == "PLAN_3D":
        pipes = _laid(features, tree, materialize(pipes, "plan-flat"), existing, chambers.select("node").unionByName(taps.select("node")), rules)
    else:
        none = F.lit(None).cast("double")
        pipes = pipes.select("*", F.lit(1).alias("piece"), none.alias("depth_from"), none.alias("depth_to"), F.array("_parent", "_node").alias("path"))
    price = costing.pipe_cost(F.col("length"), F.col("dn"), F.col("k_spec"), F.col("depth_from"), F.col("depth_to"), rules)
    own = F.concat(F.lit("S"), F.abs("node").cast("string"), F.when(F.col("piece") > 1, F.concat(F.lit("-"), F.col("piece").cast("string"))).otherwise(""))
    segments = pipes.withColumns({"variant_id": F.lit(1).cast("long"), "laying_method": F.when(F.col("k_spec") > 1, "special").otherwise("new"), "id": own}).withColumn("cost", price)
    segments = materialize(segments, "plan-segments")
    # Where pipes meet that is no place of the input, and where they join an existing pipe, a chamber is built.
    meets = segments.where("_parent_id is null and piece = 1").groupBy("variant_id", F.col("to_id").alias("id"), F.col("parent").alias("node")).agg(F.count("*").alias("n"), F.max("dn").alias("dn"))
    tapped = meets.join(taps.select("node", F.col("dn").alias("_old")), "node", "left").where("n > 1 or _old is not null")
    built = tapped.select("variant_id", "id", F.greatest("dn", "_old").alias("dn"))
    built = materialize(built.withColumn("cost", r.chamber_price(F.col("dn"), rules)), "plan-chambers")
    tied = segments.where("piece = 1").join(chambers.select(F.col("node").alias("parent")), "parent", "left_semi").select("variant_id")
    left = materialize(consumers.join(tree.select("node"), "node", "left_anti").select(F.lit(1).cast("long").alias("variant_id"), "flow", "id"), "unconnected")
    costs = costing.roll_up(segments, built.select("variant_id", "id", "dn"), tied, left, "variant_id", rules)
    # The ids of a plan's unconnected consumers are one field of its summary.
    lost = left.groupBy("variant_id").agg(F.array_sort(F.collect_list("id")).alias("unconnected_ids"))
    scored = costing.breakdown(costs).join(lost, "variant_id", "left")
    plan = materialize(scored.withColumn("score", r.rounded(costing.score(F.col("total"), F.col("length"), rules), 3)).withColumn("rank", F.lit(1)), "plan")
    inner = segments.where("_parent_id is null or piece > 1").select("variant_id", F.col("to_id").alias("id")).distinct()
    nodes = inner.join(built.select("variant_id", "id"), ["variant_id", "id"], "left_anti")
    variants = plan.withColumn("unconnected", F.coalesce("unconnected_ids", F.array().cast("array<string>")))
    rows = geojson.exported(segments, built, nodes, variants)
    texts = _texts(rows, segments, degrees)
    if to is not None:
        geojson.write_collection(texts, "place", to, "result")
    return Result(plan, segments, texts)


def _laid(features: DataFrame, tree: DataFrame, pipes: DataFrame, existing: DataFrame, joined: DataFrame, rules: r.Rules) -> DataFrame:
    """Pipes cut into pieces with their depths; places between pieces have ids of their own."""
    c = F.col
    marked = features.where(c("kind") == "CONSTRAINT").withColumns({"_kind": depth.obstacle_kind(c("constraint_text")), "area": F.lower("geometry_type").contains("polygon")}).where("_kind is not null")
    ends = [c(f"{axis}{k}").alias(f"o{axis}{k}") for k in "01" for axis in "xy"]
    lines = _edges(marked, "_kind", "area", "dn").select(c("node").alias("obstacle"), c("_kind").alias("kind"), "area", "dn", F.lit(None).cast("double").alias("top"), *ends)
    old = existing.select(c("node").alias("obstacle"), F.lit("HEAT").alias("kind"), F.lit(False).alias("area"), "dn", F.lit(None).cast("double").alias("top"), *ends)
    legs = pipes.select(c("node").alias("path"), F.lit(1).alias("ord"), c("_parent.x").alias("x0"), c("_parent.y").alias("y0"), c("_node.x").alias("x1"), c("_node.y").alias("y1"), "dn")
    joints = pipes.join(joined.select(c("node").alias("parent")), "parent", "left_semi").select(c("node").alias("path"), F.lit(True).alias("at_start"))
    pieces = materialize(utilities.laid_together(tree, legs, materialize(lines.unionByName(old), "utilities"), joints, rules), "plan-pieces")
    cut = utilities.sliced(legs, pieces).select("path", "piece", F.struct(c("x0").alias("x"), c("y0").alias("y")).alias("_a"), F.struct(c("x1").alias("x"), c("y1").alias("y")).alias("_b"))
    last = pieces.groupBy("path").agg(F.max("piece").alias("_last"))
    whole = pipes.withColumnRenamed("node", "path").drop("length").join(pieces, "path").join(cut, ["path", "piece"]).join(last, "path")
    spot = lambda at: F.concat(F.lit("T"), F.abs("path").cast("string"), F.lit("-"), at.cast("string"))
    from_id = F.when(c("piece") == c("_last"), c("from_id")).otherwise(spot(c("piece")))
    to_id = F.when(c("piece") == 1, c("to_id")).otherwise(spot(c("piece") - 1))
    # Depths of pieces are given from the network's side on; those of pipes from the other.
    made = whole.select(
        c("path").alias("node"), "parent", (c("s1") - c("s0")).alias("length"), "k_spec", "flow", "dn", "_node_id", "_parent_id", from_id.alias("from_id"), to_id.alias("to_id"), "piece",
        c("depth_to").alias("_d1"), c("depth_from").alias("_d0"), F.array("_a", "_b").alias("path"),
    )
    return made.withColumnsRenamed({"_d1": "depth_from", "_d0": "depth_to"})


def _texts(rows: DataFrame, segments: DataFrame, degrees: bool) -> DataFrame:
    """(place, feature): features as GeoJSON, ids as they are."""

    def back(p):
        x, y = crs.to_degrees(p["x"], p["y"]) if degrees else (p["x"], p["y"])
        return F.array(x, y)

    lines = segments.select("variant_id", geojson.json_id(geojson.own_id(F.col("variant_id"), F.col("id"), F.lit(True))).alias("id"), F.to_json(F.transform("path", back)).alias("line"))
    ends = segments.select("variant_id", F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.col("path")[1].alias("p")), F.struct(F.col("to_id").alias("id"), F.col("path")[0].alias("p")))).alias("e"))
    spots = ends.select("variant_id", geojson.json_id(geojson.own_id(F.col("variant_id"), F.col("e.id"), F.lit(True))).alias("id"), F.to_json(back(F.col("e.p"))).alias("spot")).groupBy("variant_id", "id").agg(F.min("spot").alias("spot"))
    placed = rows.join(lines, ["variant_id", "id"], "left").join(spots, ["variant_id", "id"], "left")
    shape = F.when(F.col("ord") == 1, F.concat(F.lit('{"type":"LineString","coordinates":'), "line", F.lit("}"))).when(F.col("ord") < 4, F.concat(F.lit('{"type":"Point","coordinates":'), "spot", F.lit("}"))).otherwise(F.lit("null"))
    own = F.struct("object_type", "variant_id", *geojson.PIPE_FIELDS, *geojson.SUMMARY_FIELDS)
    props = F.to_json(own)
    ids = F.concat(F.lit('{"id":'), "id", *[v for c in ("start_node_id", "end_node_id") for v in (F.when(F.col(c).isNotNull(), F.concat(F.lit(f',"{c}":'), c)).otherwise(""),)], F.lit(","))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(shape, F.lit("null")), F.lit(',"properties":'), ids, F.substring(props, 2, 1 << 30), F.lit("}"))
    return placed.select(F.concat_ws("/", F.col("variant_id").cast("string"), F.col("ord").cast("string"), "id").alias("place"), feature.alias("feature"))
