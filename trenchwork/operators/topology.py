"""Who belongs to whom: next ids, chambers at segments, terminals, host buildings, and the way towards a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..store import materialize
from . import network
from .spatial import edges_of, points_inside, within


def _cell(c: Column, reach: float) -> Column:
    return F.floor(c / reach).cast("long")


def _boxed(df: DataFrame, x: tuple[str, str], y: tuple[str, str], reach: float, pad: float = 0.0) -> DataFrame:
    """A row for each cell (cx, cy) that the box of two corners, grown by ``pad``, meets."""
    over = lambda c, name: F.explode(F.sequence(_cell(F.least(*c) - pad, reach), _cell(F.greatest(*c) + pad, reach))).alias(name)
    return df.select("*", over(x, "cx")).select("*", over(y, "cy"))


def virtual_nodes(nodes: DataFrame, ends: DataFrame, snap: float = 4.0) -> DataFrame:
    """(ord, node, virtual, metres) of ends (ord, x, y), taken in their order: the nearest of the nodes (node, place, x, y) and of
    the virtual nodes made before it, at most ``snap`` away; of equals the later one, virtual nodes last. An end without
    any is a virtual node itself (``virtual``: the end that made it), which later ends may find.

    An end makes a node if no node and no earlier such end is near. This is settled in rounds: an end whose earlier neighbours
    are all settled and make none makes one, and settles its later neighbours. Ends of one place are settled as their first.
    """
    at = ends.select(F.struct("x", "y").alias("spot"), "ord")
    firsts = materialize(at.groupBy("spot").agg(F.min("ord").alias("id")).select("id", "spot.x", "spot.y"), "end-places")
    fixed = nodes.select("node", "place", "x", "y")
    near_fixed = within(firsts, fixed.select(F.col("place").alias("id"), "x", "y"), snap).select(F.col("left_id").alias("id")).distinct()
    open_ = materialize(firsts.join(near_fixed, "id", "left_anti"), "ends-open")
    pairs = materialize(within(open_, open_, snap).where("right_id < left_id").select(F.col("left_id").alias("later"), F.col("right_id").alias("earlier")), "end-pairs")
    left, made = open_.select("id"), []
    while left.limit(1).count():
        fresh = materialize(left.join(pairs.select(F.col("later").alias("id")).distinct(), "id", "left_anti"), "ends-made")
        made.append(fresh)
        settled = materialize(pairs.join(fresh.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("id")).distinct().unionByName(fresh), "ends-settled")
        left = materialize(left.join(settled, "id", "left_anti"), "ends-left")
        gone = lambda c: settled.withColumnRenamed("id", c)  # noqa: B023, E731
        pairs = materialize(pairs.join(gone("later"), "later", "left_anti").join(gone("earlier"), "earlier", "left_anti"), "end-pairs")
    makers = firsts.limit(0).select("id")
    for fresh in made:
        makers = makers.unionByName(fresh)
    virtual = materialize(firsts.join(makers, "id", "left_semi"), "ends-virtual")
    own = ends.select(F.col("ord").alias("id"), "x", "y")
    to = lambda found, kind: found.select(F.col("left_id").alias("ord"), F.col("d"), F.lit(kind).alias("kind"), F.col("right_id").alias("place"))
    # Virtual nodes lie more than ``snap`` apart, so few of them are near to an end.
    near = to(within(own, fixed.select(F.col("place").alias("id"), "x", "y"), snap), 0).unionByName(to(within(own, virtual, snap), 1).where("place <= ord"))
    best = near.groupBy("ord").agg(F.min(F.struct("d", F.negative("kind").alias("k"), F.negative("place").alias("p"))).alias("b"))
    named = best.select("ord", F.when(F.col("b.k") == 0, F.negative("b.p")).alias("place"), F.when(F.col("b.k") != 0, F.negative("b.p")).alias("virtual"), F.col("b.d").alias("metres"))
    return named.join(fixed.select("place", "node"), "place", "left").select("ord", "node", "virtual", "metres")


def resolved_next(segments: DataFrame, sources: DataFrame, chambers: DataFrame) -> DataFrame:
    """(id, next_id, next_kind) of segments (id, next_id): what the id names, sources before segments before chambers; null if nothing."""
    named = segments.select("id", "next_id")
    for kind, known in (("SOURCE", sources), ("EXISTING_SEGMENT", segments), ("CHAMBER", chambers)):
        named = named.join(known.select(F.col("id").alias("next_id"), F.lit(kind).alias(f"_{kind}")).distinct(), "next_id", "left")
    return named.select("id", "next_id", F.coalesce("_SOURCE", "_EXISTING_SEGMENT", "_CHAMBER").alias("next_kind"))


def chamber_adjacency(chambers: DataFrame, segments: DataFrame, within: float = 4.0) -> DataFrame:
    """(id, incident, dn) of chambers (id, x, y): the segments (segment, x0, y0, x1, y1, dn) with an end near by, and their greatest diameter."""
    ends = segments.select("segment", "dn", F.explode(F.array(F.struct(F.col("x0").alias("ex"), F.col("y0").alias("ey")), F.struct(F.col("x1").alias("ex"), F.col("y1").alias("ey")))).alias("e")).select("segment", "dn", "e.ex", "e.ey")
    ends = ends.select("*", _cell(F.col("ex"), within).alias("cx"), _cell(F.col("ey"), within).alias("cy"))
    near = _boxed(chambers.select("id", "x", "y"), ("x", "x"), ("y", "y"), within, within).join(ends, ["cx", "cy"])
    near = near.where(g.distance((F.col("x"), F.col("y")), (F.col("ex"), F.col("ey"))) <= within)
    found = near.groupBy("id").agg(F.count_distinct("segment").alias("incident"), F.max("dn").alias("dn"))
    return chambers.select("id").join(found, "id", "left").select("id", F.coalesce("incident", F.lit(0)).cast("long").alias("incident"), "dn")


def terminals(points: DataFrame, consumers: DataFrame) -> DataFrame:
    """(id, point, flow): consumers (id, flow) with their connection points (point, oks_id; id and flow of their own if they have any).

    A consumer without a flow, or of 0, has its point's; a point that names no consumer is one by itself, under the id that it
    names or else its own, with its own flow.
    """
    for name, kind in (("id", "string"), ("flow", "double")):
        if name not in points.columns:
            points = points.withColumn(name, F.lit(None).cast(kind))
    spots = points.select(F.col("oks_id"), "point", F.col("id").alias("_id"), F.col("flow").alias("_flow"))
    both = consumers.join(spots, F.col("id") == F.col("oks_id"), "full")
    flow = F.when(F.coalesce("flow", F.lit(0.0)) > 0, F.col("flow")).otherwise(F.coalesce("_flow", "flow"))
    return both.select(F.coalesce("id", "oks_id", "_id").alias("id"), "point", flow.alias("flow"))


def host_buildings(points: DataFrame, polygons: DataFrame, reach: float = 15.0) -> DataFrame:
    """(id, polygon, metres) of points (id, x, y, own): the building of its own id if there is one, else the one that holds
    it, else the nearest within ``reach``; the smallest of equals. Points with none are left out."""
    own = points.join(polygons.select(F.col("polygon").alias("own")), "own").select("id", F.col("own").alias("polygon"), F.lit(0.0).alias("metres"))
    rest = points.join(own.select("id"), "id", "left_anti").select("id", "x", "y")
    inside = points_inside(rest, polygons, reach).select("id", "polygon", F.lit(0.0).alias("metres"))
    cells = rest.select("*", _cell(F.col("x"), reach).alias("cx"), _cell(F.col("y"), reach).alias("cy"))
    walls = _boxed(edges_of(polygons), ("x0", "x1"), ("y0", "y1"), reach, reach)
    away = g.point_distance((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")), (F.col("x"), F.col("y")))
    near = cells.join(walls, ["cx", "cy"]).select("id", "polygon", away.alias("metres")).where(F.col("metres") <= reach)
    best = inside.unionByName(near).groupBy("id").agg(F.min(F.struct("metres", "polygon")).alias("b"))
    return own.unionByName(best.select("id", "b.polygon", "b.metres"))


def oriented(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """(segment, up, next_id) of segments (segment, a, b, length, next_id) between nodes: the end nearer to a source
    (node), and the segment by which that end is reached, or the node where it is a source. A next_id that is
    given stays; segments that no source reaches have no ``up``."""
    edges = segments.select("segment", "a", "b", "next_id", F.greatest(F.col("length"), F.lit(0.2)).alias("metres"))
    near = network.shortest_paths(edges.select("a", "b", "metres"), sources)
    at = lambda name: near.select(F.col("node").alias(name), F.col("metres").alias(f"_{name}"))
    both = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    ends = both.withColumn("up", F.when(F.coalesce("_a", F.lit(1e18)) <= F.coalesce("_b", F.lit(1e18)), F.when(F.col("_a").isNotNull(), F.col("a"))).otherwise(F.col("b")))
    # The segment behind a node: of those between it and the node before on its way, the shortest.
    way = edges.select("segment", "metres", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("via")), F.struct(F.col("b").alias("node"), F.col("a").alias("via")))).alias("w")).select("segment", "metres", "w.node", "w.via")
    behind = near.where("via is not null").select("node", "via").join(way, ["node", "via"]).groupBy(F.col("node").alias("up")).agg(F.min(F.struct("metres", "segment")).alias("w")).select("up", F.col("w.segment").alias("_behind"))
    linked = ends.join(behind, "up", "left")
    found = F.when(F.col("_behind").isNotNull(), F.col("_behind").cast("string")).otherwise(F.concat(F.lit("node "), F.col("up").cast("string")))
    return linked.select("segment", "up", F.coalesce("next_id", F.when(F.col("up").isNotNull(), found)).alias("next_id"))
