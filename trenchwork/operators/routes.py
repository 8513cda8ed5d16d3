"""Routes of new pipe: a visibility graph past obstacles, and a forest that joins consumers to the network.

The graph's corners and legs are rows; a leg is dropped by an anti-join with the walls that it crosses or comes too
near to. The forest is Mehlhorn's approximation of a Steiner tree: each node goes to its nearest
terminal, the shortest bridges between terminals' regions make a small graph, and the paths behind its
minimum spanning forest are the routes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import rules as r
from ..store import materialize
from . import network
from .spatial import edges_of, points_in_areas, walked


def turned(ring: Column, inner: Column) -> Column:
    """A closed ring in the direction that keeps its area on the left: counter-clockwise, a hole (``inner``) clockwise."""
    n = F.size(ring) - 1
    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + (ring[i]["x"] - ring[0]["x"]) * (ring[i + 1]["y"] - ring[0]["y"]) - (ring[i + 1]["x"] - ring[0]["x"]) * (ring[i]["y"] - ring[0]["y"]))
    return F.when((twice < 0) != inner, F.reverse(ring)).otherwise(ring)


def corners(polygons: DataFrame, clearance: float | Column, longest: float | None = None) -> DataFrame:
    """(polygon, x, y): the corners of areas (polygon, ring, and ``inner`` for holes) that a way may turn at, moved out by
    the clearance, whatever the direction of the rings. With ``longest``, also places along walls so that none are farther apart."""
    inner = F.col("inner") if "inner" in polygons.columns else F.lit(False)
    clearance = F.lit(clearance) if isinstance(clearance, (int, float)) else clearance
    rings = polygons.where(F.size("ring") > 3).select("polygon", turned(F.col("ring"), inner).alias("ring"), clearance.alias("_clear"))
    n = F.size("ring") - 1
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.col("ring")[(i + n - 1) % n].alias("p"), F.col("ring")[i].alias("q"), F.col("ring")[(i + 1) % n].alias("s")))
    at = rings.select("polygon", "_clear", F.explode(places).alias("c")).select("polygon", "_clear", "c.p", "c.q", "c.s")
    (px, py), (qx, qy), (sx, sy) = ((F.col(f"{c}.x"), F.col(f"{c}.y")) for c in "pqs")
    some = lambda d: F.when(d > 1e-12, d)
    inward, outward = some(g.distance((px, py), (qx, qy))), some(g.distance((qx, qy), (sx, sy)))
    ux, uy, vx, vy = (qx - px) / inward, (qy - py) / inward, (sx - qx) / outward, (sy - qy) / outward
    convex = ux * vy - uy * vx > 1e-9
    # The mitre of two edges moved out by the clearance.
    scale = F.col("_clear") / (1 + ux * vx + uy * vy)
    out = at.where(convex & (1 + ux * vx + uy * vy > 0.1)).select("polygon", (qx + (uy + vy) * scale).alias("x"), (qy - (ux + vx) * scale).alias("y"))
    if longest is None:
        return out
    parts = F.ceil(outward / longest).cast("int")
    along = at.where(outward > longest).select("polygon", F.explode(F.sequence(F.lit(1), parts - 1)).alias("i"), parts.alias("n"), *[v.alias(k) for k, v in (("qx", qx), ("qy", qy), ("sx", sx), ("sy", sy), ("nx", vy * F.col("_clear")), ("ny", -vx * F.col("_clear")))])
    t = F.col("i") / F.col("n")
    return out.unionByName(along.select("polygon", (F.col("qx") + t * (F.col("sx") - F.col("qx")) + F.col("nx")).alias("x"), (F.col("qy") + t * (F.col("sy") - F.col("qy")) + F.col("ny")).alias("y")))


def lattice(points: DataFrame, step: float) -> DataFrame:
    """(x, y): a lattice over the box of ``points`` (x, y), made of rows by tasks, so that far places have others between them."""
    box = points.agg(F.floor(F.min("x") / step).alias("ax"), F.ceil(F.max("x") / step).alias("bx"), F.floor(F.min("y") / step).alias("ay"), F.ceil(F.max("y") / step).alias("by"))
    return box.where("ax is not null").select("ay", "by", F.explode(F.sequence("ax", "bx")).alias("i")).repartition("i").select("i", F.explode(F.sequence("ay", "by")).alias("j")).select((F.col("i") * step).alias("x"), (F.col("j") * step).alias("y"))


def walls_of(polygons: DataFrame) -> DataFrame:
    """(obstacle, clear, ox0, oy0, ox1, oy1): the edges of all rings of areas (polygon, ring, clear)."""
    edges = edges_of(polygons.select(F.struct("polygon", "clear").alias("polygon"), "ring"))
    return edges.select("polygon.polygon", "polygon.clear", F.col("x0").alias("ox0"), F.col("y0").alias("oy0"), F.col("x1").alias("ox1"), F.col("y1").alias("oy1")).withColumnRenamed("polygon", "obstacle")


def too_near(points: DataFrame, walls: DataFrame, cell: float) -> DataFrame:
    """(id, obstacle) of points (id, x, y) within areas or nearer to their walls than these allow."""
    most = walls.agg(F.max("clear")).first()[0] or 0.0
    size = max(cell, most)
    own = points.select("id", "x", "y", F.floor(F.col("x") / size).cast("long").alias("cx"), F.floor(F.col("y") / size).cast("long").alias("cy"))
    near = own.join(walked(walls, size, most, ("ox0", "oy0", "ox1", "oy1")), ["cx", "cy"])
    away = g.point_distance((F.col("ox0"), F.col("oy0")), (F.col("ox1"), F.col("oy1")), (F.col("x"), F.col("y")))
    return near.where(away < F.col("clear") - 1e-6).select("id", "obstacle").unionByName(points_in_areas(points, walls, cell)).distinct()


def legs(points: DataFrame, polygons: DataFrame, reach: float, cell: float = 50.0) -> DataFrame:
    """(a, b, metres) between points (id, x, y) at most ``reach`` apart whose straight leg crosses no area (polygon, ring, and
    ``clear``, the distance that its walls demand, 0 where there is none) and comes no nearer to its walls than that.

    A point may itself lie too near to an area, as the wall that a building is entered by does; its legs may then leave that
    area's surroundings but not cross its walls. Points that are neither terminals nor roots should not be given there.
    Points of one place are one corner: its least id has the legs, and the others a leg of 0 m to it, so that n of them make n legs and not n * n.
    """
    every = points.select("id", "x", "y")
    spots = materialize(every.groupBy("x", "y").agg(F.min("id").alias("spot")), "leg-places")
    same = every.join(spots, ["x", "y"]).where("id <> spot").select(F.col("spot").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("metres"))
    points = spots.select(F.col("spot").alias("id"), "x", "y")
    size = lambda c: F.floor(c / reach).cast("long")
    right = points.select(F.col("id").alias("b"), F.col("x").alias("x1"), F.col("y").alias("y1")).withColumn("cx", F.explode(F.sequence(size(F.col("x1")) - 1, size(F.col("x1")) + 1)))
    right = right.withColumn("cy", F.explode(F.sequence(size(F.col("y1")) - 1, size(F.col("y1")) + 1)))
    pairs = points.select(F.col("id").alias("a"), F.col("x").alias("x0"), F.col("y").alias("y0"), size(F.col("x")).alias("cx"), size(F.col("y")).alias("cy")).join(right, ["cx", "cy"])
    p, q = (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))
    pairs = pairs.where("a < b").select("a", "b", "x0", "y0", "x1", "y1", g.distance(p, q).alias("metres")).where(F.col("metres").between(1e-9, reach))
    pairs = materialize(pairs, "legs")
    areas = polygons if "clear" in polygons.columns else polygons.withColumn("clear", F.lit(0.0))
    walls = materialize(walls_of(areas), "walls")
    most = walls.agg(F.max("clear")).first()[0] or 0.0
    near = walked(pairs, cell, most).join(walked(walls, cell, 0.0, ("ox0", "oy0", "ox1", "oy1")), ["cx", "cy"])
    c, d = (F.col("ox0"), F.col("oy0")), (F.col("ox1"), F.col("oy1"))
    hit, apart = g.crosses(p, q, c, d), g.segment_distance(p, q, c, d)
    met = near.select("a", "b", "obstacle", F.when(hit, 2).when(apart < F.col("clear") - 1e-6, 1).alias("met")).where("met > 0").groupBy("a", "b", "obstacle").agg(F.max("met").alias("met"))
    within = materialize(too_near(points, walls, cell), "too-near")
    end = lambda name: within.select(F.col("id").alias(name), "obstacle", F.lit(True).alias(f"_{name}"))
    blocked = met.join(end("a"), ["a", "obstacle"], "left").join(end("b"), ["b", "obstacle"], "left").where("met = 2 or (_a is null and _b is null)").select("a", "b")
    part = F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("t")
    middles = pairs.select("a", "b", "x0", "y0", "x1", "y1", part).select(F.struct("a", "b").alias("id"), (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("t")).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("t")).alias("y"))
    inside = points_in_areas(middles, walls, cell).select("id.a", "id.b")
    return pairs.join(blocked.unionByName(inside).distinct(), ["a", "b"], "left_anti").select("a", "b", "metres").unionByName(same)


def steiner_forest(edges: DataFrame, terminals: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, parent, length): trees of edges (a, b, metres) that join each reachable terminal (node) to a
    root (node); all roots count as one place. A root's parent is null. Terminals 0 m apart are in the region of one of them,
    at a root in that of the roots, whose label is less than all others."""
    labelled = roots.select("node", F.lit(-(1 << 61)).cast("long").alias("label")).unionByName(terminals.select("node", F.col("node").alias("label")))
    near = materialize(network.shortest_paths(edges, labelled), "regions")
    side = lambda name: near.select(F.col("node").alias(name), F.col("metres").alias(f"_{name}"), F.col("source").alias(f"s{name}"))
    over = edges.join(side("a"), "a").join(side("b"), "b").where("sa <> sb")
    shortest = F.min(F.struct((F.col("_a") + F.col("metres") + F.col("_b")).alias("metres"), "a", "b", F.col("metres").alias("leg")))
    bridges = materialize(over.groupBy(F.least("sa", "sb").alias("p"), F.greatest("sa", "sb").alias("q")).agg(shortest.alias("e")), "bridges")
    chosen = network.spanning_forest(bridges.select(F.col("p").alias("a"), F.col("q").alias("b"), "e.metres")).select(F.col("a").alias("p"), F.col("b").alias("q"))
    used = materialize(bridges.join(chosen, ["p", "q"]).select("e.a", "e.b", F.col("e.leg").alias("metres")), "used-bridges")
    touched = used.select(F.explode(F.array("a", "b")).alias("node")).unionByName(terminals.select("node")).distinct().withColumn("ends", F.lit(1))
    # Nodes with an end of a bridge or a terminal behind them lie on a way from it to the terminal of their region.
    forest = near.select("node", F.col("via").alias("parent"), F.lit(0.0).alias("length")).join(touched, "node", "left").fillna(0, ["ends"])
    seen = network.gathered(forest, {"ends": "sum"}).where("ends > 0").select("node")
    inner = seen.join(near.where("via is not null").select("node", "via", "metres"), "node")
    inner = inner.join(near.select(F.col("node").alias("via"), F.col("metres").alias("_m")), "via").select(F.least("node", "via").alias("a"), F.greatest("node", "via").alias("b"), (F.col("metres") - F.col("_m")).alias("metres"))
    # All roots are one place, so the chosen ways and bridges form no ring: each tree has one root.
    tree = materialize(inner.unionByName(used.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "metres")).distinct(), "forest")
    return network.rooted(tree, roots)


def sized(tree: DataFrame, demand: DataFrame, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(node, parent, length, flow, dn, cost) of the pipes that carry any of the demand (node, flow).
    The diameter follows the flow gathered below, so it never falls towards the source."""
    flows = tree.join(demand, "node", "left").select("node", "parent", "length", F.coalesce("flow", F.lit(0.0)).alias("flow"))
    below = network.subtree_sums(flows, "flow").select("node", F.col("total").alias("flow"))
    pipes = tree.where("parent is not null").join(below, "node").where("flow > 0").withColumn("dn", r.dn_for_flow(F.col("flow"), rules))
    return pipes.withColumn("cost", F.col("length") * r.price_per_metre(F.col("dn"), rules))
