"""What new pipe meets on its way: clearances of obstacles, and zones that may be crossed at a price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import rules as r
from ..store import by_key, join_small, materialize
from .intervals import merge_spans, union_intervals
from .spatial import walked
from .utilities import inside_spans, near_spans


def needed_clearance(rule: Column, dn: Column, foreign: Column, rules: r.Rules = r.DEFAULT) -> Column:
    """Between the middle lines: the rule's distance for the diameter, half of the pipe, and half of the other's width."""
    return r.clearance(rule, dn, rules) + r.pipe_width(dn, rules) / 2 + foreign / 2


def greatest_clearance(obstacles: DataFrame, rules: r.Rules = r.DEFAULT) -> float:
    """The most that any pipe needs beside any of the obstacles: the rules' greatest distance, half of the widest pipe and of the widest obstacle."""
    by_rule = max([x[2] for x in rules.restrictions] + [v for x in rules.restrictions for v in x[3].values()])
    return by_rule + rules.diameters[-1][3] / 2 + (obstacles.agg(F.max("foreign")).first()[0] or 0.0) / 2


def breaches(pipes: DataFrame, obstacles: DataFrame, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(id, obstacle, breach): of each pipe (id, x0, y0, x1, y1, dn) the obstacle (obstacle, ox0, oy0, ox1, oy1, rule, foreign)
    whose clearance it falls short of most. They meet in cells as wide as the greatest clearance of the rules."""
    most = greatest_clearance(obstacles, rules)
    near = walked(pipes, most, most).join(walked(obstacles, most, 0.0, ("ox0", "oy0", "ox1", "oy1")), ["cx", "cy"])
    at = lambda a, b: (F.col(a), F.col(b))
    apart = g.segment_distance(at("x0", "y0"), at("x1", "y1"), at("ox0", "oy0"), at("ox1", "oy1"))
    short = near.select("id", "obstacle", (needed_clearance(F.col("rule"), F.col("dn"), F.col("foreign"), rules) - apart).alias("breach")).where("breach > 1e-6")
    worst = short.groupBy("id").agg(F.max(F.struct("breach", F.negative("obstacle").alias("o"))).alias("w"))
    return worst.select("id", F.negative("w.o").alias("obstacle"), "w.breach")


def zone_spans(legs: DataFrame, zones: DataFrame, cell: float = 50.0) -> DataFrame:
    """(path, s0, s1, k, zone, shallow): where paths of legs (path, ord, x0, y0, x1, y1) cross the lines of zones (zone, zx0, zy0,
    zx1, zy1, k, extend, least_sine), ``extend`` to either side; within 0.05 m of an end of the path the span goes to
    the end. ``shallow`` crossings are at less than the least angle and not admissible.

    Legs are put together by their path once and stay so: zones go to them, and no pair of both is moved."""
    whole = Window.partitionBy("path")
    order = whole.orderBy("ord")
    a, b = (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))
    placed = by_key(legs.select("path", "ord", "x0", "y0", "x1", "y1"), "path").withColumn("length", g.distance(a, b))
    placed = placed.withColumns({"before": F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "total": F.sum("length").over(whole)})
    near = join_small(walked(placed, cell, 0.0), materialize(walked(zones, cell, 0.0, ("zx0", "zy0", "zx1", "zy1")), "zone-cells"), ["cx", "cy"])
    c, d = (F.col("zx0"), F.col("zy0")), (F.col("zx1"), F.col("zy1"))
    # Most of those that share a cell are told apart by their boxes, before more is computed.
    apart = lambda p, q, r, s: (F.greatest(p, q) < F.least(r, s) - 1e-6) | (F.least(p, q) > F.greatest(r, s) + 1e-6)
    near = near.where(~apart(a[0], b[0], c[0], d[0]) & ~apart(a[1], b[1], c[1], d[1])).drop("cx", "cy").dropDuplicates(["path", "ord", "zone"])
    met = near.withColumn("t", g.cross_place(a, b, c, d)).where("t is not null")
    s = F.col("before") + F.col("t") * F.col("length")
    ends = met.select("path", "zone", "k", "total", (s - F.col("extend")).alias("s0"), (s + F.col("extend")).alias("s1"), (g.sine(a, b, c, d) < F.col("least_sine")).alias("shallow"))
    cut = ends.select("path", F.when(F.col("s0") < 0.05, 0.0).otherwise(F.col("s0")).alias("s0"), F.when(F.col("s1") > F.col("total") - 0.05, F.col("total")).otherwise(F.col("s1")).alias("s1"), "k", "zone", "shallow")
    return cut.where("s1 > s0 + 1e-9")


def zone_bands(legs: DataFrame, zones: DataFrame) -> DataFrame:
    """(id, zone, ...): where straight legs (id, x0, y0, x1, y1, tap0, tap1: whether an end is a chamber) pass the bands of special
    zones (zone, ox0, oy0, ox1, oy1: the edges of lines, or of all rings of areas; area, existing, k, extend, least_sine, clear).

    A band is what lies within ``clear`` of a zone, and an area itself. ``special`` are the metres of higher price, ``first``
    and ``last`` where they begin and end: inside an area and ``extend`` on either side, but not at a chamber that lies
    inside; ``extend`` to either side of each crossing of a line, but not where the leg begins at it. A band that is
    entered without crossing the zone, or crossed at less than the least angle, is not ``admissible``; one in which a leg leaves
    the existing network that it joins, crossing it once at most, costs nothing.
    """
    c = F.col
    ways = legs.select(c("id").alias("path"), F.lit(0).alias("ord"), "x0", "y0", "x1", "y1")
    edges = zones.withColumnRenamed("zone", "obstacle")
    most = zones.agg(F.max("clear")).first()[0] or 0.0
    inner = inside_spans(ways, edges.where("area").select("obstacle", "ox0", "oy0", "ox1", "oy1")).select("path", "obstacle", c("t0").alias("s0"), c("t1").alias("s1"))
    near = near_spans(ways, edges, c("clear"), most, 1e-9).unionByName(inner)
    bands = union_intervals(near.select(F.struct("path", "obstacle").alias("_key"), "s0", "s1"), "_key", 1e-9).select("_key.*", c("start").alias("b0"), c("end").alias("b1"))
    a, b, p, q = (c("x0"), c("y0")), (c("x1"), c("y1")), (c("ox0"), c("oy0")), (c("ox1"), c("oy1"))
    meet = walked(ways, 50.0, 0.0).join(walked(edges, 50.0, 0.0, ("ox0", "oy0", "ox1", "oy1")), ["cx", "cy"])
    apart = ((g.cross(a, b, p) > 0) != (g.cross(a, b, q) > 0)) & ((g.cross(p, q, a) > 0) != (g.cross(p, q, b) > 0))
    u = g.cross(p, q, a) / (g.cross(p, q, a) - g.cross(p, q, b))
    hits = meet.where(apart).dropDuplicates(["path", "obstacle", "ox0", "oy0", "ox1", "oy1"]).select("path", "obstacle", (u * g.distance(a, b)).alias("t"), g.sine(a, b, p, q).alias("sine"))
    what = zones.groupBy(c("zone").alias("obstacle")).agg(F.max(F.struct("area", "existing", "k", "extend", "least_sine")).alias("w")).select("obstacle", "w.*")
    ends = legs.select(c("id").alias("path"), "tap0", "tap1", g.distance(a, b).alias("length"))
    rows = bands.join(what, "obstacle").join(ends, "path")
    at_tap = (c("tap0") & (c("t") < 1e-6 * c("length"))) | (c("tap1") & (c("t") > (1 - 1e-6) * c("length")))
    met = rows.join(hits, ["path", "obstacle"], "left").where("t is null or t between b0 - 1e-9 and b1 + 1e-9")
    keys = ["path", "obstacle", "b0", "b1"]
    priced = F.when(~at_tap, c("t"))
    crossed = met.groupBy(keys).agg(F.count("t").alias("hits"), F.min("sine").alias("sine"), F.count(priced).alias("priced"), F.min(priced).alias("t_first"), F.max(priced).alias("t_last"))
    within = rows.select(*keys).join(inner, ["path", "obstacle"]).where("s0 < b1 and s1 > b0").groupBy(keys).agg(F.sum(c("s1") - c("s0")).alias("inside"), F.min("s0").alias("i0"), F.max("s1").alias("i1"))
    full = rows.join(crossed, keys, "left").join(within, keys, "left").fillna(0, ["hits", "priced"]).fillna(0.0, ["inside"])
    joins = c("existing") & ((c("tap0") & (c("b0") <= 1e-9)) | (c("tap1") & (c("b1") >= c("length") - 1e-9)))
    free = joins & (c("hits") <= 1)
    steep = (c("hits") > 0) & (c("sine") >= c("least_sine") - 1e-9)
    e0, e1 = F.when(c("tap0") & (c("i0") <= 0), 0.0).otherwise(c("extend")), F.when(c("tap1") & (c("i1") >= c("length") - 1e-9), 0.0).otherwise(c("extend"))
    special = F.when(free | ~steep, 0.0).when(c("area"), c("inside") + e0 + e1).otherwise(c("priced") * 2 * c("extend"))
    first = F.when(c("area"), c("i0") - e0).otherwise(c("t_first") - c("extend"))
    last = F.when(c("area"), c("i1") + e1).otherwise(c("t_last") + c("extend"))
    return full.select(c("path").alias("id"), c("obstacle").alias("zone"), "b0", "b1", "k", special.alias("special"), first.alias("first"), last.alias("last"), (free | steep).alias("admissible"))


def zone_costs(legs: DataFrame, zones: DataFrame) -> DataFrame:
    """(id, extra) of every leg, see ``zone_bands``: the metres that its special pieces cost more, null where it is not admissible."""
    met = zone_bands(legs, zones).groupBy("id").agg(F.sum((F.col("k") - 1) * F.col("special")).alias("extra"), F.bool_and("admissible").alias("fine"))
    return legs.select("id").join(met, "id", "left").select("id", F.when(F.coalesce("fine", F.lit(True)), F.coalesce("extra", F.lit(0.0))).alias("extra"))


def crossing_extra(spans: DataFrame) -> DataFrame:
    """(path, extra): the metres that special pieces cost more, the sum of (k - 1) * length after overlaps are resolved."""
    return merge_spans(spans, "path").groupBy("path").agg(F.sum((F.col("k") - 1) * (F.col("end") - F.col("start"))).alias("extra"))


def exit_angles(taps: DataFrame, pieces: DataFrame, least_sine: float = 0.5) -> DataFrame:
    """(id, piece, sine, admissible): the angle of legs (id, x, y, tx, ty) to the existing piece (piece, x0, y0, x1, y1, site) nearest to their tap;
    taps and pieces meet by ``site``."""
    tap, to = (F.col("tx"), F.col("ty")), (F.col("x"), F.col("y"))
    p, q = (F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))
    near = taps.join(pieces, "site").select("id", "piece", g.point_distance(p, q, tap).alias("away"), g.sine(tap, to, p, q).alias("sine"))
    best = near.groupBy("id").agg(F.min(F.struct("away", "piece", "sine")).alias("b"))
    return best.select("id", "b.piece", "b.sine", (F.col("b.sine") >= least_sine).alias("admissible"))


def cut_at_spans(legs: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, s0, s1, k): the paths of legs (path, ord, x0, y0, x1, y1) cut at the ends of merged spans (path, start, end, k);
    what lies between spans has k 1."""
    total = legs.withColumn("length", g.distance((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")))).groupBy("path").agg(F.sum("length").alias("total"))
    line = Window.partitionBy("path").orderBy("start")
    placed = total.join(spans, "path", "left").withColumns({"_before": F.lag("end").over(line), "_next": F.lead("start").over(line)})
    piece = lambda s0, s1, k: F.struct(s0.alias("s0"), s1.alias("s1"), k.alias("k"))
    plain, none = F.lit(1.0), F.lit(0.0)
    # Each span, what lies before it, and behind the last one what is left.
    special, before = piece(F.col("start"), F.col("end"), F.col("k")), piece(F.coalesce("_before", none), F.col("start"), plain)
    last = F.when(F.col("_next").isNull(), piece(F.coalesce("end", none), F.col("total"), plain))
    return placed.select("path", F.explode(F.array(special, before, last)).alias("p")).select("path", "p.*").where("s1 > s0 + 1e-9")


def points_at(legs: DataFrame, stations: DataFrame) -> DataFrame:
    """(path, s, x, y): the point ``s`` metres along the path; before its start and beyond its end, those.

    Legs and stations are put in one order along the path; the last leg that begins before a station holds it."""
    order = Window.partitionBy("path").orderBy("ord")
    length = g.distance((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1")))
    placed = legs.withColumn("length", length).withColumn("at", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    leg = F.struct("at", "length", "x0", "y0", "x1", "y1")
    both = placed.select("path", "at", F.lit(0).alias("kind"), F.col("ord"), leg.alias("leg"), F.lit(None).cast("double").alias("s"))
    kind = placed.schema["ord"].dataType
    both = both.unionByName(stations.select("path", F.greatest("s", F.lit(0.0)).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("ord"), F.lit(None).cast(both.schema["leg"].dataType).alias("leg"), "s"))
    along = Window.partitionBy("path").orderBy("at", "kind", "ord")
    held = both.withColumn("leg", F.last("leg", True).over(along)).where("kind = 1 and leg is not null")
    t = F.coalesce(F.least(F.lit(1.0), (F.col("at") - F.col("leg.at")) / F.when(F.col("leg.length") > 0, F.col("leg.length"))), F.lit(0.0))
    return held.select("path", "s", (F.col("leg.x0") + t * (F.col("leg.x1") - F.col("leg.x0"))).alias("x"), (F.col("leg.y0") + t * (F.col("leg.y1") - F.col("leg.y0"))).alias("y"))
