"""Pipes beside utilities and through areas: intervals along their way, depths from them, and pieces cut at the knots.

A way is a polyline (path, ord, x0, y0, x1, y1), a row for each leg. Obstacles are edges (obstacle, ox0, oy0, ox1, oy1),
which meet the legs in cells of a grid; what follows is keyed by (path, obstacle) or by path.

Defined results: legs and edges without length count as points; null coordinates meet nothing; intervals that touch or
lie within ``gap`` of each other are one; a way that meets nothing has no row; repeated edges change nothing.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import rules as r
from ..store import materialize
from . import depth, network
from .intervals import union_intervals
from .spatial import points_in_areas, walked

_FAR = 1e18


def placed(legs: DataFrame) -> DataFrame:
    """Legs with ``length`` and ``before``, the metres of the way ahead of them."""
    order = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    measured = legs.withColumn("length", g.distance((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))))
    return measured.withColumn("before", F.coalesce(F.sum("length").over(order), F.lit(0.0)))


def _slab(at: Column, slope: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Where at + t * slope lies between low and high; nulls if nowhere."""
    steep = F.when(F.abs(slope) > 1e-12, slope)
    one, two, always = (low - at) / steep, (high - at) / steep, at.between(low, high)
    return F.when(steep.isNotNull(), F.least(one, two)).when(always, -_FAR), F.when(steep.isNotNull(), F.greatest(one, two)).when(always, _FAR)


def within_reach(pairs: DataFrame) -> DataFrame:
    """``pairs`` of legs (x0, y0, x1, y1, length) and edges (ox0, oy0, ox1, oy1) with the interval t0 to t1, in metres
    along the leg, at most ``reach`` from the edge; pairs without one are left out.

    What is within reach of an edge is convex: the discs around its ends and the strip beside it. A leg meets it in one
    interval, from the first to the last of the three that it meets.
    """
    c = F.col
    step = lambda a, b: (c(b) - c(a)) / F.when(c("length") > 1e-12, c("length"))
    o = pairs.withColumn("_m", g.distance((c("ox0"), c("oy0")), (c("ox1"), c("oy1"))))
    along = lambda a, b: F.coalesce((c(b) - c(a)) / F.when(c("_m") > 1e-12, c("_m")), F.lit(0.0))
    o = o.withColumns({"_ux": F.coalesce(step("x0", "x1"), F.lit(0.0)), "_uy": F.coalesce(step("y0", "y1"), F.lit(0.0)), "_ex": along("ox0", "ox1"), "_ey": along("oy0", "oy1")})
    found = []
    for k in "01":
        dx, dy = c(f"ox{k}") - c("x0"), c(f"oy{k}") - c("y0")
        o = o.withColumns({f"_p{k}": dx * c("_ux") + dy * c("_uy"), f"_q{k}": dx * dx + dy * dy})
        rest = c("reach") * c("reach") - (c(f"_q{k}") - c(f"_p{k}") * c(f"_p{k}"))
        o = o.withColumn(f"_h{k}", F.when(rest >= 0, F.sqrt(F.greatest(rest, F.lit(0.0)))))
        found.append((c(f"_p{k}") - c(f"_h{k}"), c(f"_p{k}") + c(f"_h{k}")))
    dx, dy = c("x0") - c("ox0"), c("y0") - c("oy0")
    ends = _slab(dx * c("_ex") + dy * c("_ey"), c("_ux") * c("_ex") + c("_uy") * c("_ey"), F.lit(0.0), c("_m"))
    sides = _slab(dx * c("_ey") - dy * c("_ex"), c("_ux") * c("_ey") - c("_uy") * c("_ex"), -c("reach"), c("reach"))
    o = o.withColumns({"_s0": F.when(ends[0].isNotNull() & sides[0].isNotNull(), F.greatest(ends[0], sides[0])), "_s1": F.when(ends[0].isNotNull() & sides[0].isNotNull(), F.least(ends[1], sides[1]))})
    strip = (c("_m") > 1e-12) & (c("_s0") <= c("_s1"))
    found.append((F.when(strip, c("_s0")), F.when(strip, c("_s1"))))
    # least() and greatest() of nulls alone are null. The interval comes from a generator, so that conditions on it are not
    # pushed down into, and multiplied with, all that it is computed from.
    span = F.struct(F.greatest(F.least(*[f[0] for f in found]), F.lit(0.0)).alias("t0"), F.least(F.greatest(*[f[1] for f in found]), c("length")).alias("t1"), F.coalesce(*[f[0] for f in found]).isNotNull().alias("met"))
    made = o.select(*pairs.columns, F.explode(F.array(span)).alias("_span"))
    return made.where("_span.met and _span.t0 <= _span.t1").select(*pairs.columns, "_span.t0", "_span.t1")


def near_spans(legs: DataFrame, edges: DataFrame, reach: Column, most: float, gap: float = 0.05) -> DataFrame:
    """(path, obstacle, s0, s1): the intervals along each way that lie within ``reach``, an expression over columns of both
    tables and at most ``most``, of an obstacle's edges."""
    cell = max(4 * most, 10.0)
    near = walked(placed(legs), cell, most).join(walked(edges, cell, 0.0, ("ox0", "oy0", "ox1", "oy1")), ["cx", "cy"])
    corners = [*("x0", "y0", "x1", "y1"), *("ox0", "oy0", "ox1", "oy1")]
    met = within_reach(near.select("path", "obstacle", "before", "length", *corners, reach.cast("double").alias("reach")))
    spans = met.select(F.struct("path", "obstacle").alias("_key"), (F.col("before") + F.col("t0")).alias("s0"), (F.col("before") + F.col("t1")).alias("s1"))
    return union_intervals(spans, "_key", gap).select("_key.*", F.col("start").alias("s0"), F.col("end").alias("s1"))


def inside_spans(legs: DataFrame, edges: DataFrame, cell: float = 50.0) -> DataFrame:
    """(path, ord, obstacle, t0, t1): the parts of each leg, in metres along it, within areas given by the edges of all
    their rings, holes included, by the even-odd rule.

    A leg's parts change sides where it crosses an edge; at its start it is inside if the point is. An end point of an
    edge on the leg counts to one side, so corners are crossed once or twice alike.
    """
    c = F.col
    a, b, p, q = (c("x0"), c("y0")), (c("x1"), c("y1")), (c("ox0"), c("oy0")), (c("ox1"), c("oy1"))
    own = placed(legs).select("path", "ord", "x0", "y0", "x1", "y1", "length")
    near = walked(own, cell, 0.0).join(walked(edges, cell, 0.0, ("ox0", "oy0", "ox1", "oy1")), ["cx", "cy"]).drop("cx", "cy")
    apart = ((g.cross(a, b, p) > 0) != (g.cross(a, b, q) > 0)) & ((g.cross(p, q, a) > 0) != (g.cross(p, q, b) > 0))
    u = g.cross(p, q, a) / (g.cross(p, q, a) - g.cross(p, q, b))
    hits = near.where(apart).withColumn("t", u * c("length")).dropDuplicates(["path", "ord", "obstacle", "ox0", "oy0", "ox1", "oy1"])
    begun = points_in_areas(own.select(F.struct("path", "ord", "length").alias("id"), c("x0").alias("x"), c("y0").alias("y")), edges, cell)
    events = hits.select("path", "ord", "length", "obstacle", "t").unionByName(begun.select("id.*", "obstacle", F.lit(0.0).alias("t")))
    line = Window.partitionBy("path", "ord", "obstacle").orderBy("t")
    parts = events.withColumns({"_n": F.row_number().over(line), "t1": F.coalesce(F.lead("t").over(line), c("length"))})
    return parts.where("_n % 2 = 1 and t1 > t").select("path", "ord", "obstacle", c("t").alias("t0"), "t1")


def area_spans(legs: DataFrame, edges: DataFrame, reach: Column, most: float, gap: float = 0.05) -> DataFrame:
    """As ``near_spans``: within reach of an edge, or inside an obstacle that is an ``area``."""
    inner = inside_spans(legs, edges.where("area").select("obstacle", "ox0", "oy0", "ox1", "oy1")).join(placed(legs).select("path", "ord", "before"), ["path", "ord"])
    inner = inner.select("path", "obstacle", (F.col("before") + F.col("t0")).alias("s0"), (F.col("before") + F.col("t1")).alias("s1"))
    both = near_spans(legs, edges, reach, most, gap).unionByName(inner).select(F.struct("path", "obstacle").alias("_key"), "s0", "s1")
    return union_intervals(both, "_key", gap).select("_key.*", F.col("start").alias("s0"), F.col("end").alias("s1"))


def without_joints(spans: DataFrame, joints: DataFrame, lengths: DataFrame, near: float = 0.30) -> DataFrame:
    """Intervals (path, obstacle, s0, s1) without those at an end of the way where it joins that obstacle: joints (path,
    at_start, and obstacle unless they join whatever lies there); lengths (path, total). A joint is no crossing."""
    ends = spans.join(lengths, "path").withColumn("_end", F.explode(F.array(*[F.when(F.col("s0") <= near, True), F.when(F.col("s1") >= F.col("total") - near, False)])))
    joined = ends.where("_end is not null").join(joints.withColumnRenamed("at_start", "_end").distinct(), ["path", *(["obstacle"] if "obstacle" in joints.columns else []), "_end"])
    return spans.join(joined.select("path", "obstacle", "s0").distinct(), ["path", "obstacle", "s0"], "left_anti")


# Depths (m) of the tops of gas mains, cables and heat networks where the input does not give them.
TOPS = {"GAS": 2.8, "CABLE": 2.7, "HEAT": 3.0}


def half_width(kind: Column, dn: Column, rules: r.Rules = r.DEFAULT) -> Column:
    """Half of what a utility is wide: a heat network by its diameter (150 where it has none), others as they are high."""
    return depth.utility_height(kind, dn, width=True, rules=rules) / 2


def utility_pins(legs: DataFrame, utilities: DataFrame, joints: DataFrame, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(path, obstacle, s0, s1, above_max, below_min): where ways (legs with ``dn``) pass utilities (obstacle, kind, dn, top,
    ox0, oy0, ox1, oy1), and the depths that pass above or below. Ends that join a heat network are no crossings."""
    own = legs.withColumn("_half", r.pipe_width(F.col("dn"), rules) / 2)
    other = utilities.where(F.col("kind").isin(*depth.UTILITIES)).withColumns({"_other": half_width(F.col("kind"), F.col("dn"), rules)}).withColumnRenamed("dn", "other_dn")
    widest = rules.diameters[-1][3]
    spans = near_spans(own, other, F.col("_half") + F.col("_other"), widest)
    lengths = placed(legs).groupBy("path").agg(F.sum("length").alias("total"), F.max("dn").alias("dn"))
    what = other.groupBy("obstacle").agg(F.max(F.struct("kind", "top", "other_dn")).alias("w")).select("obstacle", "w.*")
    heat = what.where("kind = 'HEAT'").select("obstacle")
    of_heat = spans.join(heat, "obstacle", "left_semi")
    crossed = without_joints(of_heat, joints, lengths.select("path", "total")).unionByName(spans.join(heat, "obstacle", "left_anti"))
    band = depth.window(F.col("kind"), F.coalesce("top", depth.usual(TOPS, F.col("kind"))), F.col("dn"), F.col("other_dn"), rules)
    return crossed.join(lengths.select("path", "dn"), "path").join(what, "obstacle").withColumn("band", band).select("path", "obstacle", "s0", "s1", "band.above_max", "band.below_min")


def covers(legs: DataFrame, areas: DataFrame, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(path, c0, c1, cover): where ways lie under roads and tram tracks (obstacle, kind, area, ox0, oy0, ox1, oy1), and the least
    cover there; ``area`` tells whether the edges are all rings of an area or those of a line."""
    own = legs.withColumn("_half", r.pipe_width(F.col("dn"), rules) / 2)
    ways = areas.where(F.col("kind").isin(*depth.COVERS))
    spans = area_spans(own, ways, F.col("_half"), rules.diameters[-1][3] / 2)
    return spans.join(ways.select("obstacle", depth.least_cover(F.col("kind")).alias("cover")).distinct(), "obstacle").select("path", F.col("s0").alias("c0"), F.col("s1").alias("c1"), "cover")


def _lines(pins: DataFrame, lengths: DataFrame, slope: float) -> DataFrame:
    """Gaps between neighbouring ends of pins (path, at, to), with the lines that bound the depth there: from the pins
    before (a), after (b) and over the gap (c) below, and as a2, b2 and c2 above."""
    both = pins.join(lengths, "path").select("path", "total", "low", "high", F.greatest(F.lit(0.0), F.least("s0", "total")).alias("s0"), F.greatest(F.lit(0.0), F.least("s1", "total")).alias("s1"))
    cuts = both.select("path", F.explode(F.array("s0", "s1")).alias("at")).unionByName(lengths.select("path", F.explode(F.array(F.lit(0.0), F.col("total"))).alias("at"))).distinct()
    order = Window.partitionBy("path").orderBy("at")
    cuts = cuts.withColumns({"to": F.lead("at").over(order), "_n": F.row_number().over(order)})
    number = lambda end: cuts.select("path", F.col("at").alias(end), F.col("_n").alias(f"_{end}"))
    over = both.join(number("s0"), ["path", "s0"]).join(number("s1"), ["path", "s1"]).where("_s1 > _s0").select("path", "low", "high", F.explode(F.sequence(F.col("_s0"), F.col("_s1") - 1)).alias("_n"))
    over = over.groupBy("path", "_n").agg(F.max("low").alias("c"), F.min("high").alias("c2"))
    at = lambda end, sign: both.groupBy("path", F.col(end).alias("at")).agg(F.max(F.col("low") + sign * slope * F.col(end)).alias("l"), F.min(F.col("high") - sign * slope * F.col(end)).alias("h"))
    named = lambda df, low, high: df.select("path", "at", F.col("l").alias(low), F.col("h").alias(high))
    joined = cuts.join(named(at("s1", 1), "_a", "_a2"), ["path", "at"], "left").join(named(at("s0", -1), "_b", "_b2"), ["path", "at"], "left").join(over, ["path", "_n"], "left")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    lines = joined.join(lengths, "path").withColumns({"a": F.max("_a").over(before), "a2": F.min("_a2").over(before), "b": F.max("_b").over(after), "b2": F.min("_b2").over(after)})
    return lines.where("to is not null").select("path", "total", "at", "to", "a", "b", "c", "a2", "b2", "c2")


def knots(pins: DataFrame, lengths: DataFrame, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(path, s, depth): the profile of each way as its end points and breakpoints, straight in between.

    The ordinary depth is held within cones around the pins (path, s0, s1, low, high), whose sides have the greatest slope;
    the lower bound wins. Ways come as lengths (path, total). Between neighbouring ends of pins only five lines can bound
    the depth on either side, so the breakpoints are where two of these or one and the ordinary depth meet; of all such
    places those are left where the grade changes. A way without pins has its two ends.
    """
    k, ordinary, c = rules.greatest_slope, rules.ordinary_depth, F.col
    gaps = _lines(pins, lengths, k)
    # Falling from before: a - k s; rising to what comes: b + k s; and their mirror images above.
    falls, rises = {"low": "a", "high": "b2"}, {"low": "b", "high": "a2"}
    meet = []
    for side, level in (("low", "c"), ("high", "c2")):
        fall, rise = c(falls[side]), c(rises[side])
        meet += [(fall - rise) / (2 * k), (fall - c(level)) / k, (c(level) - rise) / k, (fall - ordinary) / k, (F.lit(ordinary) - rise) / k]
    # Where a bound from below meets one from above, the lower one takes over.
    meet += [(c("a") - c("a2")) / (2 * k), (c("b2") - c("b")) / (2 * k), (c("a") - c("c2")) / k, (c("c2") - c("b")) / k, (c("b2") - c("c")) / k, (c("c") - c("a2")) / k]
    places = F.array_distinct(F.array(c("at"), c("to"), *meet))
    found = gaps.withColumn("s", F.explode(places)).where("s between at and to")
    low = F.greatest(c("a") - k * c("s"), c("b") + k * c("s"), c("c"))
    high = F.least(c("a2") + k * c("s"), c("b2") - k * c("s"), c("c2"))
    value = F.greatest(F.coalesce(low, F.lit(ordinary)), F.least(F.coalesce(high, F.lit(ordinary)), F.lit(ordinary)))
    valued = found.select("path", "total", "s", value.alias("depth")).groupBy("path", "total", "s").agg(F.max("depth").alias("depth"))
    order = Window.partitionBy("path").orderBy("s")
    # Places that differ by rounding alone are one; the ends of the way stay.
    inner = (c("s") > 0) & (c("s") < c("total"))
    twice = inner & ((c("s") - F.lag("s").over(order) < 1e-6) | (c("total") - c("s") < 1e-6))
    apart = valued.withColumn("_twice", F.coalesce(twice, F.lit(False))).where("not _twice")
    grade = lambda there: (there("depth").over(order) - c("depth")) / F.abs(there("s").over(order) - c("s"))
    bends = F.abs(grade(F.lag) + grade(F.lead)) > 1e-5
    return apart.withColumn("_kept", F.coalesce(bends, F.lit(True))).where("_kept").select("path", "s", "depth")


def profile_pieces(found: DataFrame, least: float = 0.05, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(path, piece, s0, s1, depth_from, depth_to): ways cut at their knots (path, s, depth). An inner knot less than ``least``
    behind another is left out unless the profile passes the ordinary depth there."""
    order = Window.partitionBy("path").orderBy("s")
    lag, lead = F.lag("s").over(order), F.lead("s").over(order)
    level = F.col("depth") - rules.ordinary_depth
    passes = (F.abs(level) <= 0.002) & ((F.lag("depth").over(order) - rules.ordinary_depth) * (F.lead("depth").over(order) - rules.ordinary_depth) < -1e-8)
    kept = found.withColumn("_drop", lag.isNotNull() & lead.isNotNull() & (F.col("s") - lag < least) & ~F.coalesce(passes, F.lit(False))).where("not _drop")
    ends = kept.withColumns({"s1": F.lead("s").over(order), "depth_to": F.lead("depth").over(order), "piece": F.row_number().over(order)})
    return ends.where("s1 is not null").select("path", "piece", F.col("s").alias("s0"), "s1", F.col("depth").alias("depth_from"), "depth_to")


def sliced(legs: DataFrame, pieces: DataFrame) -> DataFrame:
    """(path, piece, ord, x0, y0, x1, y1): the legs of ways cut into pieces (path, piece, s0, ...) that begin at s0.

    Starts of legs and of pieces are put in one order along the way; each part between two of them lies in the last leg and
    the last piece that began.
    """
    c = F.col
    at = placed(legs).select("path", c("before").alias("at"), F.struct("x0", "y0", "x1", "y1", "length", "before").alias("leg"), F.lit(None).cast(pieces.schema["piece"].dataType).alias("piece"))
    cuts = pieces.select("path", c("s0").alias("at"), F.lit(None).cast(at.schema["leg"].dataType).alias("leg"), "piece")
    order = Window.partitionBy("path").orderBy("at")
    held = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = at.unionByName(cuts).groupBy("path", "at").agg(F.max("leg").alias("leg"), F.max("piece").alias("piece"))
    both = both.withColumns({"leg": F.last("leg", True).over(held), "piece": F.last("piece", True).over(held), "to": F.lead("at").over(order), "ord": F.row_number().over(order)})
    both = both.withColumn("to", F.coalesce("to", c("leg.before") + c("leg.length"))).where("leg is not null and piece is not null and to - at > 1e-9")
    share = lambda s: (c(s) - c("leg.before")) / c("leg.length")
    place = lambda s, axis: c(f"leg.{axis}0") + share(s) * (c(f"leg.{axis}1") - c(f"leg.{axis}0"))
    return both.select("path", "piece", "ord", place("at", "x").alias("x0"), place("at", "y").alias("y0"), place("to", "x").alias("x1"), place("to", "y").alias("y1"))


def bounds(legs: DataFrame, utilities: DataFrame, joints: DataFrame, rules: r.Rules = r.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(pins, lengths): what ways (legs with ``dn``) must keep to, as (path, s0, s1, low, high), and their lengths (path, total).

    Every crossing takes its own best depth, see ``utility_pins``; under roads and tram tracks there is a least cover.
    """
    lengths = materialize(placed(legs).groupBy("path").agg(F.sum("length").alias("total")), "way-lengths")
    over = materialize(covers(legs, utilities, rules), "way-covers")
    found = materialize(utility_pins(legs, utilities, joints, rules).withColumn("pin", F.xxhash64("path", "obstacle", "s0")), "way-pins")
    floors = depth.pin_floors(found.select(F.col("path").alias("edge"), "pin", "s0", "s1"), over.withColumnRenamed("path", "edge")).select("pin", "floor")
    chosen = depth.choose_depth(found.join(floors, "pin"), "pin", rules=rules)
    pins = found.join(chosen, "pin").select("path", "s0", "s1", F.col("depth").alias("low"), F.col("depth").alias("high"))
    shelves = over.select("path", F.col("c0").alias("s0"), F.col("c1").alias("s1"), F.col("cover").alias("low"), F.lit(None).cast("double").alias("high"))
    return materialize(pins.unionByName(shelves), "way-bounds"), lengths


def laid(pins: DataFrame, lengths: DataFrame, ends: DataFrame | None = None, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(path, piece, s0, s1, depth_from, depth_to): ways laid within their ``bounds``. ``ends`` (path, at_start, low, high) are
    bounds that other ways hand over at the ends. Ways are built at 0.99 of the greatest slope, so that a cut piece does not exceed it.
    """
    if ends is not None:
        s = F.when(F.col("at_start"), F.lit(0.0)).otherwise(F.col("total"))
        pins = materialize(pins.unionByName(ends.join(lengths, "path").select("path", s.alias("s0"), s.alias("s1"), "low", "high")), "way-bounds")
    return profile_pieces(knots(pins, lengths, built_at(rules)), rules=rules)


def built_at(rules: r.Rules) -> r.Rules:
    """The rules with the slope that ways are built at."""
    return replace(rules, greatest_slope=rules.greatest_slope * 0.99)


def laid_together(tree: DataFrame, legs: DataFrame, utilities: DataFrame, joints: DataFrame, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """As ``laid``, of the pipes of a forest (node, parent, length), whose ways (path: the node) run from the parent to the node:
    a crossing is felt in all pipes of its tree, by the distance along them."""
    pins, lengths = bounds(legs, utilities, joints, rules)
    ways = tree.where("parent is not null").select(F.col("node").alias("path"), "node", "parent", "length")
    slope = built_at(rules).greatest_slope
    at = pins.join(ways, "path").select("node", "parent", "low", "high", (F.col("length") - F.col("s1")).alias("_up"), F.col("s0").alias("_down"))
    one = lambda end, far: at.select(F.col(end).alias("node"), (F.col("low") - slope * F.col(far)).alias("low"), (F.col("high") + slope * F.col(far)).alias("high"))
    felt = network.spread(tree, materialize(one("node", "_up").unionByName(one("parent", "_down")), "felt"), slope)
    end = lambda name, start: ways.select("path", F.col(name).alias("node")).join(felt, "node").where("low is not null or high is not null").select("path", F.lit(start).alias("at_start"), "low", "high")
    return laid(pins, lengths, end("parent", True).unionByName(end("node", False)), rules)
