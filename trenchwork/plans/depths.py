"""Queries over depths along ways: crossings of utilities, areas, profiles and what they cost, with their SQL.

As in ``catalogue``, ways and utilities are derived from whole driver tables by arithmetic that stands in both texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as r
from ..operators import crossings, depth, network, utilities
from .catalogue import _tree, query, table, units
from .scenes import _HEIGHT, _NATION, _PIPES, _nation, _pipes

_KIND = ("GAS", "CABLE", "HEAT", "ROAD")
_WIDTH = "(CASE " + " ".join(f"WHEN {{dn}} <= {d[0]} THEN {d[3]}" for d in r.DIAMETERS) + f" ELSE {r.DIAMETERS[-1][3]} END)::DOUBLE"
#: Lines of 90 by 40 m at the nations' places, and their kinds.
_LINES = f"SELECT k, x AS cx, y AS cy, x + 90 AS dx, y + 40 AS dy, ['GAS', 'CABLE', 'HEAT', 'ROAD'][(k % 4 + 1)::INTEGER] AS kind, CASE WHEN k % 3 > 0 THEN k % 3 * 100 END AS other FROM ({_NATION})"


def _utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    kind = F.array(*map(F.lit, _KIND))[(k % 4).cast("int")]
    return _nation(spark, sf_dir).select(k.alias("obstacle"), kind.alias("kind"), F.when(k % 3 > 0, k % 3 * 100).alias("dn"), F.lit(None).cast("double").alias("top"), F.col("x").alias("ox0"), F.col("y").alias("oy0"), (F.col("x") + 90).alias("ox1"), (F.col("y") + 40).alias("oy1"))


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipes(spark, sf_dir).withColumnRenamed("id", "path").withColumn("ord", F.lit(1))


#: Within reach of an edge: discs around its ends and the strip beside it, see the docstring of utilities.within_reach.
_NEAR = (
    "m AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, sqrt((dx - cx) * (dx - cx) + (dy - cy) * (dy - cy)) AS elen FROM j), "
    "u AS (SELECT *, coalesce((x1 - x0) / nullif(len, 0), 0) AS ux, coalesce((y1 - y0) / nullif(len, 0), 0) AS uy, (dx - cx) / elen AS ex, (dy - cy) / elen AS ey FROM m), "
    "q AS (SELECT *, (cx - x0) * ux + (cy - y0) * uy AS p1, (dx - x0) * ux + (dy - y0) * uy AS p2, reach * reach - pow(cx - x0, 2) - pow(cy - y0, 2) + pow((cx - x0) * ux + (cy - y0) * uy, 2) AS r1, reach * reach - pow(dx - x0, 2) - pow(dy - y0, 2) + pow((dx - x0) * ux + (dy - y0) * uy, 2) AS r2, "
    "(x0 - cx) * ex + (y0 - cy) * ey AS a0, ux * ex + uy * ey AS a1, (x0 - cx) * ey - (y0 - cy) * ex AS b0, ux * ey - uy * ex AS b1 FROM u), "
    "s AS (SELECT *, CASE WHEN abs(a1) > 1e-12 THEN least(-a0 / a1, (elen - a0) / a1) WHEN a0 BETWEEN 0 AND elen THEN -1e18 END AS f0, CASE WHEN abs(a1) > 1e-12 THEN greatest(-a0 / a1, (elen - a0) / a1) WHEN a0 BETWEEN 0 AND elen THEN 1e18 END AS f1, "
    "CASE WHEN abs(b1) > 1e-12 THEN least((-reach - b0) / b1, (reach - b0) / b1) WHEN abs(b0) <= reach THEN -1e18 END AS g0, CASE WHEN abs(b1) > 1e-12 THEN greatest((-reach - b0) / b1, (reach - b0) / b1) WHEN abs(b0) <= reach THEN 1e18 END AS g1 FROM q), "
    "v AS (SELECT *, f0 IS NOT NULL AND g0 IS NOT NULL AND greatest(f0, g0) <= least(f1, g1) AS strip FROM s), "
    "w AS (SELECT *, least(CASE WHEN r1 >= 0 THEN p1 - sqrt(r1) END, CASE WHEN r2 >= 0 THEN p2 - sqrt(r2) END, CASE WHEN strip THEN greatest(f0, g0) END) AS t0, greatest(CASE WHEN r1 >= 0 THEN p1 + sqrt(r1) END, CASE WHEN r2 >= 0 THEN p2 + sqrt(r2) END, CASE WHEN strip THEN least(f1, g1) END) AS t1 FROM v), "
    "n AS (SELECT *, greatest(t0, 0) AS s0, least(t1, len) AS s1 FROM w WHERE t0 IS NOT NULL AND greatest(t0, 0) <= least(t1, len)) "
)


@query(
    f"WITH p AS ({_PIPES}), o AS ({_LINES}), "
    f"j AS (SELECT p.*, o.*, {_WIDTH.format(dn='dn')} / 2 + CASE kind WHEN 'GAS' THEN 0.2 WHEN 'CABLE' THEN 0.1 ELSE {_WIDTH.format(dn='coalesce(other, 150)')} / 2 END AS reach FROM p, o WHERE kind <> 'ROAD'), " + _NEAR
    + ", z AS (SELECT * FROM n WHERE NOT (kind = 'HEAT' AND id % 2 = 0 AND s0 <= 0.3) AND NOT (kind = 'HEAT' AND id % 5 = 0 AND s1 >= len - 0.3)), "
    f"b AS (SELECT *, CASE kind WHEN 'GAS' THEN 2.8 WHEN 'CABLE' THEN 2.7 ELSE 3.0 END AS top, CASE kind WHEN 'GAS' THEN 0.2 ELSE 0.5 END AS clear, {_HEIGHT.format(dn='dn')} AS own, CASE kind WHEN 'GAS' THEN 0.4 WHEN 'CABLE' THEN 0.2 ELSE {_HEIGHT.format(dn='coalesce(other, 150)')} END AS theirs FROM z) "
    "SELECT id AS path, k AS obstacle, floor(s0 * 1000 + 0.5)::BIGINT AS s0_mm, floor(s1 * 1000 + 0.5)::BIGINT AS s1_mm, floor((top - clear - own) * 1e6 + 0.5)::BIGINT AS above_um, floor((top + theirs + clear) * 1e6 + 0.5)::BIGINT AS below_um FROM b"
)
def utility_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pipes pass utilities, without the ends that join a heat network, and the depths to pass at."""
    ways = _ways(spark, sf_dir)
    ends = ways.select("path", F.explode(F.array(F.when(F.col("path") % 2 == 0, True), F.when(F.col("path") % 5 == 0, False))).alias("at_start")).where("at_start is not null")
    joints = ends.crossJoin(F.broadcast(_nation(spark, sf_dir).where("k % 4 = 2").select(F.col("k").alias("obstacle"))))  # at most the nations
    pins = utilities.utility_pins(ways, _utilities(spark, sf_dir), joints)
    return pins.select("path", "obstacle", units(F.col("s0"), 1000).alias("s0_mm"), units(F.col("s1"), 1000).alias("s1_mm"), units(F.col("above_max"), 1e6).alias("above_um"), units(F.col("below_min"), 1e6).alias("below_um"))


#: Frames at the nations' places: a square of 90 m with a square hole of 30 m.
_FRAME = ((0, 0, 90, 0), (90, 0, 90, 90), (90, 90, 0, 90), (0, 90, 0, 0), (30, 30, 30, 60), (30, 60, 60, 60), (60, 60, 60, 30), (60, 30, 30, 30))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, third = F.col("x"), F.col("y"), 1 / 3
    corner = lambda e: F.struct((x + e[0] + third).alias("ox0"), (y + e[1] + third).alias("oy0"), (x + e[2] + third).alias("ox1"), (y + e[3] + third).alias("oy1"))
    return _nation(spark, sf_dir).select(F.col("k").alias("obstacle"), F.explode(F.array(*map(corner, _FRAME))).alias("e")).select("obstacle", "e.*")


def _clip(low: str, high: str, d: str, at: str) -> str:
    """Where at + t * d lies between low and high: (from, to) in SQL, for d of either sign or 0."""
    return f"CASE WHEN {d} <> 0 THEN least(({low} - {at}) / {d}, ({high} - {at}) / {d}) WHEN {at} BETWEEN {low} AND {high} THEN -1e18 ELSE 2 END, CASE WHEN {d} <> 0 THEN greatest(({low} - {at}) / {d}, ({high} - {at}) / {d}) WHEN {at} BETWEEN {low} AND {high} THEN 1e18 ELSE -1 END"


def _box(a: float, b: float) -> str:
    x, y = _clip(f"(x + {a} + 1/3::DOUBLE)", f"(x + {b} + 1/3::DOUBLE)", "vx", "x0"), _clip(f"(y + {a} + 1/3::DOUBLE)", f"(y + {b} + 1/3::DOUBLE)", "vy", "y0")
    return f"[{x}, {y}]"


@query(
    f"WITH p AS (SELECT *, x1 - x0 AS vx, y1 - y0 AS vy FROM ({_PIPES})), o AS ({_NATION}), "
    f"j AS (SELECT id, k, sqrt(vx * vx + vy * vy) AS len, {_box(0, 90)} AS outer_, {_box(30, 60)} AS inner_ FROM p, o), "
    "c AS (SELECT id, k, len, greatest(0, least(1, least(outer_[2], outer_[4])) - greatest(0, outer_[1], outer_[3])) AS a, greatest(0, least(1, least(inner_[2], inner_[4])) - greatest(0, inner_[1], inner_[3])) AS b FROM j) "
    "SELECT id AS path, k AS obstacle, floor((a - b) * len * 1000 + 0.5)::BIGINT AS inside_mm FROM c WHERE (a - b) * len > 1e-9"
)
def metres_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far pipes run within frames, areas with a hole. In the SQL, a square less its hole by clipping to boxes."""
    spans = utilities.inside_spans(_ways(spark, sf_dir), _frames(spark, sf_dir))
    total = spans.groupBy("path", "obstacle").agg(F.sum(F.col("t1") - F.col("t0")).alias("m"))
    return total.where("m > 1e-9").select("path", "obstacle", units(F.col("m"), 1000).alias("inside_mm"))


@query(
    f"WITH p AS (SELECT *, x1 - x0 AS vx, y1 - y0 AS vy FROM ({_PIPES})), o AS ({_NATION}), "
    f"j AS (SELECT id, k, sqrt(vx * vx + vy * vy) AS len, {_box(0, 90)} AS q FROM p, o), "
    "c AS (SELECT *, least(1, q[2], q[4]) - greatest(0, q[1], q[3]) AS a, greatest(q[1], q[3]) <= 0 AS starts, least(q[2], q[4]) >= 1 AS ends FROM j WHERE len > 0) "
    "SELECT id, k AS zone, floor((a * len + CASE WHEN starts AND id % 2 = 0 THEN 0 ELSE 3 END + CASE WHEN ends AND id % 3 = 0 THEN 0 ELSE 3 END) * 1000 + 0.5)::BIGINT AS special_mm FROM c WHERE a > 0 AND NOT (starts AND ends)"
)
def area_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres of higher price where pipes cross square areas: what lies inside and 3 m on either side, none at a chamber that lies inside."""
    k = F.col("id")
    legs = _pipes(spark, sf_dir).select("id", "x0", "y0", "x1", "y1", (k % 2 == 0).alias("tap0"), (k % 3 == 0).alias("tap1"))
    outer = _frames(spark, sf_dir).where("abs(ox1 - ox0) + abs(oy1 - oy0) > 60")
    zones = outer.select(F.col("obstacle").alias("zone"), "ox0", "oy0", "ox1", "oy1", F.lit(True).alias("area"), F.lit(False).alias("existing"), F.lit(1.6).alias("k"), F.lit(3.0).alias("extend"), F.lit(0.0).alias("least_sine"), F.lit(0.01).alias("clear"))
    return crossings.zone_bands(legs, zones).where("special > 0").groupBy("id", "zone").agg(units(F.sum("special"), 1000).alias("special_mm"))


#: The lines that can bound a depth: falling (d), rising (a) and level (c), from below and from above.
_KNOTS = (
    "pin AS (SELECT s_nationkey AS path, (s_suppkey * 13 % 200)::DOUBLE AS s0, (s_suppkey * 13 % 200 + s_suppkey % 3)::DOUBLE AS s1, (1 + s_suppkey % 4)::DOUBLE AS low, (s_suppkey % 4 + 1 + s_suppkey % 2)::DOUBLE AS high FROM supplier), "
    "way AS (SELECT n_nationkey AS path, 201.0::DOUBLE AS total FROM nation), "
    "d AS (SELECT path, low + s1 / 10 AS v FROM pin UNION SELECT path, high + s0 / 10 FROM pin), a AS (SELECT path, low - s0 / 10 AS v FROM pin UNION SELECT path, high - s1 / 10 FROM pin), "
    "c AS (SELECT path, low AS v FROM pin UNION SELECT path, high FROM pin UNION SELECT path, 3 FROM way), "
    "spot AS (SELECT path, unnest([s0, s1]) AS s FROM pin UNION SELECT path, 0 FROM way UNION SELECT path, total FROM way UNION SELECT path, (d.v - a.v) * 5 FROM d JOIN a USING (path) UNION SELECT path, (d.v - c.v) * 10 FROM d JOIN c USING (path) UNION SELECT path, (c.v - a.v) * 10 FROM a JOIN c USING (path)), "
    "st AS (SELECT path, s, total FROM spot JOIN way USING (path) WHERE s BETWEEN 0 AND total), "
    "f AS (SELECT st.path, s, total, greatest(max(low - 0.1 * greatest(0, s0 - s, s - s1)), least(min(high + 0.1 * greatest(0, s0 - s, s - s1)), 3), CASE WHEN count(low) = 0 THEN 3 END) AS h FROM st LEFT JOIN pin USING (path) GROUP BY st.path, s, total), "
    "g AS (SELECT *, lag(s) OVER (PARTITION BY path ORDER BY s) AS before FROM f), "
    "e AS (SELECT * FROM g WHERE NOT coalesce(s > 0 AND s < total AND (s - before < 1e-6 OR total - s < 1e-6), false)), "
    "b AS (SELECT *, (h - lag(h) OVER w) / (s - lag(s) OVER w) AS g0, (lead(h) OVER w - h) / (lead(s) OVER w - s) AS g1 FROM e WINDOW w AS (PARTITION BY path ORDER BY s)), "
    "kn AS (SELECT path, s, h FROM b WHERE coalesce(abs(g1 - g0) > 1e-5, true)) "
)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    pins = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("path"), (k * 13 % 200).cast("double").alias("s0"), (k * 13 % 200 + k % 3).cast("double").alias("s1"), (1 + k % 4).cast("double").alias("low"), (k % 4 + 1 + k % 2).cast("double").alias("high"))
    return utilities.knots(pins, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), F.lit(201.0).alias("total")))


@query("WITH " + _KNOTS + "SELECT path, floor(s * 1000 + 0.5)::BIGINT AS s_mm, floor(h * 1e6 + 0.5)::BIGINT AS depth_um FROM kn")
def profile_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the depth of pipes changes its grade. In the SQL, all places where two bounds meet are tried against all pins."""
    return _profile(spark, sf_dir).select("path", units(F.col("s"), 1000).alias("s_mm"), units(F.col("depth"), 1e6).alias("depth_um"))


@query(
    "WITH " + _KNOTS + ", k AS (SELECT *, lag(s) OVER w AS s_, lead(s) OVER w AS n_, lag(h) OVER w AS p, lead(h) OVER w AS q FROM kn WINDOW w AS (PARTITION BY path ORDER BY s)), "
    "u AS (SELECT path, s, h FROM k WHERE NOT coalesce(s_ IS NOT NULL AND n_ IS NOT NULL AND s - s_ < 0.05 AND NOT (abs(h - 3) <= 0.002 AND (p - 3) * (q - 3) < -1e-8), false)), "
    "z AS (SELECT path, s AS s0, lead(s) OVER w AS s1, h AS d0, lead(h) OVER w AS d1 FROM u WINDOW w AS (PARTITION BY path ORDER BY s)) "
    "SELECT path, count(*) AS pieces, floor(sum((s1 - s0) * ((CASE WHEN d0 <= 3 + 1e-9 THEN 1 ELSE 1 + 0.1 * (d0 - 3) END) + (CASE WHEN d1 <= 3 + 1e-9 THEN 1 ELSE 1 + 0.1 * (d1 - 3) END)) / 2) * 1000 + 0.5)::BIGINT AS priced_mm FROM z WHERE s1 IS NOT NULL GROUP BY path"
)
def profile_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes cut where their grade changes: pieces, and metres weighted by what their depth costs."""
    pieces = utilities.profile_pieces(_profile(spark, sf_dir))
    priced = (F.col("s1") - F.col("s0")) * r.mean_depth_factor(F.col("depth_from"), F.col("depth_to"))
    return pieces.groupBy("path").agg(F.count("*").alias("pieces"), units(F.sum(priced), 1000).alias("priced_mm"))


_UP = "WITH RECURSIVE tree AS (SELECT c_custkey AS node, CASE WHEN c_custkey >= 5 THEN c_custkey // 3 END AS parent, (c_custkey % 50 + 1)::DOUBLE AS length FROM customer), up(node, ancestor, metres) AS (SELECT node, node, 0::DOUBLE FROM tree UNION ALL SELECT up.node, t.parent, metres + t.length FROM up JOIN tree t ON t.node = up.ancestor WHERE t.parent IS NOT NULL), "


@query(
    _UP + "q AS (SELECT o_custkey AS a, o_orderkey * 7 % (SELECT count(*) FROM customer) AS b FROM orders GROUP BY ALL), "
    "m AS (SELECT q.a, q.b, x.ancestor, x.metres + y.metres AS metres FROM q JOIN up x ON x.node = q.a JOIN up y ON y.node = q.b AND y.ancestor = x.ancestor), "
    "t AS (SELECT a, b, arg_min(ancestor, metres) AS meet, min(metres) AS metres FROM m GROUP BY a, b) "
    "SELECT q.a, q.b, meet, floor(metres * 1000 + 0.5)::BIGINT AS metres_mm FROM q LEFT JOIN t USING (a, b)"
)
def tree_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres between nodes along a forest, over their lowest common ancestor."""
    tree = _tree(spark, sf_dir).select("node", "parent", F.col("length").cast("double").alias("length"))
    n = table(spark, sf_dir, "customer").count()
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") * 7 % n).alias("b")).distinct()
    return network.tree_distances(tree, pairs).select("a", "b", "meet", units(F.col("metres"), 1000).alias("metres_mm"))


@query(
    _UP + "v AS (SELECT s_suppkey AS node, (s_suppkey % 9 * 5)::DOUBLE AS low, (s_suppkey % 7 * 6)::DOUBLE AS high FROM supplier), "
    "d AS (SELECT x.node, v.node AS of, min(x.metres + y.metres) AS metres FROM up x JOIN up y ON y.ancestor = x.ancestor JOIN v ON v.node = y.node GROUP BY ALL), "
    "b AS (SELECT d.node, max(low - 0.1 * metres) AS low, min(high + 0.1 * metres) AS high FROM d JOIN v ON v.node = d.of GROUP BY d.node) "
    "SELECT tree.node, floor(low * 1e6 + 0.5)::BIGINT AS low_um, floor(high * 1e6 + 0.5)::BIGINT AS high_um FROM tree LEFT JOIN b ON b.node = tree.node"
)
def spread_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of depth that crossings anywhere in a forest set at each of its nodes."""
    tree = _tree(spark, sf_dir).select("node", "parent", F.col("length").cast("double").alias("length"))
    k = F.col("s_suppkey")
    values = table(spark, sf_dir, "supplier").select(k.alias("node"), (k % 9 * 5).cast("double").alias("low"), (k % 7 * 6).cast("double").alias("high"))
    return network.spread(tree, values, 0.1).select("node", units(F.col("low"), 1e6).alias("low_um"), units(F.col("high"), 1e6).alias("high_um"))
