"""Queries over whole scenes: topology, clearances, crossings, depths, plans and their export, with their SQL.

As in ``catalogue``, pipes, places and ids are derived from whole driver tables by arithmetic that stands in both texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions import rules as r
from ..operators import costing, crossings, depth, intervals, network, topology
from ..sources import geojson
from .catalogue import _DN, _pd, _tree, query, table, units

_NATION = "SELECT n_nationkey AS k, (n_nationkey * 211 % 1000)::DOUBLE AS x, (n_nationkey * 383 % 1000)::DOUBLE AS y FROM nation"
_PIPES = "SELECT c_custkey AS id, (c_custkey * 37 % 1000)::DOUBLE AS x0, (c_custkey * 91 % 1000)::DOUBLE AS y0, (c_custkey * 37 % 1000 + c_custkey % 37)::DOUBLE AS x1, (c_custkey * 91 % 1000 + c_custkey % 23)::DOUBLE AS y1, [80, 200, 500, 900][(c_custkey % 4 + 1)::INTEGER] AS dn FROM customer"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("k"), (k * 211 % 1000).cast("double").alias("x"), (k * 383 % 1000).cast("double").alias("y"))


def _pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double")
    return table(spark, sf_dir, "customer").select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + k % 37).alias("x1"), (y + k % 23).alias("y1"), F.array(*map(F.lit, (80, 200, 500, 900)))[(k % 4).cast("int")].alias("dn"))


@query(
    "WITH s AS (SELECT 'S' || p_partkey AS id, ['S' || (p_partkey * 7 % 3000), 'C' || p_size, 'Q' || (p_size % 9), NULL][(p_partkey % 4 + 1)::INTEGER] AS next_id FROM part), "
    "q AS (SELECT 'Q' || n_nationkey AS id FROM nation WHERE n_nationkey < 5), c AS (SELECT DISTINCT 'C' || p_size AS id FROM part WHERE p_size % 3 <> 0) "
    "SELECT s.id, s.next_id, CASE WHEN q.id IS NOT NULL THEN 'SOURCE' WHEN o.id IS NOT NULL THEN 'EXISTING_SEGMENT' WHEN c.id IS NOT NULL THEN 'CHAMBER' END AS next_kind "
    "FROM s LEFT JOIN q ON q.id = s.next_id LEFT JOIN s o ON o.id = s.next_id LEFT JOIN c ON c.id = s.next_id"
)
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next ids of segments name."""
    k, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    segments = part.select(name("S", k).alias("id"), F.array(name("S", k * 7 % 3000), name("C", size), name("Q", size % 9), F.lit(None))[(k % 4).cast("int")].alias("next_id"))
    sources = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(name("Q", F.col("n_nationkey")).alias("id"))
    return topology.resolved_next(segments, sources, part.where("p_size % 3 <> 0").select(name("C", size).alias("id")).distinct())


@query(
    f"WITH c AS ({_NATION}), s AS ({_PIPES}), e AS (SELECT id AS seg, dn, x0 AS ex, y0 AS ey FROM s UNION ALL SELECT id, dn, x1, y1 FROM s), "
    "n AS (SELECT k, count(DISTINCT seg) AS incident, max(dn) AS dn FROM c JOIN e ON sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey)) <= 24 GROUP BY k) "
    "SELECT c.k AS id, coalesce(incident, 0)::BIGINT AS incident, n.dn FROM c LEFT JOIN n USING (k)"
)
def chamber_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments at chambers, within 24 m as these places are far apart."""
    chambers = _nation(spark, sf_dir).select(F.col("k").alias("id"), "x", "y")
    return topology.chamber_adjacency(chambers, _pipes(spark, sf_dir).withColumnRenamed("id", "segment"), 24.0)


@query(
    "WITH o AS (SELECT c_custkey AS id, (c_custkey % 40 / 4.0)::DOUBLE AS flow FROM customer WHERE c_custkey % 3 <> 0), "
    "p AS (SELECT s_suppkey AS point, CASE WHEN s_suppkey % 11 > 0 THEN s_suppkey * 5 END AS oks_id, -s_suppkey - 1 AS id, (s_suppkey % 7)::DOUBLE AS flow FROM supplier) "
    "SELECT o.id, point, CASE WHEN o.flow > 0 THEN o.flow ELSE coalesce(p.flow, o.flow) END AS flow FROM o LEFT JOIN p ON p.oks_id = o.id UNION ALL SELECT coalesce(oks_id, id), point, flow FROM p WHERE oks_id IS NULL OR oks_id NOT IN (SELECT id FROM o)"
)
def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumers with their connection points, where there are any, and points that are consumers by themselves."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    consumers = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(k.alias("id"), (k % 40 / 4.0).alias("flow"))
    points = table(spark, sf_dir, "supplier").select(s.alias("point"), F.when(s % 11 > 0, s * 5).alias("oks_id"), (-s - 1).alias("id"), (s % 7).cast("double").alias("flow"))
    return topology.terminals(points, consumers)


@query(
    f"WITH b AS ({_NATION}), p AS (SELECT c_custkey AS id, (c_custkey * 37 % 1000)::DOUBLE AS px, (c_custkey * 91 % 1000)::DOUBLE AS py, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 30 END AS own FROM customer), "
    "h AS (SELECT p.id, b.k AS polygon, 0::DOUBLE AS d FROM p JOIN b ON b.k = p.own), "
    "n AS (SELECT id, k AS polygon, sqrt(pow(greatest(x - px, 0, px - x - 60), 2) + pow(greatest(y - py, 0, py - y - 60), 2)) AS d FROM p, b WHERE id NOT IN (SELECT id FROM h)), "
    "w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, polygon) AS rn FROM n WHERE d <= 15) "
    "SELECT id, polygon, floor(d * 1e6 + 0.5)::BIGINT AS d_um FROM h UNION ALL SELECT id, polygon, floor(d * 1e6 + 0.5)::BIGINT FROM w WHERE rn = 1"
)
def host_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buildings that connection points belong to."""
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 1000).cast("double").alias("y"), F.when(k % 5 == 0, k % 30).alias("own"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    squares = _nation(spark, sf_dir).select(F.col("k").alias("polygon"), F.array(at(0, 0), at(60, 0), at(60, 60), at(0, 60), at(0, 0)).alias("ring"))
    return topology.host_buildings(points, squares).select("id", "polygon", units(F.col("metres"), 1e6).alias("d_um"))


_RULES = ["road", "gas_pipeline", "oks", "heat_network", "park"]
_CLEARANCE = "(CASE " + " ".join(f"WHEN rule = '{x[0]}' THEN " + (f"CASE WHEN dn >= 900 THEN 9.0 WHEN dn >= 500 THEN 7.0 ELSE {x[2]} END" if x[3] else f"{x[2]}") for x in r.RESTRICTIONS if x[0] in _RULES) + " END)::DOUBLE"
_WIDTH = "(CASE dn " + " ".join(f"WHEN {d[0]} THEN {d[3]}" for d in r.DIAMETERS if d[0] in (80, 200, 500, 900)) + " END)::DOUBLE"


@query(
    f"WITH p AS ({_PIPES}), o AS (SELECT k, x AS cx, y AS cy, x + 90 AS dx, y + 40 AS dy, ['" + "', '".join(_RULES) + f"'][(k % 5 + 1)::INTEGER] AS rule, (k % 3 / 10.0)::DOUBLE AS own FROM ({_NATION})), "
    "j AS (SELECT p.id, p.dn, o.*, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by_ FROM p, o WHERE least(x0, x1) - 25 <= dx AND greatest(x0, x1) + 25 >= cx AND least(y0, y1) - 25 <= dy AND greatest(y0, y1) + 25 >= cy), "
    "d AS (SELECT *, CASE WHEN ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0 AND ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0 THEN 0 ELSE least("
    + ", ".join([_pd("ax ay", "bx by_", "cx cy"), _pd("ax ay", "bx by_", "dx dy"), _pd("cx cy", "dx dy", "ax ay"), _pd("cx cy", "dx dy", "bx by_")]) + ") END AS apart FROM j), "
    f"b AS (SELECT id, k, {_CLEARANCE} + {_WIDTH} / 2 + own / 2 - apart AS breach FROM d), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY breach DESC, k) AS rn FROM b WHERE breach > 1e-6) "
    "SELECT id, k AS obstacle, floor(breach * 1e6 + 0.5)::BIGINT AS breach_um FROM w WHERE rn = 1"
)
def clearance_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes that come too near to obstacles, and the worst of those."""
    k = F.col("k")
    obstacles = _nation(spark, sf_dir).select(k.alias("obstacle"), F.col("x").alias("ox0"), F.col("y").alias("oy0"), (F.col("x") + 90).alias("ox1"), (F.col("y") + 40).alias("oy1"), F.array(*map(F.lit, _RULES))[(k % 5).cast("int")].alias("rule"), (k % 3 / 10.0).alias("foreign"))
    return crossings.breaches(_pipes(spark, sf_dir), obstacles).select("id", "obstacle", units(F.col("breach"), 1e6).alias("breach_um"))


_LEGS = "SELECT user_id, event_id, lag((event_id % 101)::DOUBLE) OVER w AS x0, lag((event_id * 7 % 211)::DOUBLE) OVER w AS y0, (event_id % 101)::DOUBLE AS x1, (event_id * 7 % 211)::DOUBLE AS y1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"
_ZONES = "SELECT n_nationkey AS zone, n_nationkey * 4 + 0.5::DOUBLE AS zx, [1.05, 1.6, 1.75][(n_nationkey % 3 + 1)::INTEGER]::DOUBLE AS k, (n_nationkey % 3 + 1)::DOUBLE AS extend FROM nation"
_SPANNED = (
    f"WITH g AS ({_LEGS}), l AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM g WHERE x0 IS NOT NULL), "
    "o AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l), "
    f"t AS (SELECT user_id, sum(len) AS total FROM l GROUP BY user_id), z AS ({_ZONES}), "
    "c AS (SELECT user_id, zone, k, extend, off + (zx - x0) / (x1 - x0) * len AS s, abs(y1 - y0) >= 0 AS ok, CASE WHEN len > 1e-12 THEN abs(x1 - x0) / len ELSE 1 END AS sine FROM o, z WHERE x0 <> x1 AND zx >= least(x0, x1) AND zx <= greatest(x0, x1)), "
    "e AS (SELECT user_id, zone, k, CASE WHEN s - extend < 0.05 THEN 0 ELSE s - extend END AS s0, CASE WHEN s + extend > total - 0.05 THEN total ELSE s + extend END AS s1, sine < 0.7::DOUBLE AS shallow FROM c JOIN t USING (user_id)), "
    "sp AS (SELECT * FROM e WHERE s1 > s0 + 1e-9) "
)


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, order = F.col("event_id"), Window.partitionBy("path").orderBy("ord")
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), e.alias("ord"), (e % 101).cast("double").alias("x1"), (e * 7 % 211).cast("double").alias("y1"))
    return points.withColumn("x0", F.lag("x1").over(order)).withColumn("y0", F.lag("y1").over(order)).where("x0 is not null")


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    zx = n * 4 + 0.5
    zones = table(spark, sf_dir, "nation").select(n.alias("zone"), zx.alias("zx0"), F.lit(-1.0).alias("zy0"), zx.alias("zx1"), F.lit(300.0).alias("zy1"), F.array(*map(F.lit, (1.05, 1.6, 1.75)))[n % 3].alias("k"), (n % 3 + 1).cast("double").alias("extend"), F.lit(0.7).alias("least_sine"))
    return crossings.zone_spans(_legs(spark, sf_dir), zones)


@query(_SPANNED + "SELECT user_id, zone, floor(s0 * 1000 + 0.5)::BIGINT AS s0_mm, floor(s1 * 1000 + 0.5)::BIGINT AS s1_mm, k, shallow FROM sp")
def path_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where polylines cross special zones, in metres along them."""
    return _crossed(spark, sf_dir).select(F.col("path").alias("user_id"), "zone", units(F.col("s0"), 1000).alias("s0_mm"), units(F.col("s1"), 1000).alias("s1_mm"), "k", "shallow")


_MERGED = (
    _SPANNED + ", cuts AS (SELECT DISTINCT user_id, unnest([s0, s1]) AS pos FROM sp), pc AS (SELECT user_id, pos, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS to_ FROM cuts), "
    "cv AS (SELECT p.user_id, p.pos, p.to_, max(k) AS k FROM pc p JOIN sp ON sp.user_id = p.user_id AND s0 <= (pos + to_) / 2 AND (pos + to_) / 2 <= s1 WHERE to_ - pos >= 1e-9 GROUP BY ALL) "
)


@query(_MERGED + "SELECT user_id, floor(sum((k - 1) * (to_ - pos)) * 1000 + 0.5)::BIGINT AS extra_mm FROM cv GROUP BY user_id")
def path_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What crossings cost more, as metres of plain pipe."""
    return crossings.crossing_extra(_crossed(spark, sf_dir)).select(F.col("path").alias("user_id"), units(F.col("extra"), 1000).alias("extra_mm"))


@query(
    _MERGED + ", sums AS (SELECT user_id, k, floor(sum(to_ - pos) * 1000 + 0.5)::BIGINT AS mm FROM cv GROUP BY ALL), "
    "rest AS (SELECT t.user_id, 1::DOUBLE AS k, floor((total - coalesce(c.len, 0)) * 1000 + 0.5)::BIGINT AS mm FROM t LEFT JOIN (SELECT user_id, sum(to_ - pos) AS len FROM cv GROUP BY user_id) c ON c.user_id = t.user_id) "
    "SELECT user_id, k, mm FROM sums UNION ALL SELECT * FROM rest WHERE mm > 0"
)
def cut_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths cut at special spans: metres of each factor, after cutting."""
    spans = intervals.merge_spans(_crossed(spark, sf_dir), "path")
    pieces = crossings.cut_at_spans(_legs(spark, sf_dir), spans)
    sums = pieces.groupBy(F.col("path").alias("user_id"), "k").agg(units(F.sum(F.col("s1") - F.col("s0")), 1000).alias("mm"))
    return sums.where("mm > 0")


@query(
    f"WITH l AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM ({_LEGS}) WHERE x0 IS NOT NULL), "
    "o AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l), "
    "s AS (SELECT DISTINCT user_id, unnest([10.5, 100.25, 1e9])::DOUBLE AS s FROM l), "
    "k AS (SELECT s.user_id, s.s, o.*, row_number() OVER (PARTITION BY s.user_id, s.s ORDER BY off DESC, event_id DESC) AS rn FROM s JOIN o ON o.user_id = s.user_id AND off <= s.s) "
    "SELECT user_id, s, floor((x0 + least(1, (s - off) / len) * (x1 - x0)) * 1000 + 0.5)::BIGINT AS x_mm, floor((y0 + least(1, (s - off) / len) * (y1 - y0)) * 1000 + 0.5)::BIGINT AS y_mm FROM k WHERE rn = 1"
)
def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at given metres along polylines; beyond the end, the end."""
    legs = _legs(spark, sf_dir)
    stations = legs.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, (10.5, 100.25, 1e9)))).alias("s"))
    return crossings.points_at(legs, stations).select(F.col("path").alias("user_id"), "s", units(F.col("x"), 1000).alias("x_mm"), units(F.col("y"), 1000).alias("y_mm"))


@query(
    f"WITH l AS (SELECT *, lead(x1) OVER (PARTITION BY user_id ORDER BY event_id) AS x2, lead(y1) OVER (PARTITION BY user_id ORDER BY event_id) AS y2 FROM ({_LEGS})), "
    "d AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS n FROM l WHERE x0 IS NOT NULL AND x2 IS NOT NULL), "
    "t AS (SELECT user_id, CASE WHEN n > 1e-12 THEN degrees(acos(greatest(-1, least(1, ((x1 - x0) * (x2 - x1) + (y1 - y0) * (y2 - y1)) / n)))) ELSE 0 END AS a FROM d) "
    "SELECT user_id, count(*) AS bends, count(*) FILTER (a > 90.001) AS sharp, floor(max(a) * 1000 + 0.5)::BIGINT AS most_mdeg FROM t GROUP BY user_id"
)
def path_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bends of polylines, and how many turn by more than a right angle."""
    order = Window.partitionBy("path").orderBy("ord")
    bends = _legs(spark, sf_dir).withColumn("x2", F.lead("x1").over(order)).withColumn("y2", F.lead("y1").over(order)).where("x2 is not null")
    at = lambda i: (F.col(f"x{i}"), F.col(f"y{i}"))
    turned = bends.select(F.col("path").alias("user_id"), g.turn(at(0), at(1), at(2)).alias("a"))
    return turned.groupBy("user_id").agg(F.count("*").alias("bends"), F.count_if(F.col("a") > 90.001).alias("sharp"), units(F.max("a"), 1000).alias("most_mdeg"))


@query(
    f"WITH p AS ({_PIPES}), b AS ({_NATION}), "
    "k AS (SELECT p.id, b.k, (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) AS a1, (x1 - x0) * (y + 80 - y0) - (y1 - y0) * (x - x0) AS a2, (x1 - x0) * (y - y0) - (y1 - y0) * (x + 80 - x0) AS a3, (x1 - x0) * (y + 80 - y0) - (y1 - y0) * (x + 80 - x0) AS a4 FROM p, b WHERE x0 <= x + 80 AND x1 >= x AND y0 <= y + 80 AND y1 >= y) "
    "SELECT k AS box, count(*) AS pipes FROM k WHERE least(a1, a2, a3, a4) <= 0 AND greatest(a1, a2, a3, a4) >= 0 GROUP BY k"
)
def box_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes that meet square boxes, found by the cells of both."""
    boxes = topology._boxed(_nation(spark, sf_dir).select(F.col("k").alias("box"), F.col("x").alias("lx"), F.col("y").alias("ly"), (F.col("x") + 80).alias("hx"), (F.col("y") + 80).alias("hy")), ("lx", "hx"), ("ly", "hy"), 80.0)
    near = topology._boxed(_pipes(spark, sf_dir), ("x0", "x1"), ("y0", "y1"), 80.0).join(boxes, ["cx", "cy"])
    at = lambda a, b: (F.col(a), F.col(b))
    hit = near.where(g.meets_box(at("x0", "y0"), at("x1", "y1"), at("lx", "ly"), at("hx", "hy")))
    return hit.select("box", "id").distinct().groupBy("box").agg(F.count("*").alias("pipes"))


#: The height of the next diameter that is not smaller.
_HEIGHT = "(CASE " + " ".join(f"WHEN {{dn}} <= {d} THEN {h}" for d, h in r.HEIGHTS) + f" ELSE {r.HEIGHTS[-1][1]} END)::DOUBLE"
_KINDS = ["Gas main", "power cable", "Railway 2", "tram", "heat_network", "road", "wall"]


@query(
    f"WITH u AS (SELECT l_orderkey, l_linenumber, lower(trim(['" + "', '".join(_KINDS) + "'][(l_partkey % 7 + 1)::INTEGER])) AS t, 1 + l_quantity / 20 AS top, [80, 100, 200, 1400][(l_linenumber % 4 + 1)::INTEGER] AS dn, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 * 250 END AS other FROM lineitem), "
    "w AS (SELECT *, CASE WHEN contains(t, 'rail') OR contains(t, 'железн') THEN 'RAILWAY' WHEN contains(t, 'tram') OR contains(t, 'трам') THEN 'TRAM' WHEN contains(t, 'gas') OR contains(t, 'газ') THEN 'GAS' WHEN contains(t, 'cable') OR contains(t, 'кабел') THEN 'CABLE' WHEN contains(t, 'heat') OR contains(t, 'тепл') THEN 'HEAT' WHEN contains(t, 'road') OR contains(t, 'дорог') THEN 'ROAD' END AS kind FROM u), "
    f"h AS (SELECT *, {_HEIGHT.format(dn='dn')} AS own, CASE kind WHEN 'GAS' THEN 0.4 WHEN 'CABLE' THEN 0.2 WHEN 'HEAT' THEN {_HEIGHT.format(dn='coalesce(other, 150)')} END AS theirs, CASE kind WHEN 'GAS' THEN 0.2 WHEN 'CABLE' THEN 0.5 WHEN 'HEAT' THEN 0.5 END AS clear FROM w) "
    "SELECT kind, dn, other, count(*) AS n, min(floor((top - clear - own) * 1e6 + 0.5)::BIGINT) AS above_um, max(floor((top + theirs + clear) * 1e6 + 0.5)::BIGINT) AS below_um, max(CASE kind WHEN 'ROAD' THEN 1.0 WHEN 'TRAM' THEN 1.2 END)::DOUBLE AS cover FROM h GROUP BY kind, dn, other"
)
def depth_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utilities by kind, and the depths at which pipes may pass above or below them."""
    line = table(spark, sf_dir, "lineitem")
    kind = depth.obstacle_kind(F.array(*map(F.lit, _KINDS))[(F.col("l_partkey") % 7).cast("int")])
    top, dn = 1 + F.col("l_quantity") / 20, F.array(*map(F.lit, (80, 100, 200, 1400)))[F.col("l_linenumber") % 4]
    other = F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 3 * 250)
    window = depth.window(F.col("kind"), F.col("top"), F.col("dn"), F.col("other"))
    placed = line.select(kind.alias("kind"), top.alias("top"), dn.alias("dn"), other.alias("other")).select("kind", "dn", "other", window.alias("w"), depth.least_cover(F.col("kind")).alias("cover"))
    return placed.groupBy("kind", "dn", "other").agg(F.count("*").alias("n"), F.min(units(F.col("w.above_max"), 1e6)).alias("above_um"), F.max(units(F.col("w.below_min"), 1e6)).alias("below_um"), F.max("cover").alias("cover"))


@query(
    "WITH p AS (SELECT l_orderkey AS edge, l_linenumber AS pin, l_quantity AS s0, l_quantity + l_linenumber AS s1 FROM lineitem), c AS (SELECT o_orderkey AS edge, (o_custkey % 50)::DOUBLE AS c0, (o_custkey % 50 + 6)::DOUBLE AS c1, 0.7 + (o_custkey % 9) / 10.0::DOUBLE AS cover FROM orders) "
    "SELECT p.edge, pin, floor(coalesce(max(cover), 0.7) * 1e6 + 0.5)::BIGINT AS floor_um FROM p LEFT JOIN c ON c.edge = p.edge AND c0 <= s1 AND s0 <= c1 GROUP BY p.edge, pin"
)
def pin_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least depth at pins under covers of the same pipe."""
    line, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    pins = line.select(F.col("l_orderkey").alias("edge"), F.col("l_linenumber").alias("pin"), q.alias("s0"), (q + F.col("l_linenumber")).alias("s1"))
    k = F.col("o_custkey")
    covers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge"), (k % 50).cast("double").alias("c0"), (k % 50 + 6).cast("double").alias("c1"), (0.7 + k % 9 / 10.0).alias("cover"))
    return depth.pin_floors(pins, covers).select("edge", "pin", units(F.col("floor"), 1e6).alias("floor_um"))


@query(
    f"WITH {_DN}, d AS (SELECT o_custkey % 200 AS plan, sum(floor(o_totalprice)::BIGINT % 90)::DOUBLE AS flow FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL) "
    "SELECT plan, flow, coalesce((SELECT min(dn) FROM dims WHERE flow <= cap + 1e-9), 1400)::INTEGER AS dn FROM d"
)
def design_dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demand of all connected consumers of a plan, and the diameter for it."""
    demand = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("plan"), (F.floor("o_totalprice") % 90).cast("double").alias("flow"), (F.col("o_orderstatus") != "P").alias("connected"))
    return costing.design_dn(demand, "plan")


@query(
    "WITH t AS (SELECT o_custkey % 300 AS plan, CASE WHEN o_orderstatus = 'F' THEN 'N' || o_orderkey END AS chamber, CASE WHEN o_orderstatus = 'O' THEN o_custkey % 7 END AS existing FROM orders) "
    "SELECT plan, CASE WHEN count(chamber) + count(DISTINCT existing) > 0 THEN count(chamber) + count(DISTINCT existing) ELSE count(*) END AS sites FROM t GROUP BY plan"
)
def tap_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where plans join the existing network: new chambers at taps and existing ones, each once."""
    status = F.col("o_orderstatus")
    taps = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("plan"), F.when(status == "F", F.concat(F.lit("N"), "o_orderkey")).alias("chamber"), F.when(status == "O", F.col("o_custkey") % 7).alias("existing"))
    return costing.tap_sites(taps, "plan")


@query(
    "WITH p AS (SELECT o_custkey % 400 AS run, ['mincost', 'mintaps', 'minrecon'][(o_orderkey % 3 + 1)::INTEGER] AS code, floor(min(o_totalprice) * 1000) AS cost, (count(*) % 4)::BIGINT AS taps, floor(max(o_totalprice) / 100) AS length, CASE WHEN count(*) % 3 = 0 THEN 'own title' ELSE 'Минимальная стоимость' END AS title FROM orders GROUP BY ALL), "
    "s AS (SELECT *, 0.7 * cost / 25e6::DOUBLE + 0.3 * length / 100.0::DOUBLE AS score FROM p), m AS (SELECT run, min(score) AS least, bool_or(code = 'mincost') AS asked FROM s GROUP BY run), "
    "b AS (SELECT DISTINCT ON (s.run) s.run, code AS best, taps AS best_taps, length AS best_length FROM s JOIN m ON m.run = s.run AND score <= least + 1e-9 ORDER BY s.run, taps, code) "
    "SELECT run, code, CASE WHEN NOT asked THEN title WHEN code = best THEN 'Минимальная стоимость' WHEN title <> 'Минимальная стоимость' THEN title WHEN taps < best_taps THEN 'Минимум врезок' WHEN length + 40 < best_length THEN 'Минимальная длина' ELSE 'Дополнительный контур' END AS title FROM s JOIN m USING (run) JOIN b USING (run)"
)
def plan_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the plans of runs, so that only the best by score bears that of least cost."""
    code = F.array(*map(F.lit, ("mincost", "mintaps", "minrecon")))[(F.col("o_orderkey") % 3).cast("int")]
    title = F.when(F.count("*") % 3 == 0, "own title").otherwise(costing.LEAST_COST)
    plans = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 400).alias("run"), code.alias("code")).agg(F.floor(F.min("o_totalprice") * 1000).cast("double").alias("cost"), (F.count("*") % 4).alias("taps"), F.floor(F.max("o_totalprice") / 100).cast("double").alias("length"), title.alias("title"))
    return costing.titled(plans, "run").select("run", "code", "title")


@query(
    "WITH c AS (SELECT o_custkey % 100 AS plan, o_orderkey AS id, floor(o_totalprice)::BIGINT % 500 AS near, (o_orderkey % 90)::BIGINT AS flow FROM orders) "
    "SELECT plan, id, (row_number() OVER (PARTITION BY plan ORDER BY near, id))::INTEGER AS nearest, (row_number() OVER (PARTITION BY plan ORDER BY flow DESC, id))::INTEGER AS largest, (row_number() OVER (PARTITION BY plan ORDER BY near DESC, id))::INTEGER AS farthest FROM c"
)
def start_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in which consumers may be joined to a plan."""
    consumers = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("plan"), F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") % 500).alias("near"), (F.col("o_orderkey") % 90).alias("flow"))
    return costing.start_orders(consumers, "plan").select("plan", "id", "nearest", "largest", "farthest")


_OWN = "SELECT DISTINCT (o_orderkey % 3 + 1)::BIGINT AS v, 'N' || o_custkey % 40 AS id FROM orders"
_JSON = "CASE WHEN regexp_full_match({x}, '-?[0-9]{{1,18}}') THEN {x} ELSE '\"' || {x} || '\"' END"
_OUT = "CASE WHEN {o}.id IS NOT NULL THEN '\"' || {v} || '-' || {x} || '\"' ELSE " + _JSON + " END"


@query(
    f"WITH own AS ({_OWN}), s AS (SELECT (l_orderkey % 3 + 1)::BIGINT AS v, 'S' || l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_partkey % 5 = 0 THEN (l_partkey % 40)::VARCHAR ELSE 'N' || l_partkey % 50 END AS f, 'N' || l_suppkey % 50 AS t, l_quantity AS len, l_extendedprice AS cost, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 17 END AS d0, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity / 13 END AS d1 FROM lineitem), "
    "seg AS (SELECT 1 AS ord, 'heat_network' AS object_type, s.v AS variant_id, '\"' || s.v || '-' || s.id || '\"' AS id, "
    + _OUT.format(o="b", v="s.v", x="s.t") + " AS start_node_id, " + _OUT.format(o="a", v="s.v", x="s.f") + " AS end_node_id, floor(len * 100 + 0.5) / 100 AS length, floor(coalesce(d1, d0) * 10000 + 0.5) / 10000 AS depth_start, floor(coalesce(d0, d1) * 10000 + 0.5) / 10000 AS depth_end, floor(cost * 100 + 0.5) / 100 AS cost "
    "FROM s LEFT JOIN own a ON a.v = s.v AND a.id = s.f LEFT JOIN own b ON b.v = s.v AND b.id = s.t), "
    "ch AS (SELECT 2, 'heat_chamber', v, '\"' || v || '-' || id || '\"', NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 3e6::DOUBLE FROM own), "
    "tn AS (SELECT 3, 'technical_node', p_partkey % 3 + 1, '\"' || (p_partkey % 3 + 1) || '-T' || p_partkey || '\"', NULL, NULL, NULL, NULL, NULL, NULL::DOUBLE FROM part), "
    "su AS (SELECT 4, 'variant_summary', v, v::VARCHAR, NULL, NULL, sum(floor(len * 100 + 0.5)::BIGINT)::DOUBLE / 100, NULL, NULL, sum(floor(cost * 100 + 0.5)::BIGINT)::DOUBLE / 100 FROM s GROUP BY v) "
    "SELECT * FROM seg UNION ALL SELECT * FROM ch UNION ALL SELECT * FROM tn UNION ALL SELECT * FROM su"
)
def result_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds of result features of three variants: pipes run from the network, own ids get the variant's prefix."""
    line, q = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    n = lambda c: F.concat(F.lit("N"), (F.col(c) % 50).cast("string"))
    segments = line.select(
        (F.col("l_orderkey") % 3 + 1).alias("variant_id"), F.concat(F.lit("S"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"),
        F.when(F.col("l_partkey") % 5 == 0, (F.col("l_partkey") % 40).cast("string")).otherwise(n("l_partkey")).alias("from_id"), n("l_suppkey").alias("to_id"), q.alias("length"), F.col("l_extendedprice").alias("cost"),
        F.when(F.col("l_linenumber") % 2 == 0, q / 17).alias("depth_from"), F.when(F.col("l_linenumber") % 3 == 0, q / 13).alias("depth_to"),
    )
    orders = table(spark, sf_dir, "orders")
    chambers = orders.select((F.col("o_orderkey") % 3 + 1).alias("variant_id"), F.concat(F.lit("N"), (F.col("o_custkey") % 40).cast("string")).alias("id")).distinct().withColumn("cost", F.lit(3e6))
    nodes = table(spark, sf_dir, "part").select((F.col("p_partkey") % 3 + 1).alias("variant_id"), F.concat(F.lit("T"), "p_partkey").alias("id"))
    return geojson.result_features(segments, chambers, nodes)


@query(None)
def run_limited_dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diameters of a tree by flow, by what is below, and by how far a diameter may run; no SQL, as that would aggregate in a recursion."""
    tree = _tree(spark, sf_dir).withColumn("flow", F.floor("flow") * 3).withColumn("length", F.col("length") * 9.0)
    flows = network.subtree_sums(tree.select("node", "parent", "length", "flow"), "flow").select("node", F.col("total").alias("flow"))
    sized = network.run_limited_dn(tree.select("node", "parent", "length").join(flows, "node"))
    return sized.select("node", "dn", units(F.col("run"), 1000).alias("run_mm"))


@query(None)
def upstream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which end of each segment is nearer to a source, and the segment or source behind it; ids that are given stay."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").where("c_custkey >= 3")
    segments = customers.select(k.alias("segment"), k.alias("a"), F.floor(k / 3).alias("b"), (k % 30 + 1).cast("double").alias("length"), F.when(k % 11 == 0, F.concat(F.lit("given "), k)).alias("next_id"))
    return topology.oriented(segments, table(spark, sf_dir, "customer").where("c_custkey % 97 = 1").select(k.alias("node")))
