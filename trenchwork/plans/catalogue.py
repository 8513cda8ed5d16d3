"""Every registered query of the planning operators, with the SQL to compare it with.

The driver's tables hold no geometry; each query derives pipes, points, spans or trees from whole
tables by arithmetic that stands in both texts. Money and lengths are summed as whole numbers of
small units, so that sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import crs
from ..functions import geometry as g
from ..functions import rules as r
from ..operators import costing, depth, intervals, network, routes, spatial
from ..sources import geojson

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(value, per: float):
    """A whole number of units, half up."""
    return F.floor(value * per + 0.5).cast("long")


_DN = "dims(dn, cap, run, width, price) AS (VALUES " + ", ".join(f"({d}, {c}::DOUBLE, {m}::DOUBLE, {w}::DOUBLE, {p}::DOUBLE)" for d, c, m, w, p in r.DIAMETERS) + ")"
_DN_OF = "coalesce((SELECT min(dn) FROM dims WHERE {flow} <= cap + 1e-9), 1400)"
_PRICE_OF = "coalesce((SELECT arg_min(price, dn) FROM dims WHERE {dn} <= dn), 683417.0::DOUBLE)"
_TIER_OF = "(CASE WHEN greatest({dn}, 50) <= 200 THEN 3e6 WHEN greatest({dn}, 50) <= 500 THEN 5e6 WHEN greatest({dn}, 50) <= 1000 THEN 8e6 ELSE 12e6 END)"
_FACTOR = "(CASE WHEN {h} <= 3 + 1e-9 THEN 1.0::DOUBLE ELSE 1 + 0.1::DOUBLE * ({h} - 3) END)"


@query(
    f"WITH {_DN}, pipes AS (SELECT l_quantity * 10 AS flow, l_extendedprice / 1000 AS len FROM lineitem), "
    "sized AS (SELECT p.len, d.dn, d.price FROM pipes p ASOF JOIN (SELECT *, coalesce(lag(cap) OVER (ORDER BY dn) + 1e-9, -1e300) AS above FROM dims) d ON p.flow > d.above) "
    "SELECT dn::INTEGER AS dn, count(*) AS n, sum(floor(len * 1000 + 0.5)::BIGINT)::BIGINT AS length_mm, sum(floor(len * price * 100 + 0.5)::BIGINT)::BIGINT AS cost_cents, "
    "row_number() OVER (ORDER BY sum(floor(len * price * 100 + 0.5)::BIGINT) DESC, dn)::INTEGER AS rank FROM sized GROUP BY dn"
)
def dn_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pipes: diameter by flow, price by diameter, totals ranked."""
    pipes = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 10).alias("flow"), (F.col("l_extendedprice") / 1000).alias("len"))
    sized = pipes.withColumn("dn", r.dn_for_flow(F.col("flow")))
    cost = units(F.col("len") * r.price_per_metre(F.col("dn")), 100)
    sums = sized.groupBy("dn").agg(F.count("*").alias("n"), F.sum(units(F.col("len"), 1000)).alias("length_mm"), F.sum(cost).alias("cost_cents"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cost_cents"), "dn")))


@query(
    f"SELECT p_partkey, p_size * 20 AS dn, {_TIER_OF.format(dn='p_size * 20')}::DOUBLE AS chamber, (100e6 + 500e3 * (p_retailprice / 100))::DOUBLE AS penalty, "
    "(CASE " + " ".join(f"WHEN p_size * 20 < {d[0]} THEN {d[0]}" for d in r.DIAMETERS) + " ELSE 1400 END)::INTEGER AS next_dn, "
    "(CASE " + " ".join(f"WHEN p_size * 20 <= {d[0]} THEN {d[2]}" for d in r.DIAMETERS) + " ELSE 11276.0 END)::DOUBLE AS most_run FROM part"
)
def chamber_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    dn = (F.col("p_size") * 20).alias("dn")
    return table(spark, sf_dir, "part").select("p_partkey", dn, "p_retailprice").select(
        "p_partkey", "dn", r.chamber_price(F.col("dn")).alias("chamber"), r.unconnected_penalty(F.col("p_retailprice") / 100).alias("penalty"),
        r.next_dn(F.col("dn")).alias("next_dn"), r.greatest_run(F.col("dn")).alias("most_run"),
    )


@query(
    "WITH d AS (SELECT l_returnflag, l_quantity / 10 AS a, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity / 10 + l_discount * 10 END AS b FROM lineitem) "
    f"SELECT l_returnflag, sum(floor(({_FACTOR.format(h='a')} + {_FACTOR.format(h='coalesce(b, a)')}) / 2 * 1e6 + 0.5)::BIGINT)::BIGINT AS factor_ppm, count(*) AS n FROM d GROUP BY l_returnflag"
)
def depth_cost_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_quantity") / 10
    b = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") / 10 + F.col("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(units(r.mean_depth_factor(a, b), 1e6)).alias("factor_ppm"), F.count("*").alias("n"))


_RULE_TEXTS = ["oks", " Road ", "tdtp_2", "Tram line", "RAIL", "broadway", "gas", "Power Cable 6 kV", "heat_network", "park", "unknown", "OKS_existing", "waterfront", ""]
_TEXT_SQL = "[" + ", ".join(f"'{t}'" for t in _RULE_TEXTS) + "]"


@query(
    f"WITH t AS (SELECT p_partkey, p_size * 30 AS dn, lower(trim({_TEXT_SQL}[(p_partkey % {len(_RULE_TEXTS)} + 1)::INTEGER])) AS name FROM part), "
    "x AS (SELECT *, CASE WHEN name IN (" + ", ".join(f"'{x[0]}'" for x in r.RESTRICTIONS) + ") THEN name "
    + " ".join(f"WHEN contains(name, '{a}') THEN '{b}'" for a, b in r.RESTRICTION_ALIASES) + " ELSE 'default' END AS rule FROM t) "
    "SELECT p_partkey, rule, (CASE " + " ".join(f"WHEN rule = '{x[0]}' THEN " + (f"CASE WHEN dn >= 900 THEN 9.0 WHEN dn >= 500 THEN 7.0 ELSE {x[2]} END" if x[3] else f"{x[2]}") for x in r.RESTRICTIONS) + " END)::DOUBLE AS clearance, "
    "(CASE " + " ".join(f"WHEN rule = '{x[0]}' THEN '{x[1]}'" for x in r.RESTRICTIONS) + " END) AS action, "
    "(CASE " + " ".join(f"WHEN rule = '{x[0]}' THEN {x[4]}" for x in r.RESTRICTIONS) + " END)::DOUBLE AS factor FROM x"
)
def clearance_by_dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*[F.lit(t) for t in _RULE_TEXTS])
    named = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 30).alias("dn"), r.restriction_rule(texts[(F.col("p_partkey") % len(_RULE_TEXTS)).cast("int")]).alias("rule"))
    return named.select("p_partkey", "rule", r.clearance(F.col("rule"), F.col("dn")).alias("clearance"), r.restriction_value(F.col("rule"), 1).alias("action"), r.restriction_value(F.col("rule"), 4).alias("factor"))


_KIND_TEXTS = ["heat_network", " TK ", "source", "OKS", "oks_existing", "connection_point", "restriction", "", "камера 5", "old chamber", "тэц-1", "big road", "river bank", "misc", "Oks_Future"]
_SHAPES = ["Point", "LineString", "Polygon", "MultiPolygon", "MultiPoint"]


@query(
    "WITH t AS (SELECT p_partkey, lower(trim([" + ", ".join(f"'{t}'" for t in _KIND_TEXTS) + f"][(p_partkey % {len(_KIND_TEXTS)} + 1)::INTEGER])) AS k, "
    "lower([" + ", ".join(f"'{t}'" for t in _SHAPES) + "][(p_size % 5 + 1)::INTEGER]) AS s, CASE WHEN p_partkey % 2 = 0 THEN 1.0 END AS flow, CASE WHEN p_partkey % 3 = 0 THEN 'a' END AS nx, CASE WHEN p_partkey % 7 < 3 THEN 'b' END AS oks FROM part) "
    "SELECT p_partkey, CASE " + " ".join(f"WHEN k = '{k}' THEN '{v}'" for k, v in r.KIND_TOKENS.items())
    + " WHEN contains(s, 'line') AND nx IS NOT NULL THEN 'EXISTING_SEGMENT' WHEN s IN ('point', 'multipoint') AND oks IS NOT NULL THEN 'CONNECTION_POINT' WHEN contains(s, 'polygon') AND flow IS NOT NULL THEN 'OKS_PROSPECTIVE' "
    "WHEN contains(k, 'камер') OR contains(k, 'chamber') THEN 'CHAMBER' WHEN contains(k, 'источ') OR contains(k, 'source') OR contains(k, 'тэц') THEN 'SOURCE' "
    "WHEN contains(s, 'polygon') OR " + " OR ".join(f"contains(k, '{c}')" for c in r.CONSTRAINT_TEXTS) + " THEN 'CONSTRAINT' ELSE 'UNKNOWN' END AS kind FROM t"
)
def kind_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.array(*[F.lit(t) for t in _KIND_TEXTS])[(key % len(_KIND_TEXTS)).cast("int")]
    shape = F.array(*[F.lit(t) for t in _SHAPES])[F.col("p_size") % 5]
    kind = r.feature_kind(text, shape, F.when(key % 2 == 0, 1.0), F.when(key % 3 == 0, "a"), F.when(key % 7 < 3, "b"))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query(
    "WITH t AS (SELECT event_id, event_type, [' ' || value::VARCHAR, replace(value::VARCHAR, '.', ','), 'n/a', NULL][(event_id % 4 + 1)::INTEGER] AS q, props->>'k' AS k FROM events) "
    "SELECT event_id, coalesce(try_cast(replace(q, ',', '.') AS DOUBLE), try_cast(replace(k, ',', '.') AS DOUBLE)) AS flow, coalesce(CASE WHEN trim(q) <> '' THEN q END, k) AS label FROM t"
)
def alias_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first property of several names that is a number, or not blank."""
    raw = F.array(F.concat(F.lit(" "), F.col("value").cast("string")), F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit("n/a"), F.lit(None))[(F.col("event_id") % 4).cast("int")]
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("q"), raw))
    read = table(spark, sf_dir, "events").select("event_id", props.alias("p"))
    return read.select("event_id", r.alias_number(F.col("p"), ["flow_tph", "q", "k"]).alias("flow"), r.alias_text(F.col("p"), ["name", "q", "k"]).alias("label"))


_UTM = f"""
WITH k AS (SELECT {crs.ECC2}::DOUBLE AS e2, ({crs.ECC2!r}::DOUBLE / (1 - {crs.ECC2!r}::DOUBLE)) AS ep, {crs.AXIS}::DOUBLE AS ax),
p AS (SELECT c_custkey, radians(37 + (c_custkey % 4000) / 1000.0::DOUBLE) AS lon, radians(55 + (c_custkey % 700) / 500.0::DOUBLE) AS phi FROM customer),
q AS (SELECT *, ax / sqrt(1 - e2 * sin(phi) * sin(phi)) AS n, tan(phi) * tan(phi) AS t, ep * cos(phi) * cos(phi) AS c, cos(phi) * (lon - radians(39.0::DOUBLE)) AS a,
  ax * ((1 - e2/4 - 3*e2*e2/64 - 5*e2*e2*e2/256) * phi - (3*e2/8 + 3*e2*e2/32 + 45*e2*e2*e2/1024) * sin(2*phi) + (15*e2*e2/256 + 45*e2*e2*e2/1024) * sin(4*phi) - (35*e2*e2*e2/3072) * sin(6*phi)) AS m FROM p, k),
u AS (SELECT c_custkey, lon, phi,
  0.9996::DOUBLE * n * (a + (1 - t + c) * a*a*a/6 + (5 - 18*t + t*t + 72*c - 58*ep) * a*a*a*a*a/120) + 500000 AS east,
  0.9996::DOUBLE * (m + n * tan(phi) * (a*a/2 + (5 - t + 9*c + 4*c*c) * a*a*a*a/24 + (61 - 58*t + t*t + 600*c - 330*ep) * a*a*a*a*a*a/720)) AS north FROM q)
"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = 37 + (F.col("c_custkey") % 4000) / 1000.0, 55 + (F.col("c_custkey") % 700) / 500.0
    return table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))


@query(_UTM + "SELECT c_custkey, floor(east * 1000 + 0.5)::BIGINT AS east_mm, floor(north * 1000 + 0.5)::BIGINT AS north_mm FROM u")
def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = crs.to_metres(F.col("lon"), F.col("lat"))
    return _places(spark, sf_dir).select("c_custkey", units(east, 1000).alias("east_mm"), units(north, 1000).alias("north_mm"))


@query(_UTM + "SELECT c_custkey, floor(degrees(lon) * 1e6 + 0.5)::BIGINT AS lon_e6, floor(degrees(phi) * 1e6 + 0.5)::BIGINT AS lat_e6 FROM u")
def utm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back gives the same millionths of a degree."""
    east, north = crs.to_metres(F.col("lon"), F.col("lat"))
    metres = _places(spark, sf_dir).select("c_custkey", east.alias("east"), north.alias("north"))
    lon, lat = crs.to_degrees(F.col("east"), F.col("north"))
    return metres.select("c_custkey", units(lon, 1e6).alias("lon_e6"), units(lat, 1e6).alias("lat_e6"))


_SEG = "SELECT o_orderkey AS id, (o_orderkey % 17)::DOUBLE AS ax, (o_custkey % 13)::DOUBLE AS ay, (o_orderkey % 11)::DOUBLE AS bx, (o_custkey % 19)::DOUBLE AS by_, (o_orderkey % 7)::DOUBLE AS cx, (o_custkey % 5)::DOUBLE AS cy, (o_custkey % 23)::DOUBLE AS dx, (o_orderkey % 29)::DOUBLE AS dy FROM orders"


def _cross(a: str, b: str, c: str) -> str:
    (ax, ay), (bx, by), (cx, cy) = (x.split() for x in (a, b, c))
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


_A, _B, _C, _D = "ax ay", "bx by_", "cx cy", "dx dy"


def _pd(a: str, b: str, p: str) -> str:
    (ax, ay), (bx, by), (px, py) = (x.split() for x in (a, b, p))
    t = f"greatest(0, least(1, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}), 0), 0)))"
    return f"sqrt(pow({ax} + {t} * ({bx} - {ax}) - {px}, 2) + pow({ay} + {t} * ({by} - {ay}) - {py}, 2))"


@query(
    f"WITH s AS ({_SEG}), x AS (SELECT *, {_cross(_A, _B, _C)} AS d1, {_cross(_A, _B, _D)} AS d2, {_cross(_C, _D, _A)} AS d3, {_cross(_C, _D, _B)} AS d4 FROM s), y AS (SELECT *, d1 * d2 < 0 AND d3 * d4 < 0 AS crosses FROM x) "
    "SELECT id, crosses, floor((CASE WHEN crosses THEN 0 ELSE least(" + ", ".join([_pd(_A, _B, _C), _pd(_A, _B, _D), _pd(_C, _D, _A), _pd(_C, _D, _B)]) + ") END) * 1e6 + 0.5)::BIGINT AS apart_um, "
    "CASE WHEN crosses THEN floor(d3 / (d3 - d4) * 1e6 + 0.5)::BIGINT END AS place_ppm FROM y"
)
def segment_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossing, place of crossing and distance of pairs of segments."""
    m = lambda c, n: (F.col(c) % n).cast("double")
    o, k = "o_orderkey", "o_custkey"
    a, b, c, d = (m(o, 17), m(k, 13)), (m(o, 11), m(k, 19)), (m(o, 7), m(k, 5)), (m(k, 23), m(o, 29))
    crosses = g.crosses(a, b, c, d)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), crosses.alias("crosses"), units(g.segment_distance(a, b, c, d), 1e6).alias("apart_um"), F.when(crosses, units(g.cross_place(a, b, c, d), 1e6)).alias("place_ppm")
    )


@query(
    "WITH pts AS (SELECT user_id, event_id, (event_id % 101)::DOUBLE AS x, floor(value) AS y, lag((event_id % 101)::DOUBLE) OVER w AS px, lag(floor(value)) OVER w AS py FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) "
    "SELECT user_id, count(*) AS points, floor(coalesce(sum(floor(sqrt(pow(x - px, 2) + pow(y - py, 2)) * 1e6 + 0.5)), 0))::BIGINT AS length_um FROM pts GROUP BY user_id"
)
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of each user's polyline, by a window rather than a collected array."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    points = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 101).cast("double").alias("x"), F.floor("value").alias("y"))
    legs = points.withColumn("leg", units(g.distance((F.lag("x").over(w), F.lag("y").over(w)), (F.col("x"), F.col("y"))), 1e6))
    return legs.groupBy("user_id").agg(F.count("*").alias("points"), F.coalesce(F.sum("leg"), F.lit(0)).alias("length_um"))


_POINTS = "SELECT c_custkey AS id, (c_custkey * 37 % 1000)::DOUBLE AS x, (c_custkey * 91 % 1000)::DOUBLE AS y FROM customer"


def _points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), (F.col(key) * 37 % 1000).cast("double").alias("x"), (F.col(key) * 91 % 1000).cast("double").alias("y"))


@query(
    f"WITH p AS ({_POINTS}), d AS (SELECT n_nationkey AS polygon, (n_nationkey * 211 % 1000)::DOUBLE AS mx, (n_nationkey * 383 % 1000)::DOUBLE AS my FROM nation) "
    "SELECT id, polygon FROM p, d WHERE abs(x - mx) + abs(y - my) < 60.5"
)
def points_in_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in diamonds, by counting crossings of their edges."""
    mx, my = (F.col("n_nationkey") * 211 % 1000).cast("double"), (F.col("n_nationkey") * 383 % 1000).cast("double")
    corner = lambda dx, dy: F.struct((mx + dx).alias("x"), (my + dy).alias("y"))
    rings = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("polygon"), F.array(corner(60.5, 0), corner(0, 60.5), corner(-60.5, 0), corner(0, -60.5), corner(60.5, 0)).alias("ring"))
    return spatial.points_inside(_points(spark, sf_dir, "customer", "c_custkey"), rings, 60.0)


@query(
    f"WITH c AS ({_POINTS}), s AS (SELECT s_suppkey AS sid, (s_suppkey * 37 % 1000)::DOUBLE AS sx, (s_suppkey * 91 % 1000)::DOUBLE AS sy FROM supplier), "
    "n AS (SELECT id, sid, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS d FROM c, s), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, sid) AS rn FROM n WHERE d <= 40) "
    "SELECT id AS left_id, sid AS right_id, floor(d * 1e6 + 0.5)::BIGINT AS d_um FROM k WHERE rn = 1"
)
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.nearest_within(_points(spark, sf_dir, "customer", "c_custkey"), _points(spark, sf_dir, "supplier", "s_suppkey"), 40.0)
    return found.select("left_id", "right_id", units(F.col("d"), 1e6).alias("d_um"))


@query(
    f"WITH t AS ({_POINTS}), ch AS (SELECT 'C' || n_nationkey AS site, (n_nationkey * 211 % 1000)::DOUBLE AS x, (n_nationkey * 383 % 1000)::DOUBLE AS y, n_nationkey % 6 AS degree FROM nation), "
    "sg AS (SELECT 'S' || n_nationkey AS site, (n_nationkey * 211 % 1000)::DOUBLE AS x0, (n_nationkey * 383 % 1000)::DOUBLE AS y0, (n_nationkey * 211 % 1000 + 90)::DOUBLE AS x1, (n_nationkey * 383 % 1000 + 40)::DOUBLE AS y1 FROM nation), "
    "f AS (SELECT id, site, x, y, x0, y0, x1, y1, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS pos, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM t, sg), "
    "h AS (SELECT *, x0 + pos * (x1 - x0) AS fx, y0 + pos * (y1 - y0) AS fy FROM f), "
    "l AS (SELECT *, sqrt(pow(fx - x, 2) + pow(fy - y, 2)) AS leg FROM h), "
    "o AS (SELECT id, site, NULL::DOUBLE AS pos, d AS leg FROM (SELECT id, site, sqrt(pow(t.x - ch.x, 2) + pow(t.y - ch.y, 2)) AS d FROM t, ch WHERE degree < 4) WHERE d <= 60 "
    "UNION ALL SELECT id, site, pos, leg FROM l WHERE leg <= 60 AND pos BETWEEN 1e-3 AND 1 - 1e-3 AND pos * len >= 0.5 AND (1 - pos) * len >= 0.5 AND NOT EXISTS (SELECT 1 FROM ch WHERE degree < 4 AND sqrt(pow(ch.x - fx, 2) + pow(ch.y - fy, 2)) <= 10)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY leg, site) AS rank FROM o) SELECT id, site, floor(leg * 1e6 + 0.5)::BIGINT AS leg_um, floor(pos * 1e6 + 0.5)::BIGINT AS at_ppm, rank::INTEGER AS rank FROM k WHERE rank <= 6"
)
def tie_in_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 211 % 1000).cast("double").alias("x"), (F.col("n_nationkey") * 383 % 1000).cast("double").alias("y"))
    chambers = nation.select(F.concat(F.lit("C"), "k").alias("site"), "x", "y", (F.col("k") % 6).alias("degree"))
    segments = nation.select(F.concat(F.lit("S"), "k").alias("site"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 90).alias("x1"), (F.col("y") + 40).alias("y1"))
    found = spatial.ranked_options(spatial.tie_in_options(_points(spark, sf_dir, "customer", "c_custkey"), chambers, segments, 60.0), 6)
    return found.select("id", "site", units(F.col("leg"), 1e6).alias("leg_um"), units(F.col("at"), 1e6).alias("at_ppm"), "rank")


_SPANS = "SELECT user_id, (event_id % 997)::DOUBLE AS s0, (event_id % 997 + 5 + event_id % 13)::DOUBLE AS s1, [1.05, 1.6, 1.75][(event_id % 3 + 1)::INTEGER]::DOUBLE AS k, event_id % 5 AS zone FROM events"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s0 = F.col("event_id"), (F.col("event_id") % 997).cast("double")
    factor = F.array(F.lit(1.05), F.lit(1.6), F.lit(1.75))[(e % 3).cast("int")]
    return table(spark, sf_dir, "events").select("user_id", s0.alias("s0"), (s0 + 5 + e % 13).alias("s1"), factor.alias("k"), (e % 5).alias("zone"))


@query(
    f"WITH sp AS ({_SPANS}), cuts AS (SELECT DISTINCT user_id, unnest([s0, s1]) AS pos FROM sp), pc AS (SELECT user_id, pos, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS to_ FROM cuts), "
    "cv AS (SELECT p.user_id, p.pos, p.to_, max(k) AS k, list_sort(list_distinct(list(zone))) AS zones FROM pc p JOIN sp ON sp.user_id = p.user_id AND s0 <= (pos + to_) / 2 AND (pos + to_) / 2 <= s1 GROUP BY ALL), "
    "fl AS (SELECT *, CASE WHEN lag(to_) OVER w = pos AND lag(k) OVER w = k AND lag(zones) OVER w = zones THEN 0 ELSE 1 END AS brk FROM cv WINDOW w AS (PARTITION BY user_id ORDER BY pos)), "
    "rn AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM fl) SELECT user_id, min(pos) AS start, max(to_) AS \"end\", max(k) AS k FROM rn GROUP BY user_id, run"
)
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_spans(_spans(spark, sf_dir), "user_id")


@query(
    f"WITH sp AS ({_SPANS}), fl AS (SELECT *, CASE WHEN s0 <= max(s1) OVER (PARTITION BY user_id ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.05 THEN 0 ELSE 1 END AS brk FROM sp), "
    "rn AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM fl) SELECT user_id, min(s0) AS start, max(s1) AS \"end\", count(*) AS n FROM rn GROUP BY user_id, run"
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_intervals(_spans(spark, sf_dir), "user_id")


_TREE = "SELECT c_custkey AS node, CASE WHEN c_custkey >= 5 THEN c_custkey // 3 END AS parent, (c_custkey % 50 + 1)::BIGINT AS length, (c_custkey % 40 / 10.0)::DOUBLE AS flow, [50, 80, 100, 200][(c_custkey % 4 + 1)::INTEGER] AS dn FROM customer"
_CLOSURE = f"WITH RECURSIVE tree AS ({_TREE}), up(node, ancestor, hops, metres) AS (SELECT node, node, 0, 0::BIGINT FROM tree UNION ALL SELECT up.node, t.parent, hops + 1, metres + t.length FROM up JOIN tree t ON t.node = up.ancestor WHERE t.parent IS NOT NULL) "


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("node"), F.when(k >= 5, F.floor(k / 3)).alias("parent"), (k % 50 + 1).alias("length"), (k % 40 / 10.0).alias("flow"), F.array(F.lit(50), F.lit(80), F.lit(100), F.lit(200))[(k % 4).cast("int")].alias("dn")
    )


@query(_CLOSURE + "SELECT up.node, ancestor AS source, hops, metres::DOUBLE AS metres FROM up JOIN tree t ON t.node = ancestor WHERE t.parent IS NULL")
def upstream_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's source and the way there."""
    return network.to_source(_tree(spark, sf_dir))


@query(_CLOSURE + "SELECT ancestor AS node, sum(floor(t.flow * 10 + 0.5)::BIGINT)::BIGINT AS total_flow, count(*) AS nodes, max(t.dn)::INTEGER AS dn FROM up JOIN tree t ON t.node = up.node GROUP BY ancestor")
def tree_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows (tenths) and diameters gathered over subtrees."""
    tree = _tree(spark, sf_dir).select("node", "parent", "length", "dn", units(F.col("flow"), 10).alias("total_flow"), F.lit(1).cast("long").alias("nodes"))
    return network.gathered(tree, {"total_flow": "sum", "nodes": "sum", "dn": "max"})


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, metres) between customers, and every 97th as a source."""
    k, customers = F.col("c_custkey"), table(spark, sf_dir, "customer")
    halves = customers.where("c_custkey > 0").select(k.alias("a"), F.floor(k / 2).alias("b"), (k % 30 + 1).cast("double").alias("metres"))
    sevens = customers.where("c_custkey >= 7").select(k.alias("a"), (k - 7).alias("b"), (k % 11 + 3).cast("double").alias("metres"))
    return halves.unionByName(sevens), customers.where("c_custkey % 97 = 0").select(k.alias("node"))


@query(
    "WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 2 AS b, (c_custkey % 30 + 1)::DOUBLE AS m FROM customer WHERE c_custkey > 0 UNION ALL SELECT c_custkey, c_custkey - 7, (c_custkey % 11 + 3)::DOUBLE FROM customer WHERE c_custkey >= 7), "
    "b AS (SELECT a, b, m FROM e UNION ALL SELECT b, a, m FROM e), "
    "w(node, metres, source, hop) AS (SELECT c_custkey, 0::DOUBLE, c_custkey, 0 FROM customer WHERE c_custkey % 97 = 0 UNION SELECT b.b, w.metres + b.m, w.source, hop + 1 FROM w JOIN b ON b.a = w.node WHERE hop < 5) "
    "SELECT node, metres, source FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY metres, source) AS rn FROM w) WHERE rn = 1"
)
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of many sources along at most five edges."""
    edges, sources = _graph(spark, sf_dir)
    return network.shortest_paths(edges, sources, 5).select("node", "metres", "source")


@query(None)
def nearest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of many sources along any number of edges; without SQL, which would list all walks."""
    return network.shortest_paths(*_graph(spark, sf_dir)).select("node", "metres", "source")


_PLANS = "SELECT o_custkey % 400 AS run, ['mincost', 'mintaps', 'minrecon', 'finale'][(o_orderkey % 4 + 1)::INTEGER] AS code, floor(min(o_totalprice) * 1000) AS cost, (count(*) % 4)::BIGINT AS taps, floor(max(o_totalprice) / 100) AS length, (max(o_orderkey) % 3)::BIGINT AS unconnected FROM orders GROUP BY ALL"


@query(
    f"WITH p AS ({_PLANS}), m AS (SELECT * FROM p WHERE code <> 'finale'), u AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM m o WHERE p.code <> 'finale' AND o.run = p.run AND o.code <> p.code "
    "AND o.cost <= p.cost + 1 AND o.taps <= p.taps AND o.length <= p.length + 1 AND o.unconnected <= p.unconnected AND (o.cost + 1000 < p.cost OR o.taps < p.taps OR o.unconnected < p.unconnected))), "
    "s AS (SELECT *, 0.7::DOUBLE * cost / 25000000 + 0.3::DOUBLE * length / 100 AS score FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score, cost, code) AS rank FROM s) "
    "SELECT run, code, cost::DOUBLE AS cost, taps, floor(score * 1000 + 0.5) / 1000 AS score, rank::INTEGER AS rank FROM k WHERE rank <= 3"
)
def plan_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that no other makes pointless, the three best of each run."""
    code = F.array(*[F.lit(c) for c in ("mincost", "mintaps", "minrecon", "finale")])[(F.col("o_orderkey") % 4).cast("int")]
    plans = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 400).alias("run"), code.alias("code")).agg(
        F.floor(F.min("o_totalprice") * 1000).cast("double").alias("cost"), (F.count("*") % 4).alias("taps"), F.floor(F.max("o_totalprice") / 100).cast("double").alias("length"), (F.max("o_orderkey") % 3).alias("unconnected")
    )
    best = costing.ranked(costing.undominated(plans, "run"), "run")
    return best.select("run", "code", "cost", "taps", r.rounded(F.col("score"), 3).alias("score"), "rank")


_PLAN_COST = (
    f"WITH {_DN}, sg AS (SELECT l_orderkey % 500 AS plan, 'N' || l_partkey % 40 AS f, 'N' || l_suppkey % 40 AS t, floor(l_extendedprice / 100) AS len, [50, 100, 200, 400][(l_linenumber % 4 + 1)::INTEGER] AS dn, [0.0, 1.6, 1.25][(l_linenumber % 3 + 1)::INTEGER]::DOUBLE AS k FROM lineitem), "
    "pr AS (SELECT sg.*, len * d.price * CASE WHEN k > 0 THEN k ELSE 1 END AS cost FROM sg JOIN dims d USING (dn)), pi AS (SELECT plan, sum(floor(cost * 100 + 0.5)::BIGINT)::BIGINT AS pipes, sum(len)::BIGINT AS length FROM pr GROUP BY plan), "
    "en AS (SELECT plan, id, max(dn) AS dn FROM (SELECT plan, f AS id, dn FROM sg UNION ALL SELECT plan, t, dn FROM sg) GROUP BY ALL), "
    "ch AS (SELECT DISTINCT o_orderkey % 500 AS plan, 'N' || o_custkey % 40 AS id FROM orders), "
    f"cc AS (SELECT plan, sum({_TIER_OF.format(dn='coalesce(en.dn, 50)')})::BIGINT AS chambers FROM ch LEFT JOIN en USING (plan, id) GROUP BY plan), "
    "un AS (SELECT o_orderkey % 500 AS plan, (count(*) * 100000000 + 500000 * sum(o_custkey % 7))::BIGINT AS penalty, count(*) AS unconnected FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL), "
    "ti AS (SELECT o_orderkey % 500 AS plan, (count(*) * 5000000)::BIGINT AS tie_ins FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) "
    "SELECT plan, coalesce(pipes, 0) AS pipes_cents, coalesce(length, 0) AS length, coalesce(chambers, 0) AS chambers, coalesce(tie_ins, 0) AS tie_ins, coalesce(penalty, 0) AS penalty, coalesce(unconnected, 0) AS unconnected, "
    "(coalesce(pipes, 0) + 100 * (coalesce(chambers, 0) + coalesce(tie_ins, 0) + coalesce(penalty, 0)))::BIGINT AS total_cents "
    "FROM pi FULL JOIN cc USING (plan) FULL JOIN ti USING (plan) FULL JOIN un USING (plan)"
)


@query(_PLAN_COST)
def plan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes, chambers, tie-ins and penalties of plans, in roubles."""
    whole = lambda c: F.floor(c).cast("long").alias(c)
    return _costs(spark, sf_dir).select("plan", units(F.col("pipes"), 100).alias("pipes_cents"), *[whole(c) for c in ("length", "chambers", "tie_ins", "penalty", "unconnected")], units(F.col("total"), 100).alias("total_cents"))


@query(
    f"WITH c AS ({_PLAN_COST}), i AS (SELECT plan, unnest([{{'item': 'pipe_cost', 'c': pipes_cents}}, {{'item': 'construction_cost', 'c': pipes_cents + 100 * (chambers + tie_ins)}}, {{'item': 'chamber_construction_cost', 'c': 100 * chambers}}, {{'item': 'existing_chamber_tie_in_cost', 'c': 100 * tie_ins}}, {{'item': 'existing_chamber_tie_in_count', 'c': 100 * (tie_ins // 5000000)}}, {{'item': 'tie_in_cost', 'c': 100 * tie_ins}}, {{'item': 'reconstruction_cost', 'c': 0}}, {{'item': 'chamber_reconstruction_cost', 'c': 0}}, {{'item': 'unconnected_penalty', 'c': 100 * penalty}}, {{'item': 'calculated_cost', 'c': total_cents}}]) AS x FROM c) "
    "SELECT plan, x.item AS item, x.c::BIGINT AS hundredths FROM i"
)
def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each plan's cost by name."""
    parts = costing.breakdown(_costs(spark, sf_dir)).select("plan", F.explode("breakdown").alias("item", "value"))
    return parts.select("plan", "item", units(F.col("value"), 100).alias("hundredths"))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    plan = (F.col("o_orderkey") % 500).alias("plan")
    node = lambda c: F.concat(F.lit("N"), F.col(c) % 40)
    segments = line.select(
        (F.col("l_orderkey") % 500).alias("plan"), node("l_partkey").alias("from_id"), node("l_suppkey").alias("to_id"), F.floor(F.col("l_extendedprice") / 100).cast("double").alias("length"),
        F.array(*map(F.lit, (50, 100, 200, 400)))[F.col("l_linenumber") % 4].alias("dn"), F.array(*map(F.lit, (0.0, 1.6, 1.25)))[F.col("l_linenumber") % 3].alias("k_spec"),
        F.lit(None).cast("double").alias("depth_from"), F.lit(None).cast("double").alias("depth_to"),
    )
    chambers = orders.select(plan, node("o_custkey").alias("id")).distinct().withColumn("dn", F.lit(None).cast("int"))
    tied, left = orders.where("o_orderstatus = 'F'").select(plan), orders.where("o_orderstatus = 'P'").select(plan, (F.col("o_custkey") % 7).cast("double").alias("flow"))
    return costing.roll_up(segments, chambers, tied, left, "plan")


@query(
    "WITH b AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY 1 + (l_partkey % 20) / 10.0::DOUBLE, 3 + (l_suppkey % 20) / 10.0::DOUBLE) - 1 AS i, 1 + (l_partkey % 20) / 10.0::DOUBLE AS above, 3 + (l_suppkey % 20) / 10.0::DOUBLE AS below FROM lineitem), "
    "n AS (SELECT id, count(*) AS n, greatest(0.7::DOUBLE, max(below)) AS deepest FROM b GROUP BY id), m AS (SELECT id, deepest, unnest(range(0, (1 << n)::BIGINT)) AS mask FROM n), "
    "w AS (SELECT m.id, m.mask, m.deepest, greatest(0.7::DOUBLE, max(CASE WHEN (mask >> i) & 1 = 1 THEN below END)) AS low, coalesce(min(CASE WHEN (mask >> i) & 1 = 0 THEN above END), 1e12) AS high FROM m JOIN b ON b.id = m.id GROUP BY ALL), "
    "d AS (SELECT *, greatest(low, least(high, 3.0::DOUBLE)) AS depth FROM w), "
    f"c AS (SELECT id, depth, row_number() OVER (PARTITION BY id ORDER BY floor({_FACTOR.format(h='depth')} * 1e9 + 0.5), floor(abs(depth - 3) * 1e9 + 0.5), mask) AS rn FROM d WHERE low <= high + 1e-9) "
    "SELECT n.id, floor(coalesce(c.depth, n.deepest) * 1e6 + 0.5)::BIGINT AS depth_um FROM n LEFT JOIN c ON c.id = n.id AND rn = 1"
)
def depth_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's line items as utilities to pass above or below."""
    bands = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (1 + (F.col("l_partkey") % 20) / 10.0).alias("above_max"), (3 + (F.col("l_suppkey") % 20) / 10.0).alias("below_min"))
    return depth.choose_depth(bands, "id").select("id", units(F.col("depth"), 1e6).alias("depth_um"))


@query(
    "WITH st AS (SELECT c_nationkey AS k, (c_custkey % 200)::DOUBLE AS s FROM customer GROUP BY ALL), pn AS (SELECT s_nationkey AS k, (s_suppkey * 13 % 200)::DOUBLE AS pos, 1 + (s_suppkey % 4)::DOUBLE AS low, 2 + (s_suppkey % 5)::DOUBLE AS high FROM supplier) "
    "SELECT st.k AS nation, st.s, floor(greatest(coalesce(max(low - 0.1::DOUBLE * abs(s - pos)), 3), least(coalesce(min(high + 0.1::DOUBLE * abs(s - pos)), 3), 3)) * 1e6 + 0.5)::BIGINT AS depth_um FROM st LEFT JOIN pn ON pn.k = st.k GROUP BY st.k, st.s"
)
def depth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 200).cast("double").alias("s")).distinct()
    k = F.col("s_suppkey")
    pins = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (k * 13 % 200).cast("double").alias("at"), (1 + k % 4).cast("double").alias("low"), (2 + k % 5).cast("double").alias("high"))
    return depth.profile(stations, pins, "nation").select("nation", "s", units(F.col("depth"), 1e6).alias("depth_um"))


@query(
    "SELECT p_partkey, CASE WHEN regexp_full_match(i, '-?[0-9]{1,18}') THEN i ELSE '\"' || i || '\"' END AS id, floor(p_retailprice * 1.005 * 100 + 0.5) / 100 AS cost, floor(p_retailprice / 7 * 10000 + 0.5) / 10000 AS depth_start "
    "FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN '2-NS-' || p_partkey ELSE p_brand END AS i FROM part)"
)
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and rounding of exported features."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, geojson.own_id(F.lit(2), F.concat(F.lit("NS-"), k), F.lit(True))).otherwise(F.col("p_brand"))
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", geojson.json_id(text).alias("id"), r.rounded(price * 1.005, 2).alias("cost"), r.rounded(price / 7, 4).alias("depth_start"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def feature_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is the feature here, hence the limit."""
    return geojson.page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 100, 50)


@query(
    "WITH t AS (SELECT lower(trim([" + ", ".join(f"'{t}'" for t in _KIND_TEXTS) + f"][(p_partkey % {len(_KIND_TEXTS)} + 1)::INTEGER])) AS k, "
    "lower([" + ", ".join(f"'{t}'" for t in _SHAPES) + "][(p_size % 5 + 1)::INTEGER]) AS s, CASE WHEN p_partkey % 2 = 0 THEN 1.0 END AS flow, CASE WHEN p_partkey % 3 = 0 THEN 'a' END AS nx, CASE WHEN p_partkey % 7 < 3 THEN 'b' END AS oks, "
    "(p_partkey * 37 % 1000)::DOUBLE AS x, (p_partkey * 91 % 1000)::DOUBLE AS y, p_size AS w FROM part), "
    "q AS (SELECT *, CASE " + " ".join(f"WHEN k = '{k}' THEN '{v}'" for k, v in r.KIND_TOKENS.items())
    + " WHEN contains(s, 'line') AND nx IS NOT NULL THEN 'EXISTING_SEGMENT' WHEN s IN ('point', 'multipoint') AND oks IS NOT NULL THEN 'CONNECTION_POINT' WHEN contains(s, 'polygon') AND flow IS NOT NULL THEN 'OKS_PROSPECTIVE' "
    "WHEN contains(k, 'камер') OR contains(k, 'chamber') THEN 'CHAMBER' WHEN contains(k, 'источ') OR contains(k, 'source') OR contains(k, 'тэц') THEN 'SOURCE' "
    "WHEN contains(s, 'polygon') OR " + " OR ".join(f"contains(k, '{c}')" for c in r.CONSTRAINT_TEXTS) + " THEN 'CONSTRAINT' ELSE 'UNKNOWN' END AS kind FROM t) "
    "SELECT kind, count(*) AS n, min(x) AS min_x, min(y) AS min_y, max(x + w) AS max_x, max(y + w) AS max_y FROM q GROUP BY kind "
    "UNION ALL SELECT 'ALL', count(*), min(x), min(y), max(x + w), max(y + w) FROM q"
)
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by kind, unknown ones among them, with the boxes of each kind and of all."""
    key = F.col("p_partkey")
    text = F.array(*[F.lit(t) for t in _KIND_TEXTS])[(key % len(_KIND_TEXTS)).cast("int")]
    shape = F.array(*[F.lit(t) for t in _SHAPES])[F.col("p_size") % 5]
    kind = r.feature_kind(text, shape, F.when(key % 2 == 0, 1.0), F.when(key % 3 == 0, "a"), F.when(key % 7 < 3, "b"))
    x, y = (key * 37 % 1000).cast("double"), (key * 91 % 1000).cast("double")
    features = table(spark, sf_dir, "part").select(kind.alias("kind"), x.alias("min_x"), y.alias("min_y"), (x + F.col("p_size")).alias("max_x"), (y + F.col("p_size")).alias("max_y"))
    return geojson.ingest_stats(features)


@query(None)
def route_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers joined to nations' places past square obstacles: pipes with flow, diameter and cost."""
    at = lambda k, a, b: ((k * a % 1000).cast("double").alias("x"), (k * b % 1000).cast("double").alias("y"))
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    roots = nation.select((F.col("n_nationkey") + 1).cast("long").alias("id"), *at(F.col("n_nationkey"), 211, 383))
    consumers = supplier.select((F.col("s_suppkey") + 1_000).alias("id"), *at(F.col("s_suppkey"), 37, 91))
    mx, my = (F.col("n_nationkey") * 457 % 1000).cast("double"), (F.col("n_nationkey") * 619 % 1000).cast("double")
    corner = lambda dx, dy: F.struct((mx + dx).alias("x"), (my + dy).alias("y"))
    blocks = nation.select(F.col("n_nationkey").alias("polygon"), F.array(corner(0, 0), corner(30, 0), corner(30, 30), corner(0, 30), corner(0, 0)).alias("ring"))
    shell = routes.corners(blocks, 2.0)
    corner_id = F.lit(1 << 40) + F.pmod(F.xxhash64("x", "y"), F.lit(1 << 40))
    points = roots.unionByName(consumers).unionByName(shell.select(corner_id.alias("id"), "x", "y").distinct())
    tree = routes.steiner_forest(routes.legs(points, blocks, 120.0), consumers.select(F.col("id").alias("node")), roots.select(F.col("id").alias("node")))
    demand = supplier.select((F.col("s_suppkey") + 1_000).alias("node"), (F.col("s_suppkey") % 40 / 2.0).alias("flow"))
    return routes.sized(tree, demand)
