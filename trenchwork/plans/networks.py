"""Queries over existing networks: what must be replaced, virtual nodes, kept features and results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as r
from ..operators import network, reconstruction, topology
from ..sources import partitions
from ..store import new_path
from .catalogue import _DN, _PRICE_OF, _TIER_OF, query, table, units
from .scenes import _PIPES

_ELEMENTS = "SELECT c_custkey AS element, CASE WHEN c_custkey >= 5 THEN c_custkey // 3 END AS next, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 50 + 20)::DOUBLE END AS length, (c_custkey % 40 / 10.0)::DOUBLE AS flow, [50, 80, 100, 200][(c_custkey % 4 + 1)::INTEGER] AS dn FROM customer"
_TAPS = "SELECT o_custkey AS element, CASE WHEN o_custkey % 4 > 0 THEN (o_orderkey % 60)::DOUBLE END AS pos, (o_orderkey % 9 / 2.0)::DOUBLE AS flow FROM orders WHERE o_orderkey % 5 = 0"
_PRICES = "price(pdn, per_m) AS (VALUES " + ", ".join(f"({d}, {p}::DOUBLE)" for d, p in r.REPLACEMENT) + ")"


def _network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    dn = F.array(*map(F.lit, (50, 80, 100, 200)))[(k % 4).cast("int")]
    elements = table(spark, sf_dir, "customer").select(k.alias("element"), F.when(k >= 5, F.floor(k / 3)).alias("next"), F.when(k % 4 > 0, (k % 50 + 20).cast("double")).alias("length"), (k % 40 / 10.0).alias("flow"), dn.alias("dn"))
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    return elements, orders.select(F.col("o_custkey").alias("element"), F.when(F.col("o_custkey") % 4 > 0, (o % 60).cast("double")).alias("at"), (o % 9 / 2.0).alias("flow"))


@query(
    f"WITH RECURSIVE {_DN}, {_PRICES}, e AS ({_ELEMENTS}), t AS ({_TAPS}), up(element, ancestor) AS (SELECT element, next FROM e WHERE next IS NOT NULL UNION ALL SELECT up.element, e.next FROM up JOIN e ON e.element = up.ancestor WHERE e.next IS NOT NULL), "
    "th AS (SELECT ancestor AS element, sum(t.flow) AS through FROM up JOIN t ON t.element = up.element GROUP BY ancestor), "
    "p AS (SELECT t.element, least(pos, length) AS pos, t.flow FROM t JOIN e ON e.element = t.element WHERE length IS NOT NULL), "
    "c AS (SELECT DISTINCT element, pos FROM p WHERE pos > 0 UNION SELECT element, length FROM e WHERE length IS NOT NULL), "
    "s AS (SELECT element, coalesce(lag(pos) OVER (PARTITION BY element ORDER BY pos), 0) AS s0, pos AS s1 FROM c), "
    "f AS (SELECT s.element, s0, s1, coalesce(through, 0) + coalesce((SELECT sum(p.flow) FROM p WHERE p.element = s.element AND p.pos >= s1), 0) AS added FROM s LEFT JOIN th ON th.element = s.element), "
    f"q AS (SELECT f.*, e.dn, coalesce((SELECT min(d.dn) FROM dims d WHERE e.flow + added <= cap + 1e-9), 1400) AS required FROM f JOIN e ON e.element = f.element WHERE added > 0 OR f.element IN (SELECT element FROM t)) "
    "SELECT element, s0, s1, floor(added * 10 + 0.5)::BIGINT AS added_10, required::INTEGER AS required, floor((s1 - s0) * per_m + 0.5)::BIGINT AS cost FROM q JOIN price ON pdn = required WHERE required > dn"
)
def replaced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an existing network that new taps make too narrow. In the SQL, every tap is added to every element on its way."""
    parts = reconstruction.replaced(*_network(spark, sf_dir))
    return parts.select("element", "s0", "s1", units(F.col("added"), 10).alias("added_10"), F.col("required").cast("int").alias("required"), units(F.col("cost"), 1).alias("cost"))


@query(
    f"WITH RECURSIVE p AS ({_PIPES.replace('c_custkey', 's_suppkey').replace('FROM customer', 'FROM supplier').replace('% 1000', '% 60')}), n AS (SELECT n_nationkey AS place, (n_nationkey * 211 % 60)::DOUBLE AS x, (n_nationkey * 383 % 60)::DOUBLE AS y FROM nation), "
    "e AS (SELECT id * 2 AS ord, x0 AS x, y0 AS y FROM p UNION ALL SELECT id * 2 + 1, x1, y1 FROM p), o AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM e), "
    "w(rn, made) AS (SELECT 0, []::STRUCT(o BIGINT, x DOUBLE, y DOUBLE)[] UNION ALL SELECT o.rn, CASE WHEN len(list_filter(made, lambda m: sqrt(pow(m.x - o.x, 2) + pow(m.y - o.y, 2)) <= 4)) > 0 OR EXISTS (SELECT 1 FROM n WHERE sqrt(pow(n.x - o.x, 2) + pow(n.y - o.y, 2)) <= 4) THEN made ELSE list_append(made, {'o': o.ord, 'x': o.x, 'y': o.y}) END FROM w JOIN o ON o.rn = w.rn + 1), "
    "v AS (SELECT m.o AS ord, m.x AS x, m.y AS y FROM (SELECT unnest(made) AS m FROM w WHERE rn = (SELECT max(rn) FROM w))), "
    "c AS (SELECT e.ord, sqrt(pow(n.x - e.x, 2) + pow(n.y - e.y, 2)) AS d, 0 AS kind, place FROM e, n UNION ALL SELECT e.ord, sqrt(pow(v.x - e.x, 2) + pow(v.y - e.y, 2)), 1, v.ord FROM e, v WHERE v.ord <= e.ord) "
    "SELECT DISTINCT ON (ord) ord, CASE WHEN kind = 0 THEN place END AS node, CASE WHEN kind = 1 THEN place END AS virtual, floor(d * 1000 + 0.5)::BIGINT AS metres_mm FROM c WHERE d <= 4 ORDER BY ord, d, kind DESC, place DESC"
)
def virtual_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that ends of pipes belong to. In the SQL, ends are taken one after the other."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    at = lambda c, step, more=0: (c * step % 60 + more).cast("double")
    pipes = table(spark, sf_dir, "supplier")
    ends = pipes.select((k * 2).alias("ord"), at(k, 37).alias("x"), at(k, 91).alias("y")).unionByName(pipes.select((k * 2 + 1).alias("ord"), at(k, 37, k % 37).alias("x"), at(k, 91, k % 23).alias("y")))
    nodes = table(spark, sf_dir, "nation").select(n.cast("long").alias("node"), n.cast("long").alias("place"), at(n, 211).alias("x"), at(n, 383).alias("y"))
    return topology.virtual_nodes(nodes, ends).select("ord", "node", "virtual", units(F.col("metres"), 1000).alias("metres_mm"))


@query("SELECT dataset, kind, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'one' ELSE 'two' END AS dataset, CASE WHEN p_size % 4 > 0 THEN ['CHAMBER', 'SOURCE', 'CONSTRAINT'][(p_size % 4)::INTEGER] ELSE 'UNKNOWN' END AS kind, p_size FROM part) WHERE dataset = 'two' AND kind IN ('SOURCE', 'UNKNOWN') GROUP BY dataset, kind")
def kept_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features kept by dataset and kind, and some of them read again."""
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    features = part.select("p_partkey", "p_size", F.when(size % 4 > 0, F.array(*map(F.lit, ("CHAMBER", "SOURCE", "CONSTRAINT")))[(size % 4 - 1).cast("int")]).alias("kind"))
    at = new_path(spark, "kept-features")
    for name, rest in (("one", 0), ("two", 1)):
        partitions.save_features(features.where(F.col("p_partkey") % 2 == rest), at, name)
    return partitions.load_features(spark, at, "two", "SOURCE", "UNKNOWN").groupBy("dataset", "kind").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


#: Plans whose nodes are the customers of a nation, at most nine deep, and 40 roots that are there already.
_PLANS = (
    "w AS (SELECT c_nationkey AS plan, c_custkey AS node, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_acctbal FROM customer), "
    "tr AS (SELECT a.plan, a.node, b.node AS parent, (a.node % 40 + 1)::DOUBLE AS length, (a.node % 9 / 2.0)::DOUBLE AS flow, a.node % 2 = 0 AS chamber FROM w a LEFT JOIN w b ON b.plan = a.plan AND b.i = a.i // 2 AND a.i > 3)"
)


@query(
    f"WITH RECURSIVE {_DN}, {_PLANS}, up(plan, node, ancestor) AS (SELECT plan, node, node FROM tr UNION ALL SELECT up.plan, up.node, tr.parent FROM up JOIN tr ON tr.plan = up.plan AND tr.node = up.ancestor WHERE tr.parent IS NOT NULL), "
    "f AS (SELECT up.plan, up.ancestor AS node, sum(tr.flow) AS flow FROM up JOIN tr ON tr.plan = up.plan AND tr.node = up.node GROUP BY ALL), "
    "p AS (SELECT tr.plan, tr.node, parent, length, coalesce((SELECT min(d.dn) FROM dims d WHERE f.flow <= cap + 1e-9), 1400) AS dn FROM tr JOIN f ON f.plan = tr.plan AND f.node = tr.node WHERE parent IS NOT NULL), "
    f"c AS (SELECT plan, floor(length * {_PRICE_OF.format(dn='p.dn')} * 100 + 0.5)::BIGINT AS cost, length FROM p), "
    "s AS (SELECT plan, sum(cost) AS pipes, sum(length) AS length FROM c GROUP BY plan), "
    "r AS (SELECT plan, node, chamber FROM tr WHERE parent IS NULL), "
    f"m AS (SELECT plan, sum({_TIER_OF.format(dn='dn')}) AS built FROM (SELECT p.plan, p.parent, max(dn) AS dn FROM p JOIN tr ON tr.plan = p.plan AND tr.node = p.parent AND tr.parent IS NOT NULL GROUP BY p.plan, p.parent HAVING count(*) > 1) GROUP BY plan), "
    "x AS (SELECT p.plan, count(*) * 5e6 AS tied FROM p JOIN r ON r.plan = p.plan AND r.node = p.parent AND r.chamber GROUP BY p.plan), "
    "l AS (SELECT s_nationkey AS plan, sum(100e6 + 5e5 * (s_suppkey % 7)) AS penalty FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY ALL), "
    "v AS (SELECT plan, sum(pipes) AS pipes, sum(chambers) AS chambers, sum(penalty) AS penalty, sum(length) AS length FROM (SELECT DISTINCT plan, 0 AS pipes, 0 AS chambers, 0 AS penalty, 0 AS length FROM tr UNION ALL SELECT plan, pipes, 0, 0, length FROM s UNION ALL SELECT plan, 0, built, 0, 0 FROM m UNION ALL SELECT plan, 0, tied, 0, 0 FROM x UNION ALL SELECT plan, 0, 0, penalty, 0 FROM l) GROUP BY plan) "
    "SELECT plan, pipes::BIGINT AS pipes, chambers::BIGINT AS chambers, penalty::BIGINT AS penalty, length::BIGINT AS length FROM v WHERE plan IN (SELECT plan FROM tr)"
)
def plans_priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many plans sized and priced in one job."""
    node = F.col("c_custkey")
    numbered = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("plan"), node.alias("node"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("i"))
    above = numbered.select("plan", F.col("i").alias("_i"), F.col("node").alias("parent"))
    n = F.col("node")
    trees = numbered.withColumn("_i", F.when(F.col("i") > 3, F.floor(F.col("i") / 2))).join(above, ["plan", "_i"], "left")
    trees = trees.select("plan", "node", "parent", (n % 40 + 1).cast("double").alias("length"), (n % 9 / 2.0).alias("flow"), F.when(n % 2 == 0, "chamber").alias("root_kind"))
    left = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("plan"), (F.col("s_suppkey") % 7).cast("double").alias("flow"))
    priced = network.plans_priced(trees, left, limited=False)
    return priced.select("plan", units(F.col("pipes"), 100).alias("pipes"), *[units(F.col(c), 1).alias(c) for c in ("chambers", "penalty", "length")])


_ROADS = "SELECT c_custkey AS a, c_custkey + 1 AS b, (c_custkey % 9 + 1)::DOUBLE AS metres FROM customer WHERE c_custkey % 10 < 7 UNION ALL SELECT c_custkey - 2, c_custkey + 10, 5::DOUBLE FROM customer WHERE c_custkey % 30 = 5"


@query(
    f"WITH RECURSIVE e AS (SELECT *, row_number() OVER (ORDER BY a, b) AS id FROM ({_ROADS})), arc AS (SELECT id, a AS u, b AS v, metres FROM e UNION ALL SELECT id, b, a, metres FROM e), "
    "deg AS (SELECT u AS node, count(*) AS n FROM arc GROUP BY u), inn AS (SELECT node FROM deg WHERE n = 2 AND node % 50 <> 2), "
    "w(start, tip, last, metres, path) AS (SELECT u, v, id, metres, u || '-' || v FROM arc WHERE u NOT IN (SELECT node FROM inn) UNION ALL SELECT start, v, id, w.metres + arc.metres, path || '-' || v FROM w JOIN arc ON arc.u = w.tip AND arc.id <> w.last WHERE w.tip IN (SELECT node FROM inn)) "
    "SELECT start AS a, tip AS b, metres, path FROM w WHERE tip NOT IN (SELECT node FROM inn) AND start < tip"
)
def contracted_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of edges put together at nodes where nothing else begins."""
    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    edges = customers.where("c_custkey % 10 < 7").select(k.alias("a"), (k + 1).alias("b"), (k % 9 + 1).cast("double").alias("metres")).unionByName(customers.where("c_custkey % 30 = 5").select((k - 2).alias("a"), (k + 10).alias("b"), F.lit(5.0).alias("metres")))
    chains = network.contracted(edges, customers.where("c_custkey % 50 = 2").select(k.alias("node")))
    turned = F.when(F.col("a") <= F.col("b"), F.col("path")).otherwise(F.reverse("path"))
    return chains.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "metres", F.array_join(turned.cast("array<string>"), "-").alias("path"))
