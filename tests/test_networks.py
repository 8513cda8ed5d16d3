"""Reconstruction, virtual nodes and kept tables against plain Python and pinned cases."""

import random

import pytest
from pyspark.sql import functions as F

from trenchwork.functions import rules as r
from trenchwork.operators import network, reconstruction, topology
from trenchwork.sources import partitions

ELEMENTS = "element string, next string, length double, flow double, dn int"
TAPS = "element string, at double, flow double, new_dn int"


def test_reconstruction_of_a_part(spark):
    elements = spark.createDataFrame([("S-1", None, 100.0, 10.0, 80)], ELEMENTS)
    taps = spark.createDataFrame([("S-1", 25.0, 200.0, 250)], TAPS)
    got = reconstruction.replaced(elements, taps).collect()
    assert [(x["s0"], x["s1"], x["added"], x["required"]) for x in got] == [(0, 25, 200, 250)] and got[0]["cost"] == 25 * 202030
    parts = reconstruction.loaded_parts(elements, taps).orderBy("s0").collect()
    assert [(x["s0"], x["s1"], x["required"]) for x in parts] == [(0, 25, 250), (25, 100, 80)]


def test_reconstruction_of_a_network(spark):
    rnd = random.Random(3)
    names = [f"e{i}" for i in range(40)]
    rows = [(n, None if i == 0 else names[rnd.randrange(max(0, i - 4), i)], None if i % 5 == 4 else float(20 + i), float(i % 4), rnd.choice([50, 80, 100])) for i, n in enumerate(names)]
    known = {x[0]: x for x in rows}
    taps = [(rnd.choice(names), float(rnd.randrange(0, 70)), rnd.choice([1.0, 4.0, 30.0]), rnd.choice([80, 150])) for _ in range(25)] + [("e3", 5.0, None, 80), ("e3", 5.0, 2.0, 80)]
    want = {}
    for n, _, length, flow, dn in rows:
        if length is None:
            continue
        through = 0.0
        for tapped, _, added, _ in taps:
            at = known[tapped][1]
            while at is not None:
                through += (added or 0.0) if at == n else 0.0
                at = known[at][1]
        own = [(min(at, length), added or 0.0) for t, at, added, _ in taps if t == n]
        cuts = sorted({0.0, length, *(at for at, _ in own)})
        if through or own:
            for s0, s1 in zip(cuts, cuts[1:]):
                total = through + sum(f for at, f in own if at >= s1)
                want[n, s0, s1] = (pytest.approx(total), next(d[0] for d in r.DIAMETERS if flow + total <= d[1] + 1e-9))
    got = {(x["element"], x["s0"], x["s1"]): (x["added"], x["required"]) for x in reconstruction.loaded_parts(spark.createDataFrame(rows, ELEMENTS), spark.createDataFrame(taps, TAPS)).collect()}
    assert got == want


def test_chambers_are_rebuilt(spark):
    elements = spark.createDataFrame([("S", None, 50.0, 0.0, 80), ("C", "S", None, None, None), ("T", "C", 30.0, 0.0, 80), ("D", "T", None, None, None)], ELEMENTS)
    taps = spark.createDataFrame([("C", None, 200.0, 80), ("D", None, 1.0, 80)], TAPS)
    chambers = spark.createDataFrame([("C", 80), ("D", 100)], "chamber string, dn int")
    beside = spark.createDataFrame([("C", "S", False), ("C", "T", True), ("D", "T", False)], "chamber string, element string, upper boolean")
    got = reconstruction.rebuilt_chambers(chambers, beside, elements, taps).collect()
    assert [(x["chamber"], x["required"], x["cost"]) for x in got] == [("C", 250, 5e6)]


@pytest.mark.parametrize("case", ["chain", "backwards", "random"])
def test_virtual_nodes(spark, case):
    rnd = random.Random(8)
    ends = {"chain": [(3.0 * i, 0.0) for i in range(20)], "backwards": [(3.0 * i, 0.0) for i in reversed(range(20))], "random": [(rnd.uniform(0, 25), rnd.uniform(0, 25)) for _ in range(60)]}[case]
    ends += [ends[3], ends[3], (4.0, 0.0)]
    nodes = [(f"n{i}", i, *at) for i, at in enumerate([(0.0, 1.0), (0.0, 1.0), (50.0, 50.0)])]
    held, want = [(x, y, (n, None)) for n, _, x, y in nodes], {}
    for i, (x, y) in enumerate(ends):
        near = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, -k) for k, (a, b, _) in enumerate(held) if ((x - a) ** 2 + (y - b) ** 2) ** 0.5 <= 4]
        if not near:
            held.append((x, y, (None, i)))
            near = [(0.0, 1 - len(held))]
        d, k = min(near)
        want[i] = (*held[-k][2], pytest.approx(d))
    got = topology.virtual_nodes(spark.createDataFrame(nodes, "node string, place long, x double, y double"), spark.createDataFrame([(i, *at) for i, at in enumerate(ends)], "ord long, x double, y double"))
    assert {x["ord"]: (x["node"], x["virtual"], x["metres"]) for x in got.collect()} == want


def test_kept_tables_are_pruned_and_replaced(spark, tmp_path):
    at = str(tmp_path / "features")
    rows = spark.range(30).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("K"), F.col("id") % 3)).alias("kind"))
    for name in ("a", "b"):
        partitions.save_features(rows, at, name)
    partitions.save_features(rows.where("id < 9"), at, "a")
    assert partitions.load_features(spark, at, "a").count() == 9 + 0 and partitions.load_features(spark, at, "b").count() == 30
    one = partitions.load_features(spark, at, "b", "K1", partitions.NONE)
    assert sorted(x["id"] for x in one.collect()) == [i for i in range(30) if i % 3 != 2]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "kind" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    result = spark.createDataFrame([(1, "heat_network", 5.0, 2.0), (1, "heat_network", 6.0, 3.0), (2, "heat_chamber", None, 9.0)], "rank int, object_type string, length double, cost double")
    partitions.save_result(result, str(tmp_path / "results"), "job-1")
    assert partitions.load_result(spark, str(tmp_path / "results"), "job-1", 2).count() == 1
    assert {tuple(x) for x in partitions.previews(spark, str(tmp_path / "results"), "job-1").collect()} == {(1, "heat_network", 2, 11.0, 5.0), (2, "heat_chamber", 1, None, 9.0)}


@pytest.mark.parametrize(
    ("edges", "kept", "want"),
    [
        ([(1, 2), (2, 3), (3, 4)], [], {(1, 2, 3, 4)}),
        ([(1, 2), (3, 2), (3, 4), (3, 5)], [], {(1, 2, 3), (3, 4), (3, 5)}),
        ([(1, 2), (2, 3), (3, 4)], [3], {(1, 2, 3), (3, 4)}),
        ([(1, 2), (2, 3), (3, 1)], [], {(1, 2, 3, 1)}),
        ([(5, 6), (6, 7), (7, 5), (7, 8)], [], {(7, 5, 6, 7), (7, 8)}),
        ([(1, 2), (1, 2), (4, 4)], [], {(1, 2, 1)}),
        ([(i, i + 1) for i in range(40)], [], {tuple(range(41))}),
    ],
)
def test_chains_are_contracted(spark, edges, kept, want):
    df = spark.createDataFrame([(a, b, 1.5) for a, b in edges], "a long, b long, metres double")
    got = network.contracted(df, spark.createDataFrame([(k,) for k in kept], "node long")).collect()
    assert len(got) == len(want)
    for x in got:
        path = tuple(x["path"])
        assert path in want or path[::-1] in want
        assert (x["a"], x["b"], x["metres"]) == (path[0], path[-1], 1.5 * (len(path) - 1))


def test_plans_are_priced_apart(spark):
    """Two plans with the same node numbers; the second has a longer run and an existing chamber as its root."""
    rows = [("p", 1, None, 0.0, 0.0, None), ("p", 2, 1, 100.0, 0.0, None), ("p", 3, 2, 50.0, 3.0, None), ("p", 4, 2, 50.0, 3.0, None), ("q", 1, None, 0.0, 0.0, "chamber"), ("q", 2, 1, 200.0, 3.0, None)]
    trees = spark.createDataFrame(rows, "plan string, node long, parent long, length double, flow double, root_kind string")
    left = spark.createDataFrame([("q", 2.0)], "plan string, flow double")
    got = {x["plan"]: x for x in network.plans_priced(trees, left).collect()}
    price = {d[0]: d[4] for d in r.DIAMETERS}
    assert got["p"]["pipes"] == 100 * price[65] + 100 * price[50] and got["p"]["chambers"] == 3e6 and got["p"]["penalty"] == 0
    assert got["q"]["pipes"] == 200 * price[65] and got["q"]["chambers"] == 5e6 and got["q"]["penalty"] == 101e6
    assert network.plans_priced(trees, left, limited=False).where("plan = 'q'").first()["pipes"] == 200 * price[50]
    assert got["q"]["score"] == pytest.approx(0.7 * (200 * price[65] + 106e6) / 25e6 + 0.3 * 2)
