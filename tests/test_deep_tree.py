"""Trees deeper than any fixed number of levels."""

from trenchwork.operators import routes


def test_flow_reaches_the_root_of_a_deep_tree(spark):
    tree = spark.createDataFrame([(0, None, 0.0), *((i, i - 1, 1.0) for i in range(1, 151))], "node long, parent long, length double")
    got = routes.sized(tree, spark.createDataFrame([(150, 2.0)], "node long, flow double"))
    assert {r["node"]: r["flow"] for r in got.collect()} == {i: 2.0 for i in range(1, 151)}
