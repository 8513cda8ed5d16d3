"""Pinned values of diameters, prices, depths and kinds."""

import pytest
from pyspark.sql import functions as F

from trenchwork.functions import rules as r


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("flow", "dn"), [(10, 80), (12, 80), (13, 80), (13.3, 100), (500, 400), (50, 150), (1e9, 1400), (0, 50)])
def test_dn_for_flow(spark, flow, dn):
    assert one(spark, r.dn_for_flow(F.lit(float(flow)))) == dn


def test_prices(spark):
    assert one(spark, r.price_per_metre(F.lit(100))) == 89748
    assert one(spark, r.price_per_metre(F.lit(90))) == 89748
    assert (one(spark, r.pipe_price(F.lit(100))), one(spark, r.pipe_price(F.lit(90)))) == (89748, 100_000)
    assert one(spark, r.chamber_price(F.lit(200))) == 3e6
    assert one(spark, r.chamber_price(F.lit(201))) == 5e6
    assert one(spark, r.chamber_price(F.lit(5000))) == 12e6
    assert one(spark, r.unconnected_penalty(F.lit(2.0))) == 101e6
    assert one(spark, r.next_dn(F.lit(80))) == 100
    assert one(spark, r.next_dn(F.lit(1400))) == 1400


def test_depth_factors(spark):
    assert one(spark, r.depth_factor(F.lit(3.4))) == pytest.approx(1.04)
    assert one(spark, r.depth_factor(F.lit(2.5))) == 1
    assert one(spark, r.mean_depth_factor(F.lit(3.0), F.lit(3.4))) == pytest.approx(1.02)
    assert one(spark, r.mean_depth_factor(F.lit(None).cast("double"), F.lit(3.4))) == pytest.approx(1.04)
    assert one(spark, r.mean_depth_factor(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 1


def test_clearance_and_rules(spark):
    assert one(spark, r.clearance(F.lit("oks"), F.lit(400))) == 5
    assert one(spark, r.clearance(F.lit("oks"), F.lit(500))) == 7
    assert one(spark, r.clearance(F.lit("oks"), F.lit(1000))) == 9
    assert one(spark, r.restriction_rule(F.lit(" Трамвай "))) == "tram_tracks"
    assert one(spark, r.restriction_rule(F.lit(None).cast("string"))) == "default"


def test_aliases(spark):
    props = F.create_map(F.lit("flow"), F.lit("abc"), F.lit("q"), F.lit(" 12,5 "), F.lit("name"), F.lit(" "), F.lit("title"), F.lit("T"))
    assert one(spark, r.alias_number(props, ["flow_tph", "flow", "q"])) == 12.5
    assert one(spark, r.alias_text(props, ["name", "title"])) == "T"


def test_rounding_is_half_up(spark):
    assert one(spark, r.rounded(F.lit(1.005), 2)) == 1.0
    assert one(spark, r.rounded(F.lit(2.5), 0)) == 3.0


def test_rules_from_yaml(tmp_path):
    path = tmp_path / "rules.yml"
    path.write_text("costs: {tap_in_pipe: 1, new_chamber_tiers: [{max_dn: 100, cost: 7}]}\nranking: {cost_weight: 1}\ndiameters: [{dn: 50, capacity_tph: 1, max_run_m: 2, width_m: 3, new_per_m: 4}]\n")
    got = r.Rules.from_yaml(str(path))
    assert (got.tie_in, got.tiers, got.cost_weight, got.diameters) == (1, ((100, 7.0),), 1, ((50, 1.0, 2.0, 3.0, 4.0),))
