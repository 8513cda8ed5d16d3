"""Cost of connection plans, their ranking, and which of them others make pointless."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as r

MANAGED = ("mincost", "mintaps", "minrecon", "independent")


def pipe_cost(length: Column, dn: Column, k_spec: Column, depth_from: Column, depth_to: Column, rules: r.Rules = r.DEFAULT) -> Column:
    return length * r.pipe_price(dn, rules) * F.when(k_spec > 0, k_spec).otherwise(1.0) * r.mean_depth_factor(depth_from, depth_to, rules)


def roll_up(segments: DataFrame, chambers: DataFrame, tie_ins: DataFrame, unconnected: DataFrame, key: str, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """One row for each plan: pipes, chambers, tie_ins and tie_in_count, penalty, total and length. A chamber without a
    diameter takes the greatest of the segments (from_id, to_id, dn) at it. Pipes are summed in whole hundredths."""
    pipes = segments.groupBy(key).agg((F.sum(F.floor(pipe_cost(F.col("length"), F.col("dn"), F.col("k_spec"), F.col("depth_from"), F.col("depth_to"), rules) * 100 + 0.5)) / 100).alias("pipes"), F.sum("length").alias("length"))
    ends = segments.select(key, F.explode(F.array("from_id", "to_id")).alias("id"), F.col("dn").alias("_dn")).groupBy(key, "id").agg(F.max("_dn").alias("_dn"))
    sized = chambers.join(ends, [key, "id"], "left").withColumn("_own", F.coalesce("dn", "_dn", F.lit(50)))
    built = sized.groupBy(key).agg(F.sum(r.chamber_price(F.col("_own"), rules)).alias("chambers"))
    tied = tie_ins.groupBy(key).agg((F.count("*") * rules.tie_in).alias("tie_ins"), F.count("*").alias("tie_in_count"))
    left = unconnected.groupBy(key).agg(F.sum(r.unconnected_penalty(F.col("flow"), rules)).alias("penalty"), F.count("*").alias("unconnected"))
    out = pipes
    for part in (built, tied, left):
        out = out.join(part, key, "full")
    out = out.fillna(0)
    return out.withColumn("total", F.col("pipes") + F.col("chambers") + F.col("tie_ins") + F.col("penalty"))


# Names of the parts of a plan's cost, in their order.
BREAKDOWN = (
    "pipe_cost", "construction_cost", "chamber_construction_cost", "existing_chamber_tie_in_cost", "existing_chamber_tie_in_count", "tie_in_cost",
    "reconstruction_cost", "chamber_reconstruction_cost", "unconnected_penalty", "calculated_cost",
)


def breakdown(costs: DataFrame) -> DataFrame:
    """``costs`` of ``roll_up`` with ``breakdown``, a map of the parts of each plan's cost by name. Nothing is replaced in
    a plan, so what that costs is 0."""
    built = F.col("pipes") + F.col("chambers") + F.col("tie_ins")
    parts = dict(zip(BREAKDOWN, (F.col("pipes"), built, F.col("chambers"), F.col("tie_ins"), F.col("tie_in_count"), F.col("tie_ins"), F.lit(0.0), F.lit(0.0), F.col("penalty"), built + F.col("penalty"))))
    return costs.withColumn("breakdown", F.create_map(*[x for name, value in parts.items() for x in (F.lit(name), value.cast("double"))]))


def score(cost: Column, length: Column, rules: r.Rules = r.DEFAULT) -> Column:
    return rules.cost_weight * cost / rules.cost_base + rules.length_weight * length / rules.length_base


def undominated(plans: DataFrame, run: str) -> DataFrame:
    """Plans (run, code, cost, taps, length, unconnected) that no managed plan of the run makes pointless."""
    other = plans.where(F.col("code").isin(*MANAGED)).select(*[F.col(c).alias(f"_{c}") for c in (run, "code", "cost", "taps", "length", "unconnected")])
    c = F.col
    no_worse = (c("_cost") <= c("cost") + 1) & (c("_taps") <= c("taps")) & (c("_length") <= c("length") + 1) & (c("_unconnected") <= c("unconnected"))
    better = (c("_cost") + 1000 < c("cost")) | (c("_taps") < c("taps")) | (c("_unconnected") < c("unconnected"))
    beaten = (c(f"_{run}") == c(run)) & c("code").isin(*MANAGED) & (c("_code") != c("code")) & no_worse & better
    return plans.join(other, beaten, "left_anti")


def ranked(plans: DataFrame, run: str, most: int = 3, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """The ``most`` best plans of each run by score, cost and code."""
    order = Window.partitionBy(run).orderBy("score", "cost", F.coalesce("code", F.lit("")))
    return plans.withColumn("score", score(F.col("cost"), F.col("length"), rules)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def design_dn(demand: DataFrame, key: str, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(key, flow, dn): the flow of the connected consumers (key, flow, connected) together, and the diameter for it."""
    total = demand.where("connected").groupBy(key).agg(F.sum("flow").alias("flow"))
    return total.withColumn("dn", r.dn_for_flow(F.col("flow"), rules))


def tap_sites(taps: DataFrame, key: str) -> DataFrame:
    """(key, sites): new chambers at taps and distinct existing ones of taps (key, chamber, existing); if there are neither, the taps."""
    found = taps.groupBy(key).agg((F.count("chamber") + F.count_distinct("existing")).alias("sites"), F.count("*").alias("taps"))
    return found.select(key, F.when(F.col("sites") > 0, F.col("sites")).otherwise(F.col("taps")).alias("sites"))


# The title of the plan of least cost.
LEAST_COST = "Минимальная стоимость"
FEWEST_TAPS, LEAST_LENGTH, ADDITIONAL = "Минимум врезок", "Минимальная длина", "Дополнительный контур"


def titled(plans: DataFrame, run: str, near: float = 40.0, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """Plans (run, code, title, cost, taps, length) with their titles put right, in runs that asked for least cost.

    The plan with the least score has the title of least cost; of scores that agree to 1e-9 that with fewer taps, then the
    first by code. Any other plan that bears that title gets another by what it is better at than this one: fewer taps,
    shorter by more than ``near`` metres, or else "additional". Other titles stay.
    """
    whole = Window.partitionBy(run)
    scored = plans.withColumn("_score", score(F.col("cost"), F.col("length"), rules))
    close = F.col("_score") <= F.min("_score").over(whole) + 1e-9
    best = F.min(F.when(close, F.struct("taps", "code", "length"))).over(whole)
    asked = F.max(F.coalesce(F.col("code") == "mincost", F.lit(False)).cast("int")).over(whole) == 1
    placed = scored.withColumns({"_best": best, "_asked": asked})
    other = F.when(F.col("taps") < F.col("_best.taps"), FEWEST_TAPS).when(F.col("length") + near < F.col("_best.length"), LEAST_LENGTH).otherwise(ADDITIONAL)
    title = F.when(~F.col("_asked"), F.col("title")).when(F.col("code") == F.col("_best.code"), LEAST_COST).when(F.col("title") == LEAST_COST, other).otherwise(F.col("title"))
    return placed.withColumn("title", title).drop("_score", "_best", "_asked")


def start_orders(consumers: DataFrame, key: str) -> DataFrame:
    """Consumers (key, id, near, flow) with their places by distance to the network, by flow and by distance from the far end,
    and in a mixed order that is the same in every run."""
    rank = lambda *order: F.row_number().over(Window.partitionBy(key).orderBy(*order, "id"))
    return consumers.withColumns({"nearest": rank("near"), "largest": rank(F.desc("flow")), "farthest": rank(F.desc("near")), "mixed": rank(F.xxhash64("id"))})


def strategies(asked: list[str], known: tuple[str, ...] = MANAGED[:3]) -> list[str]:
    """The strategies to run: all if none is asked for, unknown ones and repeats left out, least cost if nothing is left."""
    if not asked:
        return list(known)
    return list(dict.fromkeys(s for s in asked if s in known)) or [known[0]]
