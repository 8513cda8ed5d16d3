"""What an existing network must be replaced for: flow added by new taps, carried towards the source.

The network is a forest of elements (element, next, and for segments dn, flow, length), chambers and segments alike, each
with the element behind it on the way to the source. A tap draws flow at a place of a segment, in metres from its end at the
source, or at a chamber. Added flow is gathered up the forest by doubled jumps; within a segment it is a running sum over
the places of its taps.

Defined results: a tap at the end at the source takes nothing of its own segment, one beyond the other end counts there;
taps of equal place are one; null flows count 0; elements that no added flow reaches have no row; an unknown element's taps
are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as r
from ..store import materialize
from . import network


def added_flow(elements: DataFrame, taps: DataFrame) -> DataFrame:
    """(element, through): the flow of all taps (element, flow) behind each element, without its own."""
    own = taps.groupBy("element").agg(F.sum(F.coalesce("flow", F.lit(0.0))).alias("own"))
    tree = elements.select(F.col("element").alias("node"), F.col("next").alias("parent")).withColumn("length", F.lit(0.0))
    tree = materialize(tree.join(own.withColumnRenamed("element", "node"), "node", "left").fillna(0.0, ["own"]), "added-flow")
    total = network.gathered(tree.withColumn("through", F.col("own")), {"through": "sum"})
    return total.join(tree.select("node", "own"), "node").select(F.col("node").alias("element"), (F.col("through") - F.col("own")).alias("through"))


def loaded_parts(elements: DataFrame, taps: DataFrame, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(element, s0, s1, added, required): segments cut at their taps (element, at, flow), with the added flow of each part and the
    diameter that it asks for together with the segment's own flow. Only parts with added flow, or of segments with taps, are given."""
    segments = elements.where("length is not null").select("element", "dn", F.coalesce("flow", F.lit(0.0)).alias("flow"), "length")
    through = added_flow(elements, taps)
    places = taps.join(segments.select("element", "length"), "element").select("element", F.least("at", "length").alias("at"), F.coalesce("flow", F.lit(0.0)).alias("flow"))
    places = places.where("at > 1e-9").groupBy("element", "at").agg(F.sum("flow").alias("own"))
    order = Window.partitionBy("element").orderBy("at")
    to_end = segments.select("element", F.col("length").alias("at"), F.lit(0.0).alias("own"))
    cuts = places.unionByName(to_end).groupBy("element", "at").agg(F.sum("own").alias("own"), F.max(F.col("own") > 0).alias("_tap"))
    # A part carries what its own far end and all places beyond it draw.
    behind = F.sum("own").over(order.rowsBetween(0, Window.unboundedFollowing))
    parts = cuts.select("element", F.coalesce(F.lag("at").over(order), F.lit(0.0)).alias("s0"), F.col("at").alias("s1"), behind.alias("behind"))
    tapped = taps.select("element").distinct().withColumn("_tapped", F.lit(True))
    loaded = parts.join(segments, "element").join(through, "element").join(tapped, "element", "left")
    added = F.col("through") + F.col("behind")
    loaded = loaded.where((F.col("s1") > F.col("s0")) & ((F.col("through") > 1e-12) | F.col("_tapped")))
    return loaded.select("element", "s0", "s1", added.alias("added"), r.dn_for_flow(F.col("flow") + added, rules).alias("required"))


def replaced(elements: DataFrame, taps: DataFrame, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(element, s0, s1, added, required, cost): the parts whose flow asks for a greater diameter than they have, and what replacing them costs."""
    parts = loaded_parts(elements, taps, rules).join(elements.where("length is not null").select("element", "dn"), "element")
    return parts.where("required > dn").select("element", "s0", "s1", "added", "required", ((F.col("s1") - F.col("s0")) * r.replacement_price(F.col("required"), rules)).alias("cost"))


def rebuilt_chambers(chambers: DataFrame, adjacency: DataFrame, elements: DataFrame, taps: DataFrame, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(chamber, required, cost): chambers (chamber, dn) with taps (element: the chamber, new_dn) that must be rebuilt for what meets in them:
    the taps' own pipes and the adjacent segments (chamber, element, upper: whether by their end at the source) as they will be."""
    parts = loaded_parts(elements, taps, rules)
    ends = parts.groupBy("element").agg(F.min_by("required", "s0").alias("_upper"), F.max_by("required", "s0").alias("_lower"))
    old = elements.where("length is not null").select("element", "dn")
    met = adjacency.join(old, "element").join(ends, "element", "left")
    will = F.greatest("dn", F.when(F.col("upper"), F.col("_upper")).otherwise(F.col("_lower")))
    beside = met.groupBy("chamber").agg(F.max(will).alias("_beside"))
    tapped = taps.groupBy(F.col("element").alias("chamber")).agg(F.max("new_dn").alias("_new"))
    needed = chambers.join(tapped, "chamber").join(beside, "chamber", "left").withColumn("required", F.greatest("_new", "_beside"))
    return needed.where(F.col("required") > F.coalesce("dn", F.lit(0))).select("chamber", "required", r.chamber_price(F.col("required"), rules).alias("cost"))
