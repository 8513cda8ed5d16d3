"""Interval sweeps: covering pieces with the greatest factor, and unions of near intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end, k): pieces of the line between neighbouring end points, each with the greatest
    ``k`` of the spans (key, s0, s1, k, zone) that cover it; pieces that touch are joined if their factor
    and their set of zones agree.

    All of it runs on one partitioning by the key: end points are numbered by a window, a span covers the pieces from the
    number of its start to the one before that of its end, and sets of zones are told apart by their size and a 64-bit hash.
    Spans are gone through once, and those that lie together by their key (``store.by_key``) are not moved.
    """
    line = Window.partitionBy(key).orderBy("at")
    marked = spans.select(key, "s0", "s1", "k", "zone").withColumn("_id", F.monotonically_increasing_id())
    ends = marked.select(key, "_id", "k", "zone", F.explode(F.array("s0", "s1")).alias("at")).withColumn("piece", F.dense_rank().over(line))
    own = ends.groupBy(key, "_id", "k", "zone").agg(F.min("piece").alias("_first"), F.max("piece").alias("_last"), F.min("at").alias("_from"), F.max("at").alias("_to"))
    # The piece behind the end of a span is not covered by it, but is known to begin there.
    over = own.select(key, "k", "zone", "_first", "_last", "_from", "_to", F.explode(F.sequence("_first", "_last")).alias("piece"))
    covers, at = F.col("piece") < F.col("_last"), F.when(F.col("piece") == F.col("_first"), F.col("_from")).when(F.col("piece") == F.col("_last"), F.col("_to"))
    once = over.groupBy(key, "piece", "zone").agg(F.max(at).alias("at"), F.max(F.when(covers, F.col("k"))).alias("k"), F.max(covers).alias("_covers"))
    both = once.groupBy(key, "piece").agg(F.max("at").alias("at"), F.max("k").alias("k"), F.count_if("_covers").alias("zones"), F.bit_xor(F.when(F.col("_covers"), F.xxhash64("zone"))).alias("which"))
    order = Window.partitionBy(key).orderBy("piece")
    pieces = both.withColumn("to", F.lead("at").over(order)).where(F.col("k").isNotNull() & (F.col("to") - F.col("at") >= 1e-9))
    same = (F.abs(F.lag("to").over(order) - F.col("at")) < 1e-9) & (F.abs(F.lag("k").over(order) - F.col("k")) < 1e-12)
    same = same & (F.lag("zones").over(order) == F.col("zones")) & (F.lag("which").over(order) == F.col("which"))
    runs = pieces.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min("at").alias("start"), F.max("to").alias("end"), F.max("k").alias("k")).drop("run")


def union_intervals(intervals: DataFrame, key: str, gap: float = 0.05) -> DataFrame:
    """(key, start, end, n): intervals (key, s0, s1) that overlap or lie within ``gap`` joined."""
    order = Window.partitionBy(key).orderBy("s0", "s1")
    reach = F.max("s1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = intervals.withColumn("_reach", reach).withColumn("run", F.sum(F.when(F.col("s0") <= F.col("_reach") + gap, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min("s0").alias("start"), F.max("s1").alias("end"), F.count("*").alias("n")).drop("run")
