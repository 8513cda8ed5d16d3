"""Depths at crossings: which side of each utility to pass, and the profile between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as r
from ..store import by_key


def choose_depth(bands: DataFrame, key: str, floor: float = 0.7, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(key, depth): for the utilities (above_max, below_min) of each crossing, a depth that passes each above
    or below: the cheapest, then the nearest to the ordinary depth. If there is none, below all.
    ``bands`` may have a ``floor`` of its own for a crossing.

    The best depth is the floor, the ordinary depth or an end of a band, so those 2 n + 2 are tried against the n bands.
    """
    least = F.greatest(F.lit(floor), F.max("floor")) if "floor" in bands.columns else F.lit(floor)
    crossing = bands.groupBy(key).agg(F.collect_list(F.struct("above_max", "below_min")).alias("bands"), least.alias("floor"))
    ends = F.flatten(F.transform("bands", lambda b: F.array(b["above_max"], b["below_min"])))
    tried = crossing.select(key, "bands", "floor", F.explode(F.array_distinct(F.concat(F.array(F.col("floor"), F.lit(rules.ordinary_depth)), ends))).alias("depth"))
    passes = F.forall("bands", lambda b: (F.col("depth") <= b["above_max"] + 1e-9) | (F.col("depth") >= b["below_min"] - 1e-9))
    cost = F.struct(r.rounded(r.depth_factor(F.col("depth"), rules), 9), r.rounded(F.abs(F.col("depth") - rules.ordinary_depth), 9), "depth")
    best = tried.where((F.col("depth") >= F.col("floor")) & passes).groupBy(key).agg(F.min_by("depth", cost).alias("depth"))
    deepest = bands.groupBy(key).agg(F.greatest(least, F.max("below_min")).alias("deepest"))
    return deepest.join(best, key, "left").select(key, F.coalesce("depth", "deepest").alias("depth"))


def profile(stations: DataFrame, pins: DataFrame, key: str, rules: r.Rules = r.DEFAULT) -> DataFrame:
    """(key, s, depth) at stations (key, s): the ordinary depth held within the cones of the pins
    (key, at, low, high), whose sides have the greatest slope; the lower bound wins.

    On either side of a station the cones differ by their height at 0 only, so running extremes of those do.
    """
    slope = rules.greatest_slope
    both = stations.select(key, F.col("s").alias("at"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(True).alias("station"))
    both = both.unionByName(pins.select(key, "at", "low", "high", F.lit(False).alias("station")))
    line = Window.partitionBy(key).orderBy("at")
    before, after = line.rangeBetween(Window.unboundedPreceding, Window.currentRow), line.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    at, low, high = F.col("at"), F.col("low"), F.col("high")
    bounds = both.select(
        key, "at", "station",
        F.greatest(F.max(low + slope * at).over(before) - slope * at, F.max(low - slope * at).over(after) + slope * at).alias("low"),
        F.least(F.min(high - slope * at).over(before) + slope * at, F.min(high + slope * at).over(after) - slope * at).alias("high"),
    )
    ordinary = F.lit(rules.ordinary_depth)
    return bounds.where("station").select(key, at.alias("s"), F.greatest(F.coalesce("low", ordinary), F.least(F.coalesce("high", ordinary), ordinary)).alias("depth"))


# Texts in an obstacle's type and its kind, in order.
OBSTACLE_TEXTS = (
    ("RAILWAY", ("rail", "железн")), ("TRAM", ("tram", "трам")), ("GAS", ("gas", "газ")), ("CABLE", ("cable", "кабел")), ("HEAT", ("heat", "тепл")), ("ROAD", ("road", "дорог")),
)
# Clear distance (m) and own height (m, null: by the diameter) of what is passed above or below; least cover (m) under ways.
UTILITIES = {"GAS": (0.20, 0.40), "CABLE": (0.50, 0.20), "HEAT": (0.50, None)}
#: The diameter of a heat network of which it is not known.
HEAT_DN = 150
COVERS = {"ROAD": 1.0, "TRAM": 1.2}


def obstacle_kind(kind: Column) -> Column:
    """What an obstacle's type text stands for; null for what depths do not depend on."""
    text, out = r.normal(kind), F.lit(None).cast("string")
    for name, words in reversed(OBSTACLE_TEXTS):
        out = F.when(F.greatest(*[text.contains(w) for w in words]), name).otherwise(out)
    return out


def usual(values: dict, kind: Column) -> Column:
    """The value that a kind has in a table; null for others."""
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(kind == name, F.lit(value).cast("double")).otherwise(out)
    return out


def utility_height(kind: Column, dn: Column, width: bool = False, rules: r.Rules = r.DEFAULT) -> Column:
    """The height of a utility, or its width: gas mains and cables are square, heat networks have it by their diameter."""
    own = r.pipe_width if width else r.pipe_height
    return F.coalesce(usual({k: v[1] for k, v in UTILITIES.items()}, kind), F.when(kind == "HEAT", own(F.coalesce(dn, F.lit(HEAT_DN)), rules)))


def window(kind: Column, top: Column, dn: Column, other_dn: Column, rules: r.Rules = r.DEFAULT) -> Column:
    """The struct (above_max, below_min) of a pipe's depth beside a utility whose top lies ``top`` metres deep; null for other kinds.

    Depths are those of a pipe's top: above, the pipe itself (``dn``) and the clear distance fit over the utility; below, the
    utility (``other_dn``) and the clear distance fit over the pipe.
    """
    clear = usual({k: v[0] for k, v in UTILITIES.items()}, kind)
    return F.struct((top - clear - r.pipe_height(dn, rules)).alias("above_max"), (top + utility_height(kind, other_dn, rules=rules) + clear).alias("below_min"))


def least_cover(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, metres in COVERS.items():
        out = F.when(kind == name, metres).otherwise(out)
    return out


def pin_floors(pins: DataFrame, covers: DataFrame, floor: float = 0.7) -> DataFrame:
    """(edge, pin, floor): the greatest cover (edge, c0, c1, cover) that meets the interval of each pin (edge, pin, s0, s1)."""
    met = (F.col("c0") <= F.col("s1")) & (F.col("s0") <= F.col("c1"))
    return by_key(pins, "edge").join(covers, "edge", "left").groupBy("edge", "pin").agg(F.coalesce(F.max(F.when(met, F.col("cover"))), F.lit(floor)).alias("floor"))
