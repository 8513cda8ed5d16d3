"""Design rules and prices as fixed values, and look-ups in them as column expressions.

The tables have a handful of rows, so that a look-up is a ``CASE`` inside whole-stage code rather
than a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nominal diameter, capacity (t/h), greatest run (m), width (m), price of new pipe per metre.
DIAMETERS = (
    (50, 3.5, 181.0, 0.400, 74023.0),
    (65, 8.3, 245.0, 0.430, 78631.0),
    (80, 13.2, 327.0, 0.470, 83530.0),
    (100, 22.3, 419.0, 0.510, 89748.0),
    (125, 40.2, 554.0, 0.600, 97275.0),
    (150, 65.1, 696.0, 0.650, 105507.0),
    (200, 152.3, 1042.0, 0.880, 120275.0),
    (250, 274.9, 1379.0, 1.050, 135323.0),
    (300, 437.4, 1718.0, 1.150, 150022.0),
    (400, 943.1, 2477.0, 1.370, 190299.0),
    (500, 1663.4, 3245.0, 1.670, 224137.0),
    (600, 2627.7, 4037.0, 1.850, 264790.0),
    (700, 3735.1, 4775.0, 2.050, 324298.0),
    (800, 5296.8, 5644.0, 2.250, 325996.0),
    (900, 7165.0, 6518.0, 2.450, 327693.0),
    (1000, 9391.8, 7419.0, 2.650, 418777.0),
    (1200, 15012.8, 9288.0, 3.100, 428074.0),
    (1400, 22501.9, 11276.0, 3.450, 683417.0),
)
# Price per metre of a diameter that is not in the table, new and rebuilt.
UNKNOWN_PIPE, UNKNOWN_REBUILT = 100_000.0, 80_000.0
# Greatest diameter of the tier, price of a new chamber.
# Height (m) of a pipe and price (per m) of replacing it, by diameter.
HEIGHTS = (
    (50, 0.125), (65, 0.140), (80, 0.160), (100, 0.180), (125, 0.225), (150, 0.250), (200, 0.315), (250, 0.400), (300, 0.450),
    (400, 0.560), (500, 0.710), (600, 0.800), (700, 0.900), (800, 1.000), (900, 1.100), (1000, 1.200), (1200, 1.425), (1400, 1.600),
)
REPLACEMENT = (
    (50, 96180.0), (65, 109989.0), (80, 117582.0), (100, 133694.0), (125, 148030.0), (150, 152295.0), (200, 181766.0), (250, 202030.0), (300, 228707.0),
    (400, 271317.0), (500, 333884.0), (600, 372703.0), (700, 439571.0), (800, 489918.0), (900, 553607.0), (1000, 606679.0), (1200, 825692.0), (1400, 978584.0),
)
CHAMBER_TIERS = ((200, 3e6), (500, 5e6), (1000, 8e6), (1400, 12e6))
# Restriction, action, clearance (m), clearance from a diameter on, cost factor, extension (m), least angle (degrees).
RESTRICTIONS = (
    ("oks", "AVOID", 5.0, {500: 7.0, 900: 9.0}, 1.0, 0.0, 0.0),
    ("oks_existing", "AVOID", 5.0, {500: 7.0, 900: 9.0}, 1.0, 0.0, 0.0),
    ("existing_building", "AVOID", 5.0, {500: 7.0, 900: 9.0}, 1.0, 0.0, 0.0),
    ("park", "AVOID", 1.0, {}, 1.0, 0.0, 0.0),
    ("social_area", "AVOID", 1.0, {}, 1.0, 0.0, 0.0),
    ("prohibited_site", "AVOID", 1.0, {}, 1.0, 0.0, 0.0),
    ("water", "AVOID", 1.0, {}, 1.0, 0.0, 0.0),
    ("road", "SPECIAL", 1.5, {}, 1.60, 3.0, 45.0),
    ("tdtp", "SPECIAL", 1.5, {}, 1.60, 3.0, 45.0),
    ("carriageway", "SPECIAL", 1.5, {}, 1.60, 3.0, 45.0),
    ("tram_tracks", "SPECIAL", 1.5, {}, 1.75, 3.0, 45.0),
    ("railway", "AVOID", 1.0, {}, 1.0, 0.0, 0.0),
    ("gas_pipeline", "SPECIAL", 2.0, {}, 1.25, 2.0, 0.0),
    ("power_cable", "SPECIAL", 2.0, {}, 1.15, 2.0, 0.0),
    ("heat_network", "SPECIAL", 1.0, {}, 1.05, 2.0, 0.0),
    ("default", "AVOID", 2.0, {}, 1.0, 0.0, 0.0),
)
# Texts in a restriction's name and the rule they stand for, in order.
RESTRICTION_ALIASES = (("tdtp", "tdtp"), ("тдтп", "tdtp"), ("tram", "tram_tracks"), ("трам", "tram_tracks"), ("rail", "railway"), ("road", "road"), ("water", "water"), ("gas", "gas_pipeline"), ("cable", "power_cable"))


@dataclass(frozen=True)
class Rules:
    """Scalars of the rules; tables are the constants above unless given."""

    tie_in: float = 5e6
    unconnected_fixed: float = 100e6
    unconnected_per_tph: float = 500e3
    cost_weight: float = 0.7
    length_weight: float = 0.3
    cost_base: float = 25e6
    length_base: float = 100.0
    ordinary_depth: float = 3.0
    depth_factor: float = 0.10
    greatest_slope: float = 0.10
    diameters: tuple = DIAMETERS
    heights: tuple = HEIGHTS
    replacement: tuple = REPLACEMENT
    tiers: tuple = CHAMBER_TIERS
    restrictions: tuple = field(default=RESTRICTIONS)

    @staticmethod
    def from_yaml(path: str) -> "Rules":
        """Scalars and tables from a rules file with the sections costs, ranking, depth, diameters and constraints."""
        import yaml

        with open(path, encoding="utf-8") as f:
            doc = yaml.safe_load(f)
        costs, rank, depth = doc.get("costs", {}), doc.get("ranking", {}), doc.get("depth", {})
        got = {
            "tie_in": costs.get("tap_in_pipe"), "unconnected_fixed": costs.get("unconnected_fixed"), "unconnected_per_tph": costs.get("unconnected_per_tph"),
            "cost_weight": rank.get("cost_weight"), "length_weight": rank.get("length_weight"), "cost_base": rank.get("cost_base"), "length_base": rank.get("length_base"),
            "ordinary_depth": depth.get("default_depth_m"), "depth_factor": depth.get("cost_factor_per_m_depth"), "greatest_slope": depth.get("max_slope"),
        }
        got = {k: float(v) for k, v in got.items() if v is not None}
        if doc.get("diameters"):
            got["diameters"] = tuple((int(d["dn"]), float(d["capacity_tph"]), float(d["max_run_m"]), float(d["width_m"]), float(d["new_per_m"])) for d in doc["diameters"])
            for name, column in (("heights", "height_m"), ("replacement", "recon_per_m")):
                if all(column in d for d in doc["diameters"]):
                    got[name] = tuple((int(d["dn"]), float(d[column])) for d in doc["diameters"])
        if costs.get("new_chamber_tiers"):
            got["tiers"] = tuple((int(t["max_dn"]), float(t["cost"])) for t in costs["new_chamber_tiers"])
        if doc.get("constraints"):
            got["restrictions"] = tuple(
                (name, r.get("action", "AVOID"), float(r.get("min_distance_m", r.get("buffer_m", 0))), {int(k): float(v) for k, v in (r.get("min_distance_by_dn") or {}).items()}, float(r.get("k_spec", 1)), float(r.get("extend_m", 0)), float(r.get("min_angle_deg", 0)))
                for name, r in doc["constraints"].items()
            )
        return Rules(**got)


DEFAULT = Rules()


def _first(pairs: list[tuple[Column, object]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out = otherwise
    for condition, value in reversed(pairs):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def dn_for_flow(flow: Column, rules: Rules = DEFAULT) -> Column:
    """The smallest diameter that carries the flow, else the largest."""
    return _first([(flow <= d[1] + 1e-9, d[0]) for d in rules.diameters], F.lit(rules.diameters[-1][0]))


def _at_least(dn: Column, place: int, rules: Rules) -> Column:
    return _first([(dn <= d[0], d[place]) for d in rules.diameters], F.lit(rules.diameters[-1][place]))


def price_per_metre(dn: Column, rules: Rules = DEFAULT) -> Column:
    """Of the next diameter that is not smaller."""
    return _at_least(dn, 4, rules)


def pipe_price(dn: Column, rules: Rules = DEFAULT) -> Column:
    """For costs: of exactly this diameter, or the price of one that is not in the table."""
    return _first([(dn == d[0], d[4]) for d in rules.diameters], F.lit(UNKNOWN_PIPE))


def greatest_run(dn: Column, rules: Rules = DEFAULT) -> Column:
    return _at_least(dn, 2, rules)


def pipe_width(dn: Column, rules: Rules = DEFAULT) -> Column:
    return _at_least(dn, 3, rules)


def pipe_height(dn: Column, rules: Rules = DEFAULT) -> Column:
    """Of the next diameter that is not smaller."""
    return _first([(dn <= d, h) for d, h in rules.heights], F.lit(rules.heights[-1][1]))


def replacement_price(dn: Column, rules: Rules = DEFAULT) -> Column:
    """Of replacing a metre of pipe by the next diameter that is not smaller."""
    return _first([(dn <= d, p) for d, p in rules.replacement], F.lit(rules.replacement[-1][1]))


def next_dn(dn: Column, rules: Rules = DEFAULT) -> Column:
    """The next larger diameter of the table; the largest stays."""
    return _first([(dn < d[0], d[0]) for d in rules.diameters], F.lit(rules.diameters[-1][0]))


def chamber_price(dn: Column, rules: Rules = DEFAULT) -> Column:
    floored = F.greatest(dn, F.lit(rules.diameters[0][0]))
    return _first([(floored <= most, price) for most, price in rules.tiers], F.lit(rules.tiers[-1][1]))


def unconnected_penalty(flow: Column, rules: Rules = DEFAULT) -> Column:
    return rules.unconnected_fixed + rules.unconnected_per_tph * flow


def depth_factor(depth: Column, rules: Rules = DEFAULT) -> Column:
    return F.when(depth <= rules.ordinary_depth + 1e-9, 1.0).otherwise(1 + rules.depth_factor * (depth - rules.ordinary_depth))


def mean_depth_factor(start: Column, end: Column, rules: Rules = DEFAULT) -> Column:
    """Both ends' mean; a missing end is copied from the other, both missing give 1."""
    a, b = F.coalesce(start, end), F.coalesce(end, start)
    return F.coalesce((depth_factor(a, rules) + depth_factor(b, rules)) / 2, F.lit(1.0))


def restriction_rule(name: Column, rules: Rules = DEFAULT) -> Column:
    """The rule that a restriction's text stands for: itself, its normal form, an alias in it, else default."""
    known = [r[0] for r in rules.restrictions]
    plain = normal(name)
    exact = F.when(name.isin(known), name).when(plain.isin(known), plain)
    return F.coalesce(exact, _first([(plain.contains(text), rule) for text, rule in RESTRICTION_ALIASES], F.lit("default")), F.lit("default"))


def restriction_value(rule: Column, place: int, rules: Rules = DEFAULT) -> Column:
    return _first([(rule == r[0], r[place]) for r in rules.restrictions], F.lit(rules.restrictions[-1][place]))


def clearance(rule: Column, dn: Column, rules: Rules = DEFAULT) -> Column:
    """The least distance to the restriction for a pipe of this diameter."""
    out = F.lit(rules.restrictions[-1][2])
    for name, _, base, by_dn, *_ in reversed(rules.restrictions):
        own = F.lit(base)
        for least, metres in sorted(by_dn.items()):
            own = F.when(dn >= least, metres).otherwise(own)
        out = F.when(rule == name, own).otherwise(out)
    return out


def normal(text: Column) -> Column:
    """Trimmed, lower case, one spelling of the Cyrillic yo."""
    return F.translate(F.lower(F.trim(text)), "ё", "е")


def alias_text(props: Column, names: list[str]) -> Column:
    """The first property that is not blank."""
    return F.coalesce(*[F.when(F.trim(props[n]) != "", props[n]) for n in names])


def alias_number(props: Column, names: list[str]) -> Column:
    """The first property that is a number, with a comma or a point."""
    return F.coalesce(*[F.replace(props[n], F.lit(","), F.lit(".")).try_cast("double") for n in names])


# What a feature's type text stands for.
KIND_TOKENS = {
    "heat_network": "EXISTING_SEGMENT", "existing_segment": "EXISTING_SEGMENT", "teploset": "EXISTING_SEGMENT",
    "heat_chamber": "CHAMBER", "chamber": "CHAMBER", "tk": "CHAMBER",
    "source": "SOURCE", "heat_source": "SOURCE", "istochnik": "SOURCE",
    "oks_future": "OKS_PROSPECTIVE", "oks_prospective": "OKS_PROSPECTIVE", "oks": "OKS_PROSPECTIVE",
    "oks_existing": "OKS_EXISTING",
    "oks_connection_point": "CONNECTION_POINT", "connection_point": "CONNECTION_POINT",
    "restriction": "CONSTRAINT", "constraint": "CONSTRAINT",
}
# Texts of a kind that name a restriction.
CONSTRAINT_TEXTS = ("парк", "дорог", "река", "метро", "road", "park", "river", "tdtp", "тдтп", "трам", "проезж", "carriage")


def feature_kind(kind: Column, geometry: Column, flow: Column, next_id: Column, oks_id: Column) -> Column:
    """A feature's kind: by its type text, else by geometry and fields, else by parts of the text."""
    text, shape = F.coalesce(normal(kind), F.lit("")), F.lower(F.coalesce(geometry, F.lit("")))
    token = _first([(text == k, v) for k, v in KIND_TOKENS.items()], F.lit(None).cast("string"))
    polygon = shape.contains("polygon")
    any_of = lambda words: F.greatest(*[text.contains(w) for w in words])
    guessed = (
        F.when(shape.contains("line") & next_id.isNotNull(), "EXISTING_SEGMENT")
        .when(shape.isin("point", "multipoint") & oks_id.isNotNull(), "CONNECTION_POINT")
        .when(polygon & flow.isNotNull(), "OKS_PROSPECTIVE")
        .when(any_of(["камер", "chamber"]), "CHAMBER")
        .when(any_of(["источ", "source", "тэц"]), "SOURCE")
        .when(any_of(CONSTRAINT_TEXTS) | polygon, "CONSTRAINT")
        .otherwise("UNKNOWN")
    )
    return F.coalesce(token, guessed)


def rounded(value: Column, places: int) -> Column:
    """Half up, the same in every engine."""
    scale = 10.0**places
    return F.floor(value * scale + 0.5) / scale
