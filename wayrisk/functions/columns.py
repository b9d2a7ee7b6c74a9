"""Scalar rules as Column expressions (survey rows P1-P43).

Everything here stays in the JVM and in whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
LANE_PAIR_WIDTH = 7.3
TONS_PER_VEHICLE = 15.0
DAYS_PER_YEAR = 365
REST_OF_WORLD = "Rest of World"
EXPORTS = ("Exportación", "Vehículos Expo", "Transbordo Expo", "Cabotaje Salido")
IMPORTS = ("Importación", "Transbordo Impo", "Vehículos Impo", "Cabotaje Entrado")
SURFACES = (("A", "Asfalto"), ("H", "Hormigon"), ("R", "Ripio"), ("T", "Tierra"), ("B", "Tratamiento"))
PAVED_TEXT = "pavimentado, pavimento en construcc"
CHANGE_CLASSES = ((-1e10, -100, "< -100"), (-100, -50, "-100 to -50"), (-50, -10, "-50 to -10"), (-10, 0, "-10 to 0"), (0.001, 10, "0 to 10"), (10, 50, "10 to 50"), (50, 100, "50 to 100"), (100, 1e10, " > 100"))
QUALITY_BANDS = (0, 3, 5, 7)
SERVICE_BANDS = (0, 1, 2, 3)
ACCENTED, PLAIN = "áéíóúüñàèìòùâêîôûçäöÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛÇÄÖ", "aeiouunaeiouaeioucaoAEIOUUNAEIOUAEIOUCAO"


def tidy_columns(df: DataFrame, names: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Trim and lower-case column names, rename by dictionary, keep a subset."""
    df = df.toDF(*(c.strip().lower() for c in df.columns)).withColumnsRenamed(names or {})
    return df.select(*keep) if keep else df


def fill_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric gaps after a left join become 0; text stays null."""
    return df.fillna(0, subset=cols)


def or_default_date(ts: Column, default: str) -> Column:
    """P3."""
    return F.coalesce(ts, F.lit(default).cast("timestamp"))


def transit_hours(start: Column, end: Column) -> Column:
    """Hours between two timestamps."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600


def transit_speed(km: Column, hours: Column) -> Column:
    """km/h, null where no time passed."""
    return F.when(hours != 0, km / hours)


def choose_speed(given: Column, of_path: Column, low: float = 10.0, high: float = 50.0, default: float = 20.0) -> Column:
    """P5: the given speed if plausible, else the path's, else a default."""
    return F.when(given.between(low, high), given).when(of_path.between(low, high), of_path).otherwise(F.lit(default))


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def normal_name(text: Column, replacements: tuple[tuple[str, str], ...] = ()) -> Column:
    """Lower, trim, fold accents, then replace in the given order."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), replacements, fold_accents(F.lower(F.trim(text))))


def depth_metres(depth: Column) -> Column:
    """P7: '50cm' to 0.5, '1m' to 1.0; a plain number stays."""
    number = F.regexp_extract(depth, r"([0-9.]+)", 1)
    value = F.when(number != "", number).cast("double")
    return F.when(depth.contains("cm"), value / 100).otherwise(value)


def tons_of(amount: Column, unit: Column) -> Column:
    """Vehicles count 15 t each."""
    return F.when(F.lower(F.trim(unit)) == "unidades", TONS_PER_VEHICLE * amount).otherwise(amount)


def per_day(annual: Column) -> Column:
    """P8."""
    return annual / DAYS_PER_YEAR


def scaled(df: DataFrame, cols: list[str], factor: float) -> DataFrame:
    """Value columns times one factor (a currency, a report scale, 0.01 x percent)."""
    return df.withColumns({c: factor * F.col(c) for c in cols})


def trade_kind(operation: Column) -> Column:
    """P10."""
    return F.when(operation.isin(*EXPORTS), "Export").when(operation.isin(*IMPORTS), "Import").otherwise("Transit")


def port_legs(origin: Column, port: Column, destination: Column, kind: Column, world: Column | str = "world") -> Column:
    """One or two directed legs of a port record, as array<struct<o, d>>.

    One distinct id: a leg with the rest of the world. Two: a leg with the
    other id. Three: origin to port and port to destination. Imports go to the
    port, all else from it.
    """
    world = F.lit(world) if isinstance(world, str) else world

    def leg(o, d):
        return F.struct(o.alias("o"), d.alias("d"))

    def single(other):
        return F.array(F.when(kind == "Import", leg(other, port)).otherwise(leg(port, other)))

    n = F.size(F.array_distinct(F.array(origin, port, destination)))
    other = F.when(origin != port, origin).otherwise(destination)
    return F.when(n == 1, single(world)).when(n == 2, single(other)).otherwise(F.array(leg(origin, port), leg(port, destination)))


def province_name(name: Column) -> Column:
    """P12: 'none' is abroad; the capital under its full name."""
    return F.when(name == "none", REST_OF_WORLD).when(F.lower(F.trim(name)) == "ciudad bs as", "Ciudad Autónoma de Buenos Aires").otherwise(name)


def is_missing(text: Column) -> Column:
    """Null, '0' and 'none' stand for a missing text."""
    return text.isNull() | F.lower(F.trim(text)).isin("0", "none")


def road_name(name: Column) -> Column:
    """P13."""
    return F.when(is_missing(name), "no number").otherwise(name)


def road_surface(road_type: Column, material: Column, surface: Column) -> Column:
    """National roads by material codes in fixed order, others by their surface text."""
    codes = F.split(material, ",")
    named = F.array_join(F.array_compact(F.array(*(F.when(F.array_contains(codes, c), n) for c, n in SURFACES))), ",")
    national = F.when(is_missing(material), "Asfalto").otherwise(named)
    return F.when(F.lower(F.trim(road_type)) == "national", national).when(is_missing(surface), "Tierra").otherwise(F.initcap(surface))


def road_condition(road_type: Column, material: Column, surface: Column) -> Column:
    """Paved or unpaved. A surface counts as paved when it is a part of one fixed text (quirk kept)."""
    material = F.coalesce(material, F.lit(""))
    national = F.when(material.rlike("[ABH]"), "paved").when(material.rlike("[RT]"), "unpaved").otherwise("paved")
    text = F.lower(F.trim(F.coalesce(surface, F.lit(""))))
    return F.when(F.lower(F.trim(road_type)) == "national", national).when(F.lit(PAVED_TEXT).contains(text), "paved").otherwise("unpaved")


def default_width(width: Column, road_type: Column) -> Column:
    """P16."""
    return F.when(width != 0, width).when(road_type.isin("national", "province"), LANE_PAIR_WIDTH).when(road_type == "rural", LANE_PAIR_WIDTH / 2).otherwise(width)


def terrain_class(terrain: Column) -> Column:
    """P16."""
    return F.when(normal_name(terrain) == "montana", "mountain").otherwise("flat")


def default_speeds(min_speed: Column, max_speed: Column, road_type: Column, service: Column, quality: Column) -> Column:
    """struct(min_speed, max_speed); known speeds stay, others follow from class, service and quality."""

    def pair(lo, hi):
        return F.struct(F.lit(lo).cast("double").alias("min_speed"), F.lit(hi).cast("double").alias("max_speed"))

    def within(c, lo, hi):
        return (c > lo) & (c <= hi)

    known = F.struct(min_speed.cast("double").alias("min_speed"), max_speed.cast("double").alias("max_speed"))
    national = F.when(within(service, 0, 1) | within(quality, 0, 3), pair(50, 80)).when(within(service, 1, 2) | within(quality, 3, 6), pair(60, 90)).otherwise(pair(70, 100))
    return F.when(min_speed != 0, known).when(road_type == "national", national).when(road_type == "province", pair(40, 60)).otherwise(pair(20, 40))


def travel_times(length: Column, min_speed: Column, max_speed: Column, default: float = 20.0) -> Column:
    """struct(min_time, max_time) in hours; speed 0 stands for the default."""

    def known(s):
        return F.when(s == 0, F.lit(default)).otherwise(s)

    return F.struct((length / known(max_speed)).alias("min_time"), (length / known(min_speed)).alias("max_time"))


def tariff_cost(rate: Column, length: Column, exchange: float = 1.0) -> Column:
    """P19."""
    return exchange * rate * length


def generalised_cost(time_cost: Column, tariff: Column, vehicles: float = 1 / TONS_PER_VEHICLE, tonnage: float = 1.0) -> Column:
    """P20."""
    return vehicles * time_cost + tonnage * tariff


def with_usage(cost: Column, factor: Column | float) -> Column:
    """Cost raised by a usage factor."""
    return (1 + factor) * cost


def order_pair(a: Column, b: Column) -> Column:
    """struct(lo, hi); two negatives are ordered by size, all else by value."""
    swap = F.when((a < 0) & (b < 0), F.abs(a) > F.abs(b)).otherwise(a > b)
    return F.struct(F.when(swap, b).otherwise(a).alias("lo"), F.when(swap, a).otherwise(b).alias("hi"))


def order_all_pairs(df: DataFrame) -> DataFrame:
    """P22 on every min_x, max_x pair of columns, in one projection."""
    stems = [c[4:] for c in df.columns if c.startswith("min_") and f"max_{c[4:]}" in df.columns]
    pair = {s: order_pair(F.col(f"min_{s}"), F.col(f"max_{s}")) for s in stems}
    new = {f"{side}_{s}": p[part] for s, p in pair.items() for side, part in (("min", "lo"), ("max", "hi"))}
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def exposure_percent(exposed_m: Column, length_km: Column) -> Column:
    """P24."""
    return F.when(length_km > 0, 100 * exposed_m / (1000 * length_km))


def clamp_exposure(exposed: Column, percent: Column, threshold: float) -> Column:
    """P25: struct(exposure, percent, weight): at most 100 percent; weight 1 from `threshold` metres on."""
    over = percent > 100
    length = F.when(over, 100 * exposed / percent).otherwise(exposed)
    return F.struct(length.alias("exposure"), F.when(over, 100.0).otherwise(percent).alias("percent"), F.least(F.lit(1.0), length / threshold).alias("weight"))


def failure_deltas(no_access: Column, new: Column, old: Column) -> Column:
    """What rerouting adds; nothing where access is lost."""
    return (1 - no_access) * (new - old)


def corrected_min_loss(min_tons: Column, max_tons: Column, min_loss: Column, max_loss: Column) -> Column:
    """P27."""
    return F.when((min_tons == max_tons) & (min_loss == 0) & (max_loss > 0), max_loss).otherwise(min_loss)


def eael_per_day(risk_weight: Column, impact: Column) -> Column:
    """Expected economic loss a day."""
    return risk_weight * impact


def ead(cost: Column, weight: Column, width: Column, bridge: bool = False) -> Column:
    """Expected damage; bridges take the risk weight and cost in millions."""
    return (1e6 if bridge else 1e3) * cost * weight * width / LANE_PAIR_WIDTH


def discount_sums(rate: Column | float, growth: Column | float, start: int, end: int, period: int) -> Column:
    """struct(plain, growing, periodic): sums over years start to end - 1 of 1/(1+r)^k, (1+g)^k/(1+r)^k,
    and of the plain factor every `period` years, the first left out."""
    rate = F.lit(rate) if not isinstance(rate, Column) else rate
    growth = F.lit(growth) if not isinstance(growth, Column) else growth
    years = F.sequence(F.lit(0), F.lit(end - start - 1))

    def total(of, at=years):
        return F.aggregate(at, F.lit(0.0), lambda s, k: s + of(k))

    every = F.filter(years, lambda k: (k > 0) & (k % period == 0))
    return F.struct(
        total(lambda k: 1 / F.pow(1 + rate, k)).alias("plain"),
        total(lambda k: F.pow(1 + growth, k) / F.pow(1 + rate, k)).alias("growing"),
        total(lambda k: 1 / F.pow(1 + rate, k), every).alias("periodic"),
    )


def adaptation_option(width: Column, surface: Column) -> Column:
    """The option's label by width band and surface."""
    lanes = F.lit("> 4L")
    for n in (4, 3, 2, 1):
        lanes = F.when(width <= n / 2 * LANE_PAIR_WIDTH, f"{n}L").otherwise(lanes)
    return F.concat(F.when(surface.contains("Hormigon"), "Upgrading to Concrete ").otherwise("Upgrading to Bituminous "), lanes)


def adaptation_costs(width: Column, surface: Column, exposed: Column, unit: dict[str, float], plain: Column, periodic: Column, bridge: bool = False) -> Column:
    """struct(option, initial, total, initial_per_km, total_per_km).

    unit: cost per km of two_lane_concrete, four_lane_concrete, two_lane_asphalt,
    routine and periodic. plain, periodic: sums of discount factors.
    """
    width = F.when(width == 0, LANE_PAIR_WIDTH).otherwise(width)
    share = width / LANE_PAIR_WIDTH
    wide = width > LANE_PAIR_WIDTH
    concrete = F.when(wide, unit["four_lane_concrete"] * width / (2 * LANE_PAIR_WIDTH)).otherwise(unit["two_lane_concrete"] * share)
    new = F.lit(unit["four_lane_concrete"]) if bridge else F.when(surface.contains("Hormigon"), concrete).otherwise(unit["two_lane_asphalt"] * share)
    upkeep = plain * unit["routine"] * share + periodic * unit["periodic"] * share
    initial = 1e6 * new if bridge else 1e3 * exposed * new
    per_km = 1e6 * new
    option = F.lit("Upgrading bridge") if bridge else adaptation_option(width, surface)
    return F.struct(option.alias("option"), initial.alias("initial"), (initial + 1e3 * exposed * upkeep).alias("total"), per_km.alias("initial_per_km"), (per_km + 1e6 * upkeep).alias("total_per_km"))


def benefits(damage: Column, loss_per_day: Column, duration: Column, plain: Column, growing: Column, cost: Column) -> Column:
    """struct(damages, losses, benefit, bc_ratio, bc_diff)."""
    damages, losses = plain * damage, loss_per_day * duration * growing
    benefit = damages + losses
    return F.struct(damages.alias("damages"), losses.alias("losses"), benefit.alias("benefit"), F.when(cost != 0, benefit / cost).alias("bc_ratio"), (benefit - cost).alias("bc_diff"))


def round_significant(x: Column, places: int = 1) -> Column:
    """Half-even rounding to significant figures; 0 stays 0."""
    digits = F.lit(places - 1) - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), digits)
    return F.when(x == 0, 0.0).otherwise(F.rint(x * scale) / scale)


def percent_change(now: Column, then: Column, sentinel: float = 1e9) -> Column:
    """0/0 is no change, x/0 the sentinel with x's sign."""
    diff = now - then
    return F.when((diff == 0) & (then == 0), 0.0).when(then == 0, F.signum(diff) * sentinel).otherwise(100 * diff / then)


def range_label(x: Column, classes=CHANGE_CLASSES) -> Column:
    """The label of the half-open range [lo, hi) that holds x; null in gaps."""
    out = F.lit(None).cast("string")
    for lo, hi, label in classes:
        out = F.when((x >= lo) & (x < hi), label).otherwise(out)
    return out


def score_band(x: Column, bands) -> Column:
    """How many of the ascending bounds x exceeds (right-closed bands)."""
    return sum((F.when(x > b, 1).otherwise(0) for b in bands), F.lit(0))


def clipped_change(df: DataFrame, change: str, current: str, least: float, bound: float = 100.0) -> DataFrame:
    """Keep rows whose current value is above `least`; clip the change."""
    return df.where(F.col(current) > least).withColumn(change, F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col(change))))


def within_extent(x: Column, y: Column, extent: tuple[float, float, float, float]) -> Column:
    """Strictly inside (x0, x1, y0, y1)."""
    x0, x1, y0, y1 = extent
    return (x > x0) & (x < x1) & (y > y0) & (y < y1)


def node_id(mode: str, code: Column) -> Column:
    """P39."""
    return F.concat(F.lit(f"{mode}_"), code.cast("string"))


def route_id(mode: str, origin: Column, destination: Column, corrections: dict[str, str] | None = None) -> Column:
    """mode_origin-destination, with record-level corrections of codes."""

    def right(code):
        return reduce(lambda c, r: F.when(code == r[0], r[1]).otherwise(c), (corrections or {}).items(), code)

    return F.concat(F.lit(f"{mode}_"), right(origin), F.lit("-"), right(destination))


def carries_risk(*values: Column) -> Column:
    """The sum of values (impacts, EAEL and EAD) is above 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(v, F.lit(0.0)) for v in values)) > 0


def return_period(probability: Column) -> Column:
    """P41."""
    return F.when(probability > 0, 1 / probability)


def total_risk(df: DataFrame, durations: list[int], eael: str = "eael", damage: str = "ead") -> DataFrame:
    """A row for each duration with duration x EAEL + EAD."""
    days = F.explode(F.array(*(F.lit(d) for d in durations)))
    return df.withColumn("duration", days).withColumn("total_risk", F.col("duration") * F.col(eael) + F.col(damage))


def operational_state(edges: DataFrame, flow_nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """A link is operational if either end carries flow. flow_nodes: distinct ids."""
    ends = [flow_nodes.select(F.col(node).alias(c), F.lit(True).alias(f"_{c}")) for c in ("from_node", "to_node")]
    out = edges.join(ends[0], "from_node", "left").join(ends[1], "to_node", "left")
    on = F.coalesce(F.col("_from_node"), F.lit(False)) | F.coalesce(F.col("_to_node"), F.lit(False))
    return out.withColumn("operation_state", F.when(on, "operational").otherwise("not operational")).drop("_from_node", "_to_node")
