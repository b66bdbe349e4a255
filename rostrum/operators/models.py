"""Spatial-interaction and fiscal models: intervals, power-law terms, destination choice, capture, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import bind

# Fixed values: (value, low, high) of the models' assumptions.
ASSUMPTIONS = {
    "occupancy_rate": (0.95, 0.90, 0.97),
    "avg_hh_size_multifamily": (1.8, 1.5, 2.2),
    "income_premium_new_construction": (1.125, 1.0, 1.25),
    "ces_scale": (1.0, 0.85, 1.15),
    "beta_walk": (0.10, 0.05, 0.15),
    "beta_bike": (0.10, 0.05, 0.15),
    "walk_share_neighborhood": (0.60, 0.40, 0.80),
    "walk_share_comparison": (0.10, 0.0, 0.30),
    "walk_share_grocery_entertainment": (0.30, 0.10, 0.50),
    "bike_share_neighborhood": (0.02, 0.005, 0.05),
    "bike_share_comparison": (0.005, 0.0, 0.02),
    "bike_share_grocery_entertainment": (0.01, 0.0, 0.03),
    "walk_trips_per_resident_day": (1.0, 0.5, 2.0),
    "sqft_per_office_job": (350, 250, 500),
    "sqft_per_retail_job": (500, 400, 700),
    "own_retail_sqft_per_equiv_poi": (2000, 1500, 3000),
    "commercial_value_per_sqft": (275, 200, 400),
    "students_per_unit": (0.10, 0.05, 0.15),
    "marginal_cost_factor": (0.40, 0.25, 0.60),
    "vehicles_per_household": (1.4, 1.0, 1.8),
    "avg_vehicle_assessed_value": (14000, 9000, 20000),
    "retail_sales_per_sqft": (400, 250, 600),
    "bike_trips_per_resident_day": (0.035, 0.02, 0.05),
    "induced_corridor_visit_share": (0.10, 0.03, 0.20),
    "bike_spend_restaurant": (12, 8, 17),
    "bike_spend_convenience": (8, 5, 11),
    "bike_spend_other": (10, 5, 20),
    "beta_trail_access_km": (0.333, 0.25, 0.45),
    "trail_user_days_per_capita": (12, 6, 20),
    "trail_spend_per_user_day": (7.5, 6, 11),
    "trail_property_premium": (0.03, 0.0, 0.05),
}
#: Annual dollars of a consumer unit and income elasticity by category, and the income they belong to.
SPENDING = {"grocery": (5703, 0.45), "restaurant_bar": (3933, 0.85), "retail_comparison": (4649, 0.95), "retail_convenience": (950, 0.60), "personal_services": (1100, 0.90), "entertainment": (3635, 1.05)}
MEAN_INCOME = 101805
BETA_DRIVE = 0.15
CITY = {"real_estate_rate": 1.0725, "meals_rate": 0.045, "sales_rate": 0.01, "personal_property_rate": 4.13, "business_rate": 0.20, "general_fund": 207912496, "population": 25026, "education": 76429791, "enrollment": 3103, "state_school": 14492271}
# End of the fixed values.


def interval(value, low=None, high=None) -> Column:
    c = lambda x: x.cast("double") if isinstance(x, Column) else F.lit(float(x))
    return F.struct(c(value).alias("value"), c(value if low is None else low).alias("low"), c(value if high is None else high).alias("high"))


def assumed(name: str) -> Column:
    return interval(*ASSUMPTIONS[name])


def _both(a: Column, b: Column, body) -> Column:
    """body of two intervals, each evaluated once: nested operations would double their expressions at every level."""
    return bind(a, lambda x: bind(b, lambda y: body(x, y)))


def add(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: interval(x["value"] + y["value"], x["low"] + y["low"], x["high"] + y["high"]))


def sub(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: interval(x["value"] - y["value"], x["low"] - y["high"], x["high"] - y["low"]))


def _corners(a: Column, b: Column, op) -> list[Column]:
    return [op(a[x], b[y]) for x in ("low", "high") for y in ("low", "high")]


def mul(a: Column, b: Column) -> Column:
    def body(x: Column, y: Column) -> Column:
        c = _corners(x, y, lambda p, q: p * q)
        return interval(x["value"] * y["value"], F.least(*c), F.greatest(*c))

    return _both(a, b, body)


def div(a: Column, b: Column) -> Column:
    """a / b; reading a row whose divisor's range holds zero fails."""

    def body(x: Column, y: Column) -> Column:
        c = _corners(x, y, F.try_divide)
        bad = (y["low"] <= 0) & (y["high"] >= 0)
        value = F.when(bad, F.raise_error(F.lit("interval division by a range with zero")).cast("double")).otherwise(F.try_divide(x["value"], y["value"]))
        return interval(value, F.least(*c), F.greatest(*c))

    return _both(a, b, body)


def scale(a: Column, k) -> Column:
    return mul(a, interval(k))


def power(a: Column, exponent: float) -> Column:
    if exponent < 0:
        raise ValueError("interval power: exponents from 0")

    def body(x: Column) -> Column:
        value = F.when(x["low"] <= 0, F.raise_error(F.lit("interval power of a base that isn't positive")).cast("double")).otherwise(F.pow(x["value"], F.lit(exponent)))
        return interval(value, F.pow(x["low"], F.lit(exponent)), F.pow(x["high"], F.lit(exponent)))

    return bind(a, body)


def in_order(a: Column) -> Column:
    return (a["low"] <= a["value"]) & (a["value"] <= a["high"])


def terms_value(terms: Column, now: Column, at: Column) -> Column:
    """Sum over terms (value, exps: assumption -> exponent) of value * product of (now / at) ** exponent."""
    factor = lambda t: F.aggregate(F.map_entries(t["exps"]), F.lit(1.0), lambda p, e: p * F.pow(F.try_element_at(now, e["key"]) / F.try_element_at(at, e["key"]), e["value"]))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["value"] * factor(t))


def utility(attractiveness: Column, minutes: Column, alpha: float, beta: Column | float) -> Column:
    beta = beta if isinstance(beta, Column) else F.lit(float(beta))
    return F.when(attractiveness > 0, F.pow(attractiveness, F.lit(alpha)) * F.exp(-beta * minutes)).otherwise(0.0)


def share_of(value: Column, by: list[str]) -> Column:
    total = F.sum(value).over(Window.partitionBy(*by))
    return F.when(total > 0, value / total).otherwise(0.0)


def huff(df: DataFrame, by: list[str], minutes: str, alpha: float = 1.0, beta: float = 0.10, out: str = "p") -> DataFrame:
    """Choice probabilities over each origin's destinations; an origin that reaches nothing has zeros."""
    return df.withColumn(out, share_of(utility(F.col("attractiveness"), F.col(minutes), alpha, beta), by))


def blended(df: DataFrame, by: list[str], walk_share: float, beta_walk: float = 0.10, beta_drive: float = BETA_DRIVE) -> DataFrame:
    """Walk and drive choices blended by share; where one mode reaches nothing the other stands alone."""
    both = huff(huff(df, by, "walk_min", beta=beta_walk, out="_w"), by, "drive_min", beta=beta_drive, out="_d")
    w = Window.partitionBy(*by)
    none = lambda c: F.sum(c).over(w) == 0
    return both.withColumn("p", F.when(none("_w"), F.col("_d")).when(none("_d"), F.col("_w")).otherwise(walk_share * F.col("_w") + (1 - walk_share) * F.col("_d"))).drop("_w", "_d")


def joint_modes(df: DataFrame, by: list[str], modes: dict[str, tuple[Column | float, Column | float, str]], alpha: float = 1.0) -> DataFrame:
    """p_<mode> for each mode (preference, beta, column of minutes): one choice over destinations and modes together."""
    for m, (pref, beta, minutes) in modes.items():
        df = df.withColumn(f"_u_{m}", (pref if isinstance(pref, Column) else F.lit(float(pref))) * utility(F.col("attractiveness"), F.col(minutes), alpha, beta))
    total = F.sum(sum(F.col(f"_u_{m}") for m in modes)).over(Window.partitionBy(*by))
    for m in modes:
        df = df.withColumn(f"p_{m}", F.when(total > 0, F.col(f"_u_{m}") / total).otherwise(0.0))
    return df.withColumn("p", sum(F.col(f"p_{m}") for m in modes)).drop(*[f"_u_{m}" for m in modes])


GROUP_OF = {"grocery": "grocery_entertainment", "entertainment": "grocery_entertainment", "retail_comparison": "comparison"}


def capture(destinations: DataFrame, spend: dict[str, tuple[float, float, float]]) -> DataFrame:
    """(origin, category, slot, dest, dollars, walk, bike, in_city) for slots value, low and high: shares and dollars go low
    for low, distance decay high for low."""
    slots = {"value": (0, 0), "low": (1, 2), "high": (2, 1)}
    rows = []
    for c, amounts in spend.items():
        g = GROUP_OF.get(c, "neighborhood")
        for s, (i, j) in slots.items():
            walk, bike = ASSUMPTIONS[f"walk_share_{g}"][i], ASSUMPTIONS[f"bike_share_{g}"][i]
            rows.append((c, s, float(amounts[i]), float(walk), float(bike), float(1 - walk - bike), float(ASSUMPTIONS["beta_walk"][j]), float(ASSUMPTIONS["beta_bike"][j])))
    grid = destinations.sparkSession.createDataFrame(rows, "category string, slot string, spend double, s_walk double, s_bike double, s_drive double, b_walk double, b_bike double")
    every = destinations.crossJoin(F.broadcast(grid))  # 18 rows
    modes = {"walk": (F.col("s_walk"), F.col("b_walk"), "walk_min"), "bike": (F.col("s_bike"), F.col("b_bike"), "bike_min"), "drive": (F.col("s_drive"), BETA_DRIVE, "drive_min")}
    out = joint_modes(every, ["origin", "category", "slot"], modes)
    dollars = lambda c: (F.col("spend") * F.col(c))
    return out.select("origin", "category", "slot", "dest", "in_city", dollars("p").alias("dollars"), dollars("p_walk").alias("walk"), dollars("p_bike").alias("bike"))


def in_city_share(captured: DataFrame) -> DataFrame:
    """(origin, value, low, high): the share of dollars that stays in the city, its bounds over the slots."""
    per = captured.groupBy("origin", "slot").agg((F.coalesce(F.try_divide(F.sum(F.when(F.col("in_city"), F.col("dollars")).otherwise(0.0)), F.sum("dollars")), F.lit(0.0))).alias("s"))
    return per.groupBy("origin").agg(F.max(F.when(F.col("slot") == "value", F.col("s"))).alias("value"), F.min("s").alias("low"), F.max("s").alias("high"))


def demand(sites: DataFrame) -> DataFrame:
    """sites (site, units, income) with households, residents and spend by category, all intervals."""
    households = mul(interval(F.col("units")), assumed("occupancy_rate"))
    df = sites.withColumn("households", households).withColumn("residents", mul(F.col("households"), assumed("avg_hh_size_multifamily")))
    income = mul(interval(F.col("income")), assumed("income_premium_new_construction"))
    df = df.withColumn("ratio", scale(income, 1 / MEAN_INCOME))
    for c, (dollars, elasticity) in SPENDING.items():
        df = df.withColumn(f"spend_{c}", mul(mul(scale(F.col("households"), dollars), power(F.col("ratio"), elasticity)), assumed("ces_scale")))
    return df.drop("ratio")


def fiscal(sites: DataFrame) -> DataFrame:
    """sites (site, units, value, office_sqft, retail_sqft, residents, households) with revenue, costs in both framings and
    the net range: its low end sets the least revenue against the dearest framing, its high end the reverse."""
    office = scale(interval(F.col("office_sqft")), 1)
    property_ = scale(interval(F.col("value")), CITY["real_estate_rate"] / 100)
    commercial = scale(mul(interval(F.col("office_sqft") + F.col("retail_sqft")), assumed("commercial_value_per_sqft")), CITY["real_estate_rate"] / 100)
    vehicles = scale(mul(mul(F.col("households"), assumed("vehicles_per_household")), assumed("avg_vehicle_assessed_value")), CITY["personal_property_rate"] / 100)
    sales = mul(interval(F.col("retail_sqft")), assumed("retail_sales_per_sqft"))
    df = sites.withColumn("revenue", add(add(property_, commercial), add(vehicles, add(scale(sales, CITY["sales_rate"]), scale(sales, CITY["business_rate"] / 100)))))
    pupil = (CITY["education"] - CITY["state_school"]) / CITY["enrollment"]
    each = (CITY["general_fund"] - CITY["education"]) / CITY["population"]
    students = scale(mul(interval(F.col("units")), assumed("students_per_unit")), pupil)
    df = df.withColumn("naive", add(scale(F.col("residents"), each), students)).withColumn("marginal", add(mul(scale(F.col("residents"), each), assumed("marginal_cost_factor")), students))
    r, a, b = F.col("revenue"), F.col("naive"), F.col("marginal")
    df = df.withColumn("jobs", F.when(F.col("office_sqft") > 0, div(office, assumed("sqft_per_office_job"))).otherwise(interval(0)))
    return df.withColumn("net", interval(r["value"] - (a["value"] + b["value"]) / 2, r["low"] - a["high"], r["high"] - b["low"]))


def bike_lane(corridors: DataFrame) -> DataFrame:
    """corridors (corridor, residents, restaurant_share, convenience_share) with trips and spend a year, intervals."""
    trips = scale(mul(mul(interval(F.col("residents")), assumed("bike_trips_per_resident_day")), assumed("induced_corridor_visit_share")), 365)
    other = 1 - F.col("restaurant_share") - F.col("convenience_share")
    each = add(add(scale(assumed("bike_spend_restaurant"), F.col("restaurant_share")), scale(assumed("bike_spend_convenience"), F.col("convenience_share"))), scale(assumed("bike_spend_other"), other))
    return corridors.withColumn("trips", trips).withColumn("spend", mul(F.col("trips"), each))


def trail(blocks: DataFrame) -> DataFrame:
    """(access, users, user_days, spend, premium) of each access point from blocks (access, km, pop, assessed): population
    decays with distance, steeper for the low end."""
    v, lo, hi = ASSUMPTIONS["beta_trail_access_km"]
    near = lambda beta: F.sum(F.col("pop") * F.exp(-beta * F.col("km")))
    out = blocks.groupBy("access").agg(near(v).alias("v"), near(hi).alias("l"), near(lo).alias("h"), F.sum(F.when(F.col("km") <= 0.4, F.col("assessed")).otherwise(0.0)).alias("assessed"))
    out = out.withColumn("users", interval(F.col("v"), F.col("l"), F.col("h"))).withColumn("user_days", mul(F.col("users"), assumed("trail_user_days_per_capita")))
    out = out.withColumn("spend", mul(F.col("user_days"), assumed("trail_spend_per_user_day"))).withColumn("premium", mul(interval(F.col("assessed")), assumed("trail_property_premium")))
    return out.select("access", "users", "user_days", "spend", "premium")


def sensitivity(df: DataFrame, key: list[str], base: Column, at: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, assumption, swing): assumptions by how far the result moves between their bounds, largest first."""
    rows = F.array(*[F.struct(F.lit(k).alias("assumption"), F.abs(h - lo).alias("swing")) for k, (lo, h) in at.items()])
    return df.select(*key, base.alias("result"), F.inline(rows))


def check_terms(df: DataFrame, value: Column, terms: Column, now: Column, at: Column) -> DataFrame:
    """df, but reading a row whose terms don't add up to its value fails."""
    from rostrum.operators.relational import require

    return require(df, F.abs(terms_value(terms, now, at) - value) <= F.greatest(1e-6 * F.abs(value), F.lit(0.51)), "terms don't add up to the value")
