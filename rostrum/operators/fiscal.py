"""What a project brings and costs a city a year: every metric a row, with its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.operators import models as Z
from rostrum.operators.relational import exclusive_quantile

#: Years back that a comparable building may have been built.
LOOK_BACK_YEARS = 15
#: With fewer comparable buildings nothing is projected.
FEWEST_COMPS = 3
#: Metrics of the economic module that this one builds on, by the names they are looked up by.
PRIOR = {"households": "New households", "residents": "New residents", "dining": "New annual spending: restaurant_bar", "grocery": "New annual spending: grocery", "comparison": "New annual spending: retail_comparison", "convenience": "New annual spending: retail_convenience", "food_share": "In-city capture share: food_away", "retail_share": "In-city capture share: all_retail"}
INCREASE, PROJECTED = "Real estate tax increase", "Projected real estate tax"


def comps_summary(comps: DataFrame, year: int) -> DataFrame:
    """One row (n, median, q1, q3) of the value a unit of comps (pin, year_built, per_unit_value) built since LOOK_BACK_YEARS before
    the year; quartiles are exclusive ones, from four comps on, else the least and the greatest. n is 0 of none."""
    own = comps.where((F.col("year_built") >= year - LOOK_BACK_YEARS) & F.col("per_unit_value").isNotNull()).select(F.lit(1).alias("all"), F.col("per_unit_value").cast("double").alias("x"))
    ends = own.groupBy("all").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.expr("percentile(x, 0.5)").alias("median"))
    for q, name in ((0.25, "q1"), (0.75, "q3")):
        ends = ends.join(exclusive_quantile(own, ["all"], "x", q, name), "all")
    some = ends.select("n", "median", F.when(F.col("n") >= 4, F.col("q1")).otherwise(F.col("lo")).alias("q1"), F.when(F.col("n") >= 4, F.col("q3")).otherwise(F.col("hi")).alias("q3"))
    return own.sparkSession.range(1).join(some, F.lit(True), "left").select(F.coalesce("n", F.lit(0)).alias("n"), "median", "q1", "q3")  # one row each


def prior_of(found: DataFrame) -> DataFrame:
    """(site, the names of PRIOR as intervals) of metrics (site, metric, value, low, high); a missing bound is the value."""
    value = F.struct(F.col("value").cast("double").alias("value"), F.coalesce("low", "value").cast("double").alias("low"), F.coalesce("high", "value").cast("double").alias("high"))
    wide = found.groupBy("site").pivot("metric", list(PRIOR.values())).agg(F.first(value))
    return wide.select("site", *[F.col(f"`{m}`").alias(c) for c, m in PRIOR.items()])


def demand_basis(sites: DataFrame) -> DataFrame:
    """(site, metric, value, low, high): the households and residents of sites (site, units), as the economic module tells them."""
    households = Z.mul(Z.interval(F.col("units")), Z.assumed("occupancy_rate"))
    rows = F.array(F.struct(F.lit(PRIOR["households"]).alias("metric"), households.alias("v")), F.struct(F.lit(PRIOR["residents"]).alias("metric"), Z.mul(households, Z.assumed("avg_hh_size_multifamily")).alias("v")))
    return sites.select("site", F.inline(rows)).select("site", "metric", "v.value", "v.low", "v.high")


def total(parts: list[Column]) -> Column:
    """The sum of the intervals that are there; null of none."""
    zero = Z.interval(0)
    out = parts[0]
    for p in parts[1:]:
        out = F.when(out.isNull() & p.isNull(), F.lit(None)).otherwise(Z.add(F.coalesce(out, zero), F.coalesce(p, zero)))
    return out


def fiscal_metrics(sites: DataFrame, comps: DataFrame, prior: DataFrame, year: int, rates: dict[str, float | None] | None = None) -> DataFrame:
    """(site, metric, value, low, high) of sites (site, units, acres, assessed_value, retail_sqft).

    comps: pin, year_built, per_unit_value; prior: what the economic module found (site, metric, value, low, high). rates replace those
    of the city; one that is None isn't known. What a metric needs and isn't there leaves it out, and what adds up goes on
    without it. School costs follow the project's own students where the city's school figures are known, else the average cost
    of a resident holds them. The net takes the rise in real estate tax, or the whole of it where the present value isn't
    known; its range sets the least revenue against the dearest framing, and the reverse."""
    rate = Z.CITY | {"personal_property_per_household": None} | (rates or {})
    known = lambda *names: all(rate.get(n) is not None for n in names)
    none = F.lit(None).cast("struct<value:double,low:double,high:double>")
    when = lambda condition, value: F.when(condition, value)
    have = lambda *names: F.lit(True) if not names else F.col(names[0]).isNotNull() & have(*names[1:])
    df = sites.join(prior_of(prior), "site", "left").crossJoin(F.broadcast(comps_summary(comps, year)))  # one row
    tax = (rate["real_estate_rate"] or 0) / 100
    point = lambda c: Z.interval(F.col(c))
    m: dict[str, Column] = {}

    def put(name: str, condition: Column, value: Column) -> None:
        nonlocal df
        column = f"m{len(m)}"
        df = df.withColumn(column, when(condition, value))
        m[name] = F.col(column)

    priced = F.lit(known("real_estate_rate"))
    acres = F.col("acres") > 0
    put("Current real estate tax (site)", priced & have("assessed_value"), Z.scale(point("assessed_value"), tax))
    put("Current value per acre", priced & have("assessed_value") & acres, Z.interval(F.try_divide("assessed_value", "acres")))
    built = (F.col("units") > 0) & (F.col("n") >= FEWEST_COMPS)
    homes = Z.interval(F.col("median") * F.col("units"), F.col("q1") * F.col("units"), F.col("q3") * F.col("units"))
    shops = Z.mul(Z.interval(F.coalesce("retail_sqft", F.lit(0))), Z.assumed("commercial_value_per_sqft"))
    put("Projected assessed value", built, Z.add(homes, shops))
    value = m["Projected assessed value"]
    put(PROJECTED, priced & value.isNotNull(), Z.scale(value, tax))
    put(INCREASE, m[PROJECTED].isNotNull() & have("assessed_value"), Z.sub(m[PROJECTED], Z.scale(point("assessed_value"), tax)))
    put("Projected value per acre", value.isNotNull() & acres, Z.mul(value, Z.interval(F.try_divide(F.lit(1.0), F.col("acres")))))
    each = rate["personal_property_per_household"]
    if each is not None:
        put("Personal property tax (new households)", have("households"), Z.scale(F.col("households"), each))
    else:
        cars = Z.mul(Z.mul(F.col("households"), Z.assumed("vehicles_per_household")), Z.assumed("avg_vehicle_assessed_value"))
        put("Personal property tax on resident vehicles (rough estimate)", F.lit(known("personal_property_rate")) & have("households"), Z.scale(cars, (rate["personal_property_rate"] or 0) / 100))
    receipts = Z.mul(Z.interval(F.coalesce("retail_sqft", F.lit(0))), Z.assumed("retail_sales_per_sqft"))
    put("BPOL business license tax on project retail (rough estimate)", F.lit(known("business_rate")) & (F.col("retail_sqft") > 0), Z.scale(receipts, (rate["business_rate"] or 0) / 100))
    put("Meals tax on captured in-city dining", F.lit(known("meals_rate")) & have("dining", "food_share"), Z.scale(Z.mul(F.col("dining"), F.col("food_share")), rate["meals_rate"] or 0))
    spent = Z.add(Z.add(F.col("grocery"), F.col("comparison")), F.col("convenience"))
    put("Local sales tax share on captured in-city retail", F.lit(known("sales_rate")) & have("grocery", "comparison", "convenience", "retail_share"), Z.scale(Z.mul(spent, F.col("retail_share")), rate["sales_rate"] or 0))
    recurring = list(m)[6:]
    costed = F.lit(known("general_fund", "population")) & have("residents")
    put("Estimated K-12 students", costed, Z.mul(Z.interval(F.coalesce("units", F.lit(0))), Z.assumed("students_per_unit")))
    students = m["Estimated K-12 students"]
    naive, marginal = "Annual service cost — naive per-capita method", "Annual service cost — marginal framing"
    if known("education", "enrollment") and known("general_fund", "population"):
        pupil = (rate["education"] - (rate["state_school"] or 0)) / rate["enrollment"]
        put("Annual school cost within the service-cost estimates", costed, Z.scale(students, pupil))
        school = m["Annual school cost within the service-cost estimates"]
        people = Z.scale(F.col("residents"), (rate["general_fund"] - rate["education"]) / rate["population"])
        put(naive, costed, Z.add(people, school))
        put(marginal, costed, Z.add(Z.mul(people, Z.assumed("marginal_cost_factor")), school))
    elif known("general_fund", "population"):
        put(naive, costed, Z.scale(F.col("residents"), rate["general_fund"] / rate["population"]))
        put(marginal, costed, Z.mul(m[naive], Z.assumed("marginal_cost_factor")))
    if naive in m:
        df = df.withColumn("revenue", total([F.coalesce(m[INCREASE], m[PROJECTED], none), *[m[k] for k in recurring]]))
        r, both = F.col("revenue"), have("revenue") & m[naive].isNotNull()
        put("Net annual fiscal impact — naive per-capita method", both, Z.sub(r, m[naive]))
        put("Net annual fiscal impact — marginal framing", both, Z.sub(r, m[marginal]))
        middle = r["value"] - (m[naive]["value"] + m[marginal]["value"]) / 2
        put("Net annual fiscal impact (range across both cost methods)", both, Z.interval(F.round(middle), F.round(r["low"] - m[naive]["high"]), F.round(r["high"] - m[marginal]["low"])))
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), c.alias("v")) for k, c in m.items()])
    out = df.select("site", F.inline(rows)).where("v is not null")
    return out.select("site", "metric", "v.value", "v.low", "v.high")
