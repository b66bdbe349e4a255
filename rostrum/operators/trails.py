"""What bike corridors and trails bring to the businesses and parcels around them, for a table of lines at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators import graph as G
from rostrum.operators import models as Z
from rostrum.operators import polygons as P
from rostrum.operators.spatial import thin_along

# Distances are in the maps' unit, metres unless the maps say otherwise.
NODE_BUFFER = 50.0
SHOP_BUFFER = 100.0
ACCESS_SPACING = 250.0
MOST_ACCESS_POINTS = 40
PREMIUM_BAND = 1650.0 / 3.28084
WALK_MIN_PER_M = 60.0 / 4.8 / 1000.0
DIAGNOSTIC_SALES = 2000.0 * 400.0
MOST_UPLIFT = 0.50
SPEND_GROUP = {"restaurant_bar": "restaurant", "retail_convenience": "convenience"}
GROUP_SPENDING = {"restaurant": "bike_spend_restaurant", "convenience": "bike_spend_convenience", "other_retail": "bike_spend_other"}
# End of the fixed values.


def spend_group(taxonomy: Column) -> Column:
    out = F.lit("other_retail")
    for kind, group in SPEND_GROUP.items():
        out = F.when(taxonomy == kind, group).otherwise(out)
    return out


def decayed(weight: Column, distance: Column, assumption: str) -> list[Column]:
    """Sums v, l, h of weight * exp(-beta * distance): a steeper decay makes the low end."""
    value, low, high = Z.ASSUMPTIONS[assumption]
    return [F.sum(weight * F.exp(-float(b) * distance)).alias(n) for n, b in (("v", value), ("l", high), ("h", low))]


def bike_corridors(corridors: DataFrame, nodes: DataFrame, edges: DataFrame, blocks: DataFrame, shops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((corridor, nodes, shops, catchment, visits, spending, uplift, note), (corridor, shop, spend_group, dollars)).

    corridors: corridor, path; nodes: node, x, y; edges: u, v, minutes by bike; blocks: node, pop; shops: shop, taxonomy, x, y, retail
    ones only. The catchment is all people, by their minutes from the corridor's nearest node; the visits it induces are spread
    over the groups of the shops beside the corridor by their number, and evenly inside a group. catchment, visits a day,
    spending a year and uplift are intervals. A corridor that no node is beside has a note and nothing else; one without shops has
    no spending. uplift, new spending against a rough baseline, is flagged where it is over MOST_UPLIFT."""
    starts = P.near_lines(nodes, corridors, "node", "corridor", NODE_BUFFER).select(F.col("corridor").alias("source"), "node")
    starts = G.cut_lineage(starts)
    ways = G.shortest(edges, starts)
    near = ways.join(blocks, "node").groupBy(F.col("source").alias("corridor")).agg(*decayed(F.col("pop"), F.col("minutes"), "beta_bike"))
    counts = starts.groupBy(F.col("source").alias("corridor")).agg(F.count(F.lit(1)).alias("nodes"))
    beside = P.near_lines(shops, corridors, "shop", "corridor", SHOP_BUFFER).select("corridor", "shop").join(shops.select("shop", spend_group(F.col("taxonomy")).alias("spend_group")), "shop")
    groups = beside.groupBy("corridor", "spend_group").agg(F.count(F.lit(1)).alias("members"))
    totals = groups.groupBy("corridor").agg(F.sum("members").alias("shops"), F.map_from_entries(F.collect_list(F.struct("spend_group", "members"))).alias("mix"))
    out = corridors.select("corridor").join(counts, "corridor", "left").join(near, "corridor", "left").join(totals, "corridor", "left")
    touched = F.col("nodes").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumn("catchment", F.when(touched, Z.interval(zero(F.col("v")), zero(F.col("l")), zero(F.col("h")))))
    out = out.withColumn("visits", F.when(touched, Z.mul(Z.mul(F.col("catchment"), Z.assumed("bike_trips_per_resident_day")), Z.assumed("induced_corridor_visit_share"))))
    share = lambda g: F.coalesce(F.try_element_at("mix", F.lit(g)), F.lit(0)) / F.col("shops")
    of_group = {g: Z.mul(Z.mul(F.col("visits"), Z.interval(share(g) * 365)), Z.assumed(a)) for g, a in GROUP_SPENDING.items()}
    paid = F.array(*[F.struct(F.lit(g).alias("spend_group"), v.alias("dollars")) for g, v in of_group.items()])
    out = out.withColumn("paid", F.when(touched & F.col("shops").isNotNull(), paid))
    total = lambda c: F.aggregate(F.transform("paid", lambda p: p["dollars"][c]), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("spending", F.when(F.col("paid").isNotNull(), Z.interval(total("value"), total("low"), total("high"))))
    out = out.withColumn("uplift", F.when(F.col("spending").isNotNull(), Z.mul(F.col("spending"), Z.interval(1 / (F.col("shops") * DIAGNOSTIC_SALES)))))
    note = F.when(~touched, "the corridor touches no nodes").when(F.col("shops").isNull(), "no retail beside the corridor").when(F.col("uplift.value") > MOST_UPLIFT, "implied uplift is beyond what corridors have shown")
    out = G.cut_lineage(out.withColumn("note", note))
    each = out.select("corridor", F.inline("paid"), "mix").withColumn("members", F.try_element_at("mix", F.col("spend_group"))).where("members is not null")
    each = each.select("corridor", "spend_group", Z.mul(F.col("dollars"), Z.interval(1 / F.col("members"))).alias("dollars"))
    return out.select("corridor", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.when(touched, F.coalesce("shops", F.lit(0))).alias("shops"), "catchment", "visits", "spending", "uplift", "note"), beside.join(each, ["corridor", "spend_group"])


def access_points(trails: DataFrame, nodes: DataFrame) -> DataFrame:
    """(trail, node, along): the nodes beside each trail, one for each ACCESS_SPACING of its length, evenly thinned to
    MOST_ACCESS_POINTS; of nodes at one place the smallest."""
    beside = P.near_lines(nodes, trails, "node", "trail", NODE_BUFFER)
    kept = thin_along(beside, "trail", "along", ACCESS_SPACING)
    own = beside.join(kept, ["trail", "along"]).groupBy("trail", "along").agg(F.min("node").alias("node"))
    every = Window.partitionBy("trail")  # no more rows than a trail's length allows
    own = own.withColumn("r", F.row_number().over(every.orderBy("along")) - 1).withColumn("n", F.count(F.lit(1)).over(every))
    i = F.ceil(F.col("r") * MOST_ACCESS_POINTS / F.col("n"))
    even = (F.col("n") <= MOST_ACCESS_POINTS) | ((i < MOST_ACCESS_POINTS) & (F.floor(i * F.col("n") / MOST_ACCESS_POINTS) == F.col("r")))
    return own.where(even).select("trail", "node", "along")


def trails(lines: DataFrame, nodes: DataFrame, edges: DataFrame, blocks: DataFrame, shops: DataFrame, parcels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((trail, access, catchment, user_days, spending, parcels, assessed, uplift, tax, note), (trail, shop, dollars)).

    lines: trail, path; nodes: node, x, y; edges: u, v, length; blocks: block, node, pop; shops: shop, node, retail ones only; parcels: pin,
    rings, assessed. People belong to the access point nearest on foot, the first along the trail of equal ones. What the trail's
    users spend goes out from the access points by their share of the catchment and from there to shops by how long the walk is.
    The premium is on parcels that reach into PREMIUM_BAND of the line. A trail that no node is beside has a note, no catchment and
    no spending."""
    access = G.cut_lineage(access_points(lines, nodes))
    ways = G.shortest(edges.select("u", "v", F.col("length").alias("minutes")), access.select(F.col("node").alias("source")).distinct())
    ways = ways.select(F.col("source").alias("access"), "node", F.col("minutes").alias("metres"))
    reached = access.select("trail", F.col("node").alias("access"), "along").join(ways, "access")
    home = reached.join(blocks, "node").groupBy("trail", "block").agg(F.min(F.struct("metres", "along", "access")).alias("b"), F.first("pop").alias("pop"))
    home = G.cut_lineage(home.select("trail", "b.access", (F.col("b.metres") / 1000).alias("km"), "pop"))
    people = home.groupBy("trail", "access").agg(*decayed(F.col("pop"), F.col("km"), "beta_trail_access_km"))
    sums = people.groupBy("trail").agg(*[F.sum(c).alias(c) for c in "vlh"])
    shares = people.join(sums.select("trail", F.col("v").alias("all")), "trail").where("v > 0").select("trail", "access", (F.col("v") / F.col("all")).alias("share"))
    walk = reached.join(shops.select("shop", "node"), "node").select("trail", "access", "shop", (F.col("metres") * WALK_MIN_PER_M).alias("t"))
    value, low, high = Z.ASSUMPTIONS["beta_walk"]
    betas = {"value": value, "low": high, "high": low}
    pulls = walk.select("trail", "access", "shop", *[F.exp(-float(b) * F.col("t")).alias(s) for s, b in betas.items()])
    every = pulls.groupBy("trail", "access").agg(*[F.sum(s).alias(f"_{s}") for s in betas])
    chosen = pulls.join(every, ["trail", "access"]).join(shares, ["trail", "access"]).groupBy("trail", "shop").agg(*[F.sum(F.col("share") * F.col(s) / F.col(f"_{s}")).alias(s) for s in betas])
    band = P.in_band(parcels, lines.select(F.col("trail").alias("line"), "path"), "pin", "line", PREMIUM_BAND).join(parcels.select("pin", "assessed"), "pin")
    premium = band.groupBy(F.col("line").alias("trail")).agg(F.count(F.lit(1)).alias("parcels"), F.sum("assessed").alias("assessed"))
    points = access.groupBy("trail").agg(F.count(F.lit(1)).alias("access"))
    out = lines.select("trail").join(points, "trail", "left").join(sums, "trail", "left").join(premium, "trail", "left")
    touched = F.col("access").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumn("catchment", F.when(touched, Z.interval(zero(F.col("v")), zero(F.col("l")), zero(F.col("h")))))
    out = out.withColumn("user_days", F.when(touched, Z.mul(F.col("catchment"), Z.assumed("trail_user_days_per_capita"))))
    out = out.withColumn("spending", F.when(touched, Z.mul(F.col("user_days"), Z.assumed("trail_spend_per_user_day"))))
    out = out.withColumn("uplift", F.when(touched & (F.col("assessed") > 0), Z.mul(Z.interval(F.col("assessed")), Z.assumed("trail_property_premium"))))
    out = out.withColumn("tax", F.when(F.col("uplift").isNotNull(), Z.scale(F.col("uplift"), Z.CITY["real_estate_rate"] / 100)))
    out = G.cut_lineage(out.withColumn("note", F.when(~touched, "the trail touches no nodes")))
    dollars = Z.interval(*[F.col(s) * F.col(f"spending.{s}") for s in ("value", "low", "high")])
    each = chosen.join(out.select("trail", "spending"), "trail").select("trail", "shop", dollars.alias("dollars"))
    return out.select("trail", F.coalesce("access", F.lit(0)).alias("access"), "catchment", "user_days", "spending", F.coalesce("parcels", F.lit(0)).alias("parcels"), "assessed", "uplift", "tax", "note"), each
