"""Corridors: the stretch of a named street that a document means, for a table of requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import street_key
from rostrum.operators.graph import components, cut_lineage, gathered

#: Metres within which a corner of the street stands for a crossing that the map leaves open.
TOLERANCE = 200.0
#: A metre off the street costs as much as this many on it.
OFF_STREET = 5.0
#: The largest part of a way that may be off the street.
MOST_OFF = 0.5


def named_nodes(edges: DataFrame) -> DataFrame:
    """(key, node) of the nodes on each street."""
    return edges.select(street_key(F.col("street")).alias("key"), F.explode(F.array("u", "v")).alias("node")).where("key <> ''").distinct()


def junctions(requests: DataFrame, streets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request, side, node, gap): where the street meets each cross street: the nodes they share, else the street's node that
    is nearest to one of the cross street's, with the metres between; no row where they are farther than TOLERANCE apart."""
    sides = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_key").alias("cross")) for s in ("from", "to")]))
    asked = requests.where("from_key is not null and to_key is not null").select("request", F.col("key").alias("own"), sides)
    own = asked.join(streets.select(F.col("key").alias("own"), "node"), "own")
    shared = own.join(streets.select(F.col("key").alias("cross"), "node"), ["cross", "node"]).select("request", "side", "node", F.lit(0.0).alias("gap"))
    open_ = asked.join(shared.select("request", "side").distinct(), ["request", "side"], "left_anti")
    band = lambda c: F.floor(F.col(c) * 110540 / TOLERANCE)  # noqa: E731  rows of the map as high as the tolerance
    place = nodes.select("node", F.col("x").alias("lon"), F.col("y").alias("lat"))
    here = open_.join(streets.select(F.col("key").alias("own"), "node"), "own").join(place, "node").withColumn("band", band("lat"))
    there = open_.join(streets.select(F.col("key").alias("cross"), "node"), "cross").join(place, "node").select("request", "side", F.col("lon").alias("olon"), F.col("lat").alias("olat"), F.explode(F.array(*[band("lat") + i for i in (-1, 0, 1)])).alias("band"))
    dx, dy = (F.col("olon") - F.col("lon")) * 111320 * F.cos(F.radians("lat")), (F.col("olat") - F.col("lat")) * 110540
    met = here.join(there, ["request", "side", "band"]).withColumn("gap", F.sqrt(dx * dx + dy * dy)).where(F.col("gap") <= TOLERANCE)
    nearest = met.groupBy("request", "side").agg(F.min(F.struct("gap", "node")).alias("b")).select("request", "side", "b.node", "b.gap")
    return shared.unionByName(nearest)


def cheapest_ways(requests: DataFrame, ends: DataFrame, edges: DataFrame, rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """((source, node, previous, cost) and (source, node, cost)): the ways of each request from any of its `from` ends, where what
    is off its street costs OFF_STREET times; and the `to` end it reaches at the least cost. A way that costs more than
    the cheapest found to an end is given up."""
    priced = edges.select("u", "v", "key", F.col("length").cast("double").alias("length"))
    goals = ends.where("side = 'to'").select(F.col("request").alias("source"), "node")
    start = ends.where("side = 'from'").join(requests.select("request", "key"), "request").select(F.col("request").alias("source"), "node", F.lit(0.0).alias("cost"), F.lit(None).cast(edges.schema["u"].dataType).alias("previous"), F.col("key").alias("own")).distinct()
    best = cut_lineage(start)
    front = best
    for _ in range(rounds):
        cost = F.col("cost") + F.when(F.col("key") == F.col("own"), F.col("length")).otherwise(OFF_STREET * F.col("length"))
        tried = front.join(priced, F.col("node") == F.col("u")).select("source", "own", F.col("v").alias("node"), cost.alias("cost"), F.col("u").alias("previous"))
        tried = tried.groupBy("source", "own", "node").agg(F.min(F.struct("cost", "previous")).alias("t"))
        merged = best.join(tried, ["source", "own", "node"], "full").withColumn("better", F.col("t").isNotNull() & (F.col("cost").isNull() | (F.col("t.cost") < F.col("cost"))))
        pick = lambda c: F.when(F.col("better"), F.col(f"t.{c}")).otherwise(F.col(c)).alias(c)
        merged = cut_lineage(merged.select("source", "node", pick("cost"), pick("previous"), "own", "better"))
        best = merged.drop("better")
        reached = best.join(goals, ["source", "node"]).groupBy("source").agg(F.min("cost").alias("least"))
        front = merged.where("better").drop("better").join(reached, "source", "left").where("least is null or cost < least").drop("least")
        if front.limit(1).count() == 0:
            found = best.join(goals, ["source", "node"]).groupBy("source").agg(F.min(F.struct("cost", "node")).alias("b")).select("source", "b.node", "b.cost")
            return best.drop("own"), found.where("cost > 0")
    raise RuntimeError("cheapest_ways: too many rounds")


def resolved(requests: DataFrame, edges: DataFrame, nodes: DataFrame, inside: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((request, method, length, note), (request, u, v, length, on_street)) for requests (request, street, from_street, to_street)
    over edges (u, v, street, length in metres; both ways given) and nodes (node, x: longitude, y: latitude).

    With both cross streets it is the cheapest way between their crossings with the street, over all streets: off the
    street a metre costs OFF_STREET times, so gaps in the naming are bridged and nothing else. Without them it is the longest
    connected stretch of the street, by length, among the nodes of `inside` (node), all where that isn't given. A request that
    can't be resolved has a note that says why, no method and no edges. Names match whatever their abbreviations."""
    norm = lambda c: F.nullif(street_key(F.col(c)), F.lit(""))
    asked = cut_lineage(requests.select("request", "street", "from_street", "to_street", norm("street").alias("key"), norm("from_street").alias("from_key"), norm("to_street").alias("to_key")))
    own = edges.withColumn("key", F.coalesce(street_key(F.col("street")), F.lit("")))
    streets = named_nodes(edges)
    known = streets.select("key").distinct()
    ends = cut_lineage(junctions(asked, streets, nodes))
    ways, found = cheapest_ways(asked, ends, own)
    steps = gathered(ways, found.select("source", "node", F.lit(1.0).alias("amount"))).select(F.col("source").alias("request"), "u", "v")
    choice = F.min(F.struct((F.col("own") != F.col("key")).alias("off"), F.col("length").cast("double").alias("length")))
    between = steps.join(asked.select("request", F.col("key").alias("own")), "request").join(own, ["u", "v"]).groupBy("request", "u", "v").agg(choice.alias("e")).select("request", "u", "v", "e.length", (~F.col("e.off")).alias("on_street"))
    between = cut_lineage(between)
    sums = between.groupBy("request").agg(F.sum("length").alias("length"), F.sum(F.when(F.col("on_street"), 0.0).otherwise(F.col("length"))).alias("off"))
    whole = longest_stretch(asked.where("from_key is null or to_key is null"), own, inside)
    runs = whole.groupBy("request").agg(F.sum("length").alias("run"))
    state = asked
    for side, column in (("own", "key"), ("from", "from_key"), ("to", "to_key")):
        state = state.join(known.select(F.col("key").alias(column), F.lit(True).alias(f"{side}_known")), column, "left")
    met = ends.groupBy("request").pivot("side", ["from", "to"]).count()
    state = state.join(met.select("request", F.col("from").alias("from_met"), F.col("to").alias("to_met")), "request", "left").join(sums, "request", "left").join(runs, "request", "left")
    crossed = F.col("from_key").isNotNull() & F.col("to_key").isNotNull()
    note = F.when(F.col("own_known").isNull(), F.concat(F.lit("no street named "), F.coalesce("street", F.lit(""))))
    for side in ("from", "to"):
        note = note.when(crossed & F.col(f"{side}_known").isNull(), F.concat(F.lit("no street named "), f"{side}_street"))
        note = note.when(crossed & F.col(f"{side}_met").isNull(), F.concat_ws(" ", F.col("street"), F.lit("and"), F.col(f"{side}_street"), F.lit("share no intersection")))
    note = note.when(crossed & F.col("length").isNull(), "the crossings aren't connected").when(crossed & (F.col("off") > MOST_OFF * F.col("length")), "the way runs mostly off the street").when(~crossed & F.col("run").isNull(), "the street isn't inside the boundary")
    out = state.withColumn("note", note).withColumn("_ok", F.col("note").isNull())
    summary = out.select("request", F.when(F.col("_ok"), F.when(crossed, "between cross streets").otherwise("whole street")).alias("method"), F.when(F.col("_ok"), F.when(crossed, F.col("length")).otherwise(F.col("run"))).alias("length"), "note")
    summary = cut_lineage(summary)
    good = summary.where("note is null").select("request")
    return summary, between.unionByName(whole.withColumn("on_street", F.lit(True))).join(good, "request", "left_semi")


def longest_stretch(asked: DataFrame, edges: DataFrame, inside: DataFrame | None) -> DataFrame:
    """(request, u, v, length): of each request's street the connected edges that are longest together; of equal ones those with
    the smallest node. An edge that is given both ways, or twice, counts once, with its least length."""
    wanted = asked.select("key").where("key is not null").distinct()
    once = edges.join(wanted, "key", "left_semi").groupBy("key", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.col("length").cast("double")).alias("length"))
    if inside is not None:
        for end in "uv":
            once = once.join(inside.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    once = cut_lineage(once)
    at = lambda c: F.struct("key", F.col(c).alias("node"))
    roots = components(once.select(at("u").alias("a"), at("v").alias("b")))
    placed = once.join(roots.select(F.col("node.key").alias("key"), F.col("node.node").alias("u"), F.col("root.node").alias("root")), ["key", "u"])
    totals = placed.groupBy("key", "root").agg(F.sum("length").alias("total"))
    best = totals.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("total").desc(), "root"))).where("_r = 1").select("key", "root")
    return asked.select("request", "key").join(placed.join(best, ["key", "root"]), "key").select("request", "u", "v", "length")
