"""Graphs as edge tables: ways by tasks that hold the network, or by relaxation rounds whose lineage is cut by reliable checkpoints."""

from __future__ import annotations

import tempfile
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from rostrum.operators import ways as W


#: Types of nodes that tasks sort as Spark does.
PLAIN = (IntegralType, StringType)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the folder that the session names, or one of our own where it names none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rostrum-graph-"))
    return unsized(df.checkpoint())


def unsized(df: DataFrame) -> DataFrame:
    """A checkpoint without its plan's estimate of its size. Spark keeps the estimate, and a join's is the product of its sides':
    when rounds join what rounds before them made, its digits double each time, until they fill the driver's memory."""
    spark = df.sparkSession
    kept = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.rdd(), kept.schema(), False), spark)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node connected with each node of links (a, b). Links that a count proves few enough are joined in one
    task, others, and those of nodes that aren't plain values, in rounds."""
    links = cut_lineage(links.select("a", "b").where("a is not null and b is not null").distinct())
    if isinstance(links.schema["a"].dataType, PLAIN) and links.schema["a"].dataType == links.schema["b"].dataType and links.limit(W.MOST_EDGES + 1).count() <= W.MOST_EDGES:
        return W.all_roots(links)
    both = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    for _ in range(rounds):
        near = both.join(roots, both["b"] == roots["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        up = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        step = cut_lineage(step.join(up, "new").select("node", "root", F.least("new", "up").alias("new")))
        roots = step.select("node", F.col("new").alias("root"))
        if step.where("new <> root").limit(1).count() == 0:
            return roots
    raise RuntimeError("components: too many rounds")


#: Steps that a round of relaxed() tries before it is written: a third of the jobs for a few more rows.
STEPS = 3


def shortest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, minutes, previous): least sums over edges (u, v, minutes) from each source; of equal ways the one
    whose last step comes from the smallest node. A source is its own first node, or has a row for each of its nodes where sources
    has a column `node`. Networks that a count proves small enough are searched in tasks, larger ones in rounds."""
    start = "node" if "node" in sources.columns else "source"
    at = sources.select("source", F.col(start).alias("node")).where("node is not null").distinct()
    own = cut_lineage(W.sound(edges, at.select("node")))
    nodes = W.held(own)
    return W.all_ways(own, at.withColumn("node", F.col("node").cast(own.schema["u"].dataType)), nodes) if nodes else relaxed(own, at)


def relaxed(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """shortest in rounds over tables, for networks of any size and sources (source, node). Only nodes that improved go on to the
    next round, which tries ways of up to STEPS steps from them."""
    best = cut_lineage(sources.select("source", "node", F.lit(0.0).alias("minutes"), F.lit(None).cast(edges.schema["u"].dataType).alias("previous")).distinct())
    front, priced = best, edges.select("u", "v", F.col("minutes").alias("_step"))
    while True:
        tried, at = None, front
        for _ in range(STEPS):
            step = at.select("source", F.col("node").alias("u"), "minutes").join(priced, "u").select("source", F.col("v").alias("node"), (F.col("minutes") + F.col("_step")).alias("minutes"), F.col("u").alias("previous"))
            at = step.groupBy("source", "node").agg(F.min(F.struct("minutes", "previous")).alias("t")).select("source", "node", "t.minutes", "t.previous")
            tried = at if tried is None else tried.unionByName(at)
        tried = tried.groupBy("source", "node").agg(F.min(F.struct("minutes", "previous")).alias("t"))
        merged = best.join(tried, ["source", "node"], "full").select("source", "node", "minutes", "previous", "t", (F.col("t").isNotNull() & (F.col("minutes").isNull() | (F.col("t.minutes") < F.col("minutes")))).alias("better"))
        merged = cut_lineage(merged.select("source", "node", F.when(F.col("better"), F.col("t.minutes")).otherwise(F.col("minutes")).alias("minutes"), F.when(F.col("better"), F.col("t.previous")).otherwise(F.col("previous")).alias("previous"), "better"))
        best = merged.drop("better")
        front = merged.where("better").drop("better")
        if front.limit(1).count() == 0:
            return settled(best, edges)


def settled(best: DataFrame, edges: DataFrame) -> DataFrame:
    """best with the smallest node as previous of those from which a step that takes time ends a shortest way: rounds settle
    equal ways by which came first. What only steps of no time reach keeps the previous that it has."""
    at = best.select("source", F.col("node").alias("u"), F.col("minutes").alias("_at"))
    last = at.join(edges.where("minutes > 0").select("u", "v", F.col("minutes").alias("_step")), "u").groupBy("source", F.col("v").alias("node"), (F.col("_at") + F.col("_step")).alias("minutes")).agg(F.min("u").alias("_first"))
    out = best.join(last, ["source", "node", "minutes"], "left")
    return out.select("source", "node", "minutes", F.when(F.col("previous").isNotNull(), F.coalesce("_first", "previous")).alias("previous"))


def nearest_source(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, source, minutes): the source from which each node is reached soonest, the smallest of equal ones."""
    found = shortest(edges, sources)
    return found.groupBy("node").agg(F.min(F.struct("minutes", "source")).alias("b")).select("node", "b.source", "b.minutes")


def gathered(ways: DataFrame, loads: DataFrame, rounds: int = 40) -> DataFrame:
    """(source, u, v, amount): what loads (source, node, amount) put on each step (u, v) of the ways (source, node, previous).

    A node's amount is its own and that of all whose way passes it. Each round a node passes what it has gathered to the node
    that its way passed 1, 2, 4, ... steps before, so long ways take as many rounds as the logarithm of their steps."""
    own = loads.groupBy("source", "node").agg(F.sum("amount").alias("amount"))
    state = ways.select("source", "node", "previous").join(own, ["source", "node"], "left")
    state = cut_lineage(state.select("source", "node", "previous", F.col("previous").alias("jump"), F.coalesce("amount", F.lit(0.0)).alias("amount")))
    for _ in range(rounds):
        going = state.where("jump is not null")
        if going.limit(1).count() == 0:
            return state.where("previous is not null and amount > 0").select("source", F.col("previous").alias("u"), F.col("node").alias("v"), "amount")
        passed = going.where("amount > 0").groupBy("source", F.col("jump").alias("node")).agg(F.sum("amount").alias("_more"))
        further = state.select("source", F.col("node").alias("jump"), F.col("jump").alias("_next"))
        step = state.join(passed, ["source", "node"], "left").join(further, ["source", "jump"], "left")
        state = cut_lineage(step.select("source", "node", "previous", F.col("_next").alias("jump"), (F.col("amount") + F.coalesce("_more", F.lit(0.0))).alias("amount")))
    raise RuntimeError("gathered: too many rounds")


def carried(edges: DataFrame, loads: DataFrame) -> DataFrame:
    """(u, v, amount): what loads (source, node, amount) put on the steps (u, v) of the shortest ways over edges (u, v, minutes) from
    source to node, of all sources together."""
    own = cut_lineage(W.sound(edges, loads.select("source"), loads.select("node")))
    if W.held(own):
        kind = own.schema["u"].dataType
        return W.all_loads(own, loads.where("source is not null and node is not null").select(F.col("source").cast(kind).alias("source"), F.col("node").cast(kind).alias("node"), F.col("amount").cast("double").alias("amount")))
    ways = relaxed(own, loads.select("source", F.col("source").alias("node")).distinct())
    return gathered(ways, loads).groupBy("u", "v").agg(F.sum("amount").alias("amount"))


def edge_flows(edges: DataFrame, origin: int, weights: DataFrame, trips: float, beta: float) -> DataFrame:
    """(u, v, flow): trips from origin spread over nodes by weight * exp(-beta * minutes), each along its shortest way.

    The origin, nodes out of reach and nodes without weight draw no trips."""
    ways = shortest(edges, edges.sparkSession.createDataFrame([(origin,)], "source long"))
    ways = cut_lineage(ways)
    pull = F.col("weight") * F.exp(-beta * F.col("minutes"))
    shares = ways.join(weights.where("weight > 0"), "node").where(F.col("node") != origin).withColumn("pull", pull)
    total = shares.agg(F.sum("pull")).first()[0] or 1.0
    loads = shares.select("source", "node", (F.lit(float(trips)) * F.col("pull") / total).alias("amount"))
    return carried(edges, loads).select("u", "v", F.col("amount").alias("flow"))


def sampled_baseline(edges: DataFrame, origins: DataFrame, destinations: DataFrame, n: int = 2000, seed: int = 20260718) -> DataFrame:
    """(u, v, count): on how many of n seeded trips' shortest ways each edge lies. origins and destinations (node, weight) are
    drawn from apart; a trip to where it starts, or out of reach, uses no edge. Nodes that no trip starts from aren't searched
    from; the trips of one origin are carried back together, its ways once."""
    trips = sampled_pairs(origins, n, seed, destinations)
    loads = trips.groupBy(F.col("from").alias("source"), F.col("to").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("amount"))
    return carried(edges, cut_lineage(loads)).select("u", "v", F.col("amount").cast("long").alias("count"))


def edge_changes(flows: DataFrame, baseline: DataFrame, scale: float, least: int = 5) -> DataFrame:
    """flows (u, v, flow) with change, the flow in per cent of the baseline's trips; null where fewer than `least` sampled trips
    use the edge. scale: trips a day for one sampled trip."""
    out = flows.join(baseline.select("u", "v", "count"), ["u", "v"], "left")
    return out.select("u", "v", "flow", F.when(F.col("count") >= least, 100 * F.col("flow") / (F.col("count") * F.lit(float(scale)))).alias("change"))


def crossings(edges: DataFrame, least: int = 2) -> DataFrame:
    """(node, label) of nodes where at least `least` named streets meet; the first two names, sorted, label it."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "street").where(F.col("street").isNotNull())
    names = ends.groupBy("node").agg(F.array_sort(F.collect_set("street")).alias("names"))
    return names.where(F.size("names") >= least).select("node", F.array_join(F.slice("names", 1, 2), " & ").alias("label"))


#: Parts of the running total whose sums the driver lays end to end: two hex digits of a hash.
PARTS = 256


def drawn(weights: DataFrame, n: int, seed: int, side: str) -> DataFrame:
    """(draw, node): n draws of nodes (node, weight) by weight, numbered from 0.

    The weights are laid end to end, by a hash of the node and then the node: each part's sum is known, and nodes add up inside
    a part. The line is cut into as many equal slots as there are nodes. A node is entered in the slots that it reaches, all
    together no more than twice the nodes, and a draw looks up its slot. The last span has no end, so that no draw falls
    beyond it."""
    spark = weights.sparkSession
    own = weights.where("weight > 0").select("node", F.col("weight").cast("double").alias("weight"), F.conv(F.substring(F.md5(F.col("node").cast("string")), 1, 2), 16, 10).cast("int").alias("part"))
    sums = {r.part: (r.total, r.n) for r in own.groupBy("part").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).collect()}
    ends = list(accumulate((sums.get(p, (0.0, 0))[0] for p in range(PARTS)), initial=0.0))
    total, slots = ends[-1], sum(k for _, k in sums.values())
    if not slots:
        return own.select(F.lit(None).cast("long").alias("draw"), "node").limit(0)
    width = total / slots
    parts = spark.createDataFrame([(p, ends[p], ends[p + 1]) for p in sorted(sums)], "part int, base double, top double")
    by = Window.partitionBy("part").orderBy("node")
    before = F.coalesce(F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    spans = own.join(F.broadcast(parts), "part").withColumn("start", F.col("base") + before)
    spans = spans.withColumn("end", F.coalesce(F.lead("start").over(by), F.when(F.col("part") == max(sums), float("inf")).otherwise(F.col("top"))))
    slot = lambda c: F.least(F.floor(c / width), F.lit(slots - 1)).cast("long")
    entered = spans.select("node", "start", "end", F.explode(F.sequence(slot(F.col("start")), slot(F.least("end", F.lit(total))))).alias("slot"))
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(side), F.col("id").cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)
    draws = spark.range(n).select(F.col("id").alias("draw"), (u * total).alias("at")).withColumn("slot", slot(F.col("at")))
    return draws.join(entered, "slot").where("at >= start and at < end").select("draw", "node")


def sampled_pairs(weights: DataFrame, n: int, seed: int = 20260718, destinations: DataFrame | None = None) -> DataFrame:
    """(draw, from, to): n trips; where they start is drawn by weights (node, weight), where they end by those of destinations, if
    given. None where either has no weight."""
    from_ = drawn(weights, n, seed, "from").withColumnRenamed("node", "from")
    to = drawn(weights if destinations is None else destinations, n, seed, "to").withColumnRenamed("node", "to")
    return from_.join(to, "draw")


def top_edges(flows: DataFrame, n: int = 300) -> DataFrame:
    return flows.orderBy(F.col("flow").desc(), "u", "v").limit(n)


def shared_nodes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, node): nodes that lie on both streets of each pair (a, b)."""
    ends = edges.where(F.col("street").isNotNull()).select("street", F.explode(F.array("u", "v")).alias("node")).distinct()
    first = pairs.join(ends.withColumnRenamed("street", "a"), "a")
    return first.join(ends.withColumnRenamed("street", "b"), ["b", "node"]).select("a", "b", "node")


def longest_runs(edges: DataFrame) -> DataFrame:
    """(street, run, pieces, length): of each street's edges (edge, street, u, v, length) the longest run of pieces that meet
    end to end, where no third piece of the street meets them; run is its smallest edge, and decides between equal ones."""
    ends = edges.select("street", "edge", F.explode(F.array("u", "v")).alias("node"))
    joints = ends.groupBy("street", "node").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("a"), F.max("edge").alias("b")).where("n = 2").select("a", "b")
    alone = edges.select(F.col("edge").alias("a"), F.col("edge").alias("b"))
    runs = edges.join(components(joints.unionByName(alone)).withColumnRenamed("node", "edge"), "edge")
    sums = runs.groupBy("street", F.col("root").alias("run")).agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("length"))
    best = Window.partitionBy("street").orderBy(F.col("length").desc(), "run")
    return sums.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
