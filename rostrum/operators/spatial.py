"""Planar joins by grid cells: each point meets only the points of its own and the neighbouring cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.folds import ordered_fold


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places by 111320 * cos(latitude) and 110540 metres a degree."""
    dx = (lon2 - lon1) * 111320 * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * 110540
    return F.sqrt(dx * dx + dy * dy)


def within(centres: DataFrame, points: DataFrame, radius: float, centre: str, point: str, same: str | None = None) -> DataFrame:
    """Pairs (centre's columns, point's columns prefixed p_, d) at most radius apart, and alike in the column `same` if it is
    given; both have x and y."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    own = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns], cell("x").alias("_cx"), cell("y").alias("_cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = centres.withColumn("_s", F.explode(steps)).withColumn("_cx", cell("x") + F.col("_s.i")).withColumn("_cy", cell("y") + F.col("_s.j")).drop("_s")
    if same:
        near, own = near.withColumn("_same", F.col(same)), own.withColumn("_same", F.col(f"p_{same}"))
    both = near.join(own, ["_cx", "_cy", *(["_same"] if same else [])]).drop("_cx", "_cy", "_same")
    return both.withColumn("d", distance(F.col("x"), F.col("y"), F.col("p_x"), F.col("p_y"))).where(F.col("d") <= radius)


def population_near(nodes: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """nodes with pop, the sum over points in the radius, zero where there are none."""
    from rostrum.operators.cells import sums_near

    sums = sums_near(nodes, points, radius, "node_id", ["pop"])
    return nodes.join(sums, "node_id", "left").withColumn("pop", F.coalesce("pop", F.lit(0.0)))


def counts_near(nodes: DataFrame, points: DataFrame, radius: float, kind: str, kinds: list) -> DataFrame:
    """nodes with a column for each kind: how many points of it are in the radius."""
    from rostrum.operators.cells import sums_near

    of = points.where(F.col(kind).isin(kinds)).select("x", "y", *[(F.col(kind) == k).cast("double").alias(f"kind_{k}") for k in kinds])
    out = nodes.select("node_id").join(sums_near(nodes, of, radius, "node_id", [f"kind_{k}" for k in kinds]), "node_id", "left")
    return out.select("node_id", *[F.coalesce(F.col(f"`kind_{k}`").cast("long"), F.lit(0).cast("long")).alias(f"kind_{k}") for k in kinds])


def nearest(from_: DataFrame, to: DataFrame, key: str, to_key: str, first: float) -> DataFrame:
    """(key, to_key, d): the nearest of `to`, the smallest key of equal ones. Rows that have one within `first`, or a shorter way where
    places lie close, are done by one join of neighbouring cells; the others, and those where a cell holds over CROWD places, look for
    theirs in a tree of cells. Rows whose place is null have none, nor has any row where `to` has no places."""
    from rostrum.operators.graph import cut_lineage

    places = to.where("x is not null and y is not null").groupBy(F.col("x").cast("double").alias("tx"), F.col("y").cast("double").alias("ty")).agg(F.min(to_key).alias(to_key))
    places = cut_lineage(places)
    n, wide, high = places.agg(F.count(F.lit(1)), F.max("tx") - F.min("tx"), F.max("ty") - F.min("ty")).first()
    radius = min(first, 1.5 * math.sqrt(max(wide * high, max(wide, high) ** 2 / n, 1e-18) / n)) if n else first
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = lambda df: df.withColumn("cx", F.explode(F.array(*[F.col("cx") + i for i in (-1, 0, 1)]))).withColumn("cy", F.explode(F.array(*[F.col("cy") + i for i in (-1, 0, 1)])))
    there = places.select("tx", "ty", to_key, cell("tx").alias("cx"), cell("ty").alias("cy"))
    full = there.groupBy("cx", "cy").count().where(F.col("count") > CROWD).select("cx", "cy")
    own = from_.where("x is not null and y is not null").select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    met = own.select("*", cell("x").alias("cx"), cell("y").alias("cy")).join(around(full).distinct(), ["cx", "cy"], "left_anti").join(around(there), ["cx", "cy"])
    met = met.select(key, to_key, distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")).alias("d")).where(F.col("d") <= radius)
    best = cut_lineage(met.groupBy(key).agg(F.min(F.struct("d", to_key)).alias("b")).select(key, f"b.{to_key}", "b.d"))
    left = cut_lineage(own.join(best.select(key), key, "left_anti"))
    return best.unionByName(nearest_by_tree(left, to, key, to_key)) if left.limit(1).count() else best


#: Places of a cell beyond which its neighbours look for theirs in the tree.
CROWD = 64
#: Levels of the tree whose cells, 16 times as many each, are few enough to be broadcast: 65,536 in the last.
BROADCAST_LEVELS = 4


def nearest_by_tree(from_: DataFrame, to: DataFrame, key: str, to_key: str) -> DataFrame:
    """nearest for rows that may be far from all of `to`. The square around the places is cut into 4 x 4 cells again and again.
    Each row keeps the cells that may hold its nearest place: those no farther than the farthest corner of the best one, by
    the box around the places in each. So a row meets a few cells a level, and places only in the last ones."""
    from rostrum.operators.graph import cut_lineage

    places = to.where("x is not null and y is not null").groupBy(F.col("x").cast("double").alias("tx"), F.col("y").cast("double").alias("ty")).agg(F.min(to_key).alias(to_key))
    places = cut_lineage(places)
    n, west, east, south, north = places.agg(F.count(F.lit(1)), F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    if not n:
        return from_.join(places.select(to_key), F.lit(False)).select(key, to_key, F.lit(0.0).alias("d"))
    size = max(east - west, north - south, 1e-9) * (1 + 1e-9)
    cell = lambda s: (F.floor((F.col("tx") - west) / s).alias("cx"), F.floor((F.col("ty") - south) / s).alias("cy"))
    open_ = from_.select(key, "x", "y", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    for level in range(1, math.ceil(math.log(n, 16)) + 2):
        size /= 4
        boxes = places.groupBy(*cell(size)).agg(F.min("tx").alias("w"), F.max("tx").alias("e"), F.min("ty").alias("s"), F.max("ty").alias("n"))
        boxes = boxes.select("w", "e", "s", "n", F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.floor(F.col("cx") / 4).alias("cx"), F.floor(F.col("cy") / 4).alias("cy"))
        met = open_.join(F.broadcast(boxes) if level <= BROADCAST_LEVELS else boxes, ["cx", "cy"])
        off = lambda c, lo, hi: F.greatest(F.col(lo) - F.col(c), F.col(c) - F.col(hi), F.lit(0.0))
        far = lambda c, lo, hi: F.greatest(F.abs(F.col(c) - F.col(lo)), F.abs(F.col(c) - F.col(hi)))
        met = met.withColumn("low", F.hypot(off("x", "w", "e"), off("y", "s", "n"))).withColumn("high", F.hypot(far("x", "w", "e"), far("y", "s", "n")))
        best = met.groupBy(key).agg(F.min("high").alias("best"))
        open_ = cut_lineage(met.join(best, key).where(F.col("low") <= F.col("best") * (1 + 1e-12)).select(key, "x", "y", F.col("nx").alias("cx"), F.col("ny").alias("cy")))
    met = open_.join(places.select("tx", "ty", to_key, *cell(size)), ["cx", "cy"])
    d = distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    return met.groupBy(key).agg(F.min(F.struct(d.alias("d"), to_key)).alias("b")).select(key, f"b.{to_key}", "b.d")


def same_name_pairs(points: DataFrame, name: str, key: str, radius: float) -> DataFrame:
    """(a, b), a < b: points of one name, which isn't empty, at most radius apart."""
    own = points.where(F.col(name) != "").select(F.col(key).alias("id"), F.col(name).alias("_n"), "x", "y")
    pairs = within(own, own, radius, "id", "id", same="_n").where(F.col("id") < F.col("p_id"))
    return pairs.select(F.col("id").alias("a"), F.col("p_id").alias("b"))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return distance(x, y, ax + t * dx, ay + t * dy)


def near_line(points: DataFrame, line: list[tuple[float, float]], radius: float) -> DataFrame:
    """points with d, their distance from the polyline, where it is at most radius."""
    x, y = F.col("x"), F.col("y")
    parts = [segment_distance(x, y, *map(F.lit, (*a, *b))) for a, b in zip(line, line[1:], strict=False)]
    return points.withColumn("d", F.least(*parts) if len(parts) > 1 else parts[0]).where(F.col("d") <= radius)


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting: whether a ray to the right crosses the ring an odd number of times."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay != by:
            cut = ax + (y - ay) * (bx - ax) / (by - ay)
            crossed = crossed + F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < cut), 1).otherwise(0)
    return crossed % 2 == 1


def ring_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a ring given as arrays."""
    n = F.size(xs)
    turn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.abs(F.aggregate(turn, F.lit(0.0), lambda s, t: s + t)) / 2


def thin_along(points: DataFrame, line: str, at: str, step: float) -> DataFrame:
    """Points at least `step` beyond the last one kept, along each line: a fold over the ordered places."""

    def keep(last: list, row: tuple):
        if last and row[0] - last[0] < step:
            return ()
        last[:] = row
        return (row,)

    own = points.select(line, F.col(at).cast("double").alias(at)).where(F.col(at).isNotNull())
    return ordered_fold(own, [line], [at], [at], f"`{line}` {own.schema[line].dataType.simpleString()}, `{at}` double", list, keep)


def dbscan(points: DataFrame, eps: float, least: int, key: str = "point_id") -> DataFrame:
    """(key, cluster): cluster is the smallest core point of the cluster, null for noise; a border point belongs to the
    smallest cluster of a core point near it."""
    from rostrum.operators.cells import clusters

    return clusters(points, eps, least, key)


def top_places(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def nearest_mean(segments: DataFrame, x: float, y: float, value: str, n: int = 10) -> DataFrame:
    """One row, mean: of the n segments nearest to a place, the lesser value first where two are as near; 0 of none."""
    near = segments.select(distance(F.col("x"), F.col("y"), F.lit(x), F.lit(y)).alias("d"), value).where(F.col("d").isNotNull()).orderBy("d", value).limit(n)
    return near.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def name_clusters(members: DataFrame, junctions: DataFrame, radius: float) -> DataFrame:
    """(cluster, name, n): clusters of members (cluster, key, name, x, y) named by the nearest of junctions (node, label, x, y)
    within the radius of their middle, else by the member nearest to it; of equal ones the smallest node or key."""
    middle = members.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    named = within(middle, junctions, radius, "cluster", "node").groupBy("cluster").agg(F.min(F.struct("d", "p_node", "p_label")).alias("b")).select("cluster", F.col("b.p_label").alias("label"))
    of = middle.select("cluster", F.col("x").alias("mx"), F.col("y").alias("my"))
    central = members.join(of, "cluster").groupBy("cluster").agg(F.min(F.struct(distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my")).alias("d"), "key", "name")).alias("c"))
    return middle.join(central, "cluster").join(named, "cluster", "left").select("cluster", F.coalesce("label", F.concat("c.name", F.lit(" area"))).alias("name"), "n")
