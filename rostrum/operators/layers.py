"""Map layers: lines with fewer corners, and features as JSON within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.graph import cut_lineage
from rostrum.operators.relational import latest_by, require
from rostrum.operators.spatial import segment_distance

#: Bytes that the layers of one evaluation may take.
BUDGET = 2 * 1024 * 1024
EMPTY = '{"type":"FeatureCollection","features":[]}'


def simplified(points: DataFrame, line: str, order: str, tolerance: float) -> DataFrame:
    """The points (line, order, x, y) that stay of each line: its ends, and, between two that stay, the one farthest from the
    straight way between them, the first of equal ones, where that is farther than the tolerance; and so on.

    All stretches of all lines are split in the same round, each by a maximum over its points, so a line of any length is spread
    over all tasks. Lines have each place of the order once; points without a coordinate are left out."""
    own = points.where("x is not null and y is not null").select(line, F.col(order).alias("n"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = own.groupBy(line).agg(F.min(F.struct("n", "x", "y")).alias("a"), F.max(F.struct("n", "x", "y")).alias("b"))
    kept = [ends.select(line, F.explode(F.array_distinct(F.array("a", "b"))).alias("p"))]
    open_ = cut_lineage(own.join(ends, line).where("n > a.n and n < b.n"))
    away = segment_distance(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    while open_.limit(1).count():
        far = open_.groupBy(line, "a", "b").agg(F.max(F.struct(away.alias("d"), (-F.col("n")).alias("first"), F.struct("n", "x", "y").alias("p"))).alias("m"))
        far = cut_lineage(far.where(F.col("m.d") > tolerance).select(line, "a", "b", F.col("m.p").alias("mid")))
        kept.append(far.select(line, F.col("mid").alias("p")))
        split = open_.join(far, [line, "a", "b"]).where("n <> mid.n")
        before = F.col("n") < F.col("mid.n")
        open_ = cut_lineage(split.select(line, "n", "x", "y", F.when(before, F.col("a")).otherwise(F.col("mid")).alias("a"), F.when(before, F.col("mid")).otherwise(F.col("b")).alias("b")))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.select(line, F.col("p.n").alias(order), "p.x", "p.y")


def feature(kind: str, coordinates: Column, properties: list[str], digits: int = 5) -> Column:
    """A GeoJSON feature: coordinates, an array of (x, y), rounded; a Point takes the first."""
    pair = lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))
    places = F.transform(coordinates, pair)
    shape = places if kind == "LineString" else F.get(places, F.lit(0))
    geometry = F.struct(F.lit(kind).alias("type"), shape.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def within_budget(features: DataFrame, group: list[str], size: str, key: str, json: str, budget: int = BUDGET, least: float | None = None) -> DataFrame:
    """The features (group, size, key, json) that fit the group's budget of bytes as a collection: the largest first, of equal ones
    the smallest key, up to the first that no longer fits. Those smaller than `least`, or without a size, are trimmed before.

    A feature takes its bytes and a comma. As none is shorter than the shortest, only so many of a group can fit: each task
    passes on no more than that before a group is sorted."""
    own = features.where(F.col(size).isNotNull() & (F.lit(least is None) | (F.col(size) >= (least or 0.0)))).withColumn("_bytes", F.octet_length(json) + 1)
    shortest = own.agg(F.min("_bytes")).first()[0] or 1
    order = [F.col(size).desc(), F.col(key)]
    first = latest_by(own, group, order, max(1, (budget - len(EMPTY)) // shortest + 1))
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("_total", F.sum("_bytes").over(upto) + len(EMPTY) - 1).where(F.col("_total") <= budget).drop("_bytes", "_total", "rank")


def collections(features: DataFrame, group: list[str], size: str, key: str, json: str, budget: int = BUDGET) -> DataFrame:
    """(group, n, layer): the features of each group as one JSON collection, largest first; reading a group over the budget fails,
    as what should have been trimmed was not."""
    row = F.struct((-F.col(size)).alias("s"), F.col(key).alias("k"), F.col(json).alias("j"))
    listed = features.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["j"]), ",").alias("f"))
    out = listed.select(*group, "n", F.concat(F.lit(EMPTY[:-2]), "f", F.lit("]}")).alias("layer"))
    return require(out, F.octet_length("layer") <= budget, f"a layer is over {budget} bytes")
