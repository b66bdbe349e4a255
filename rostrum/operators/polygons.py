"""Polygons in tables: joins with points and lines, unions, and the sites that projects resolve to.

A polygon is a key and `rings`, an array of rings, each an array of corners (x, y): the first ring is its outside, others are
holes or further parts; a place is inside if a ray from it to the right crosses the sides an odd number of times. Every
join goes over grid cells. A polygon is cut on a grid of its own size class, so it has at most some thousand cells, large or
small, and a point looks itself up once for each size class there is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.spatial import segment_distance
from rostrum.session import ship_package

#: Cells along the longer side of a polygon: from this number to four times of it.
FINEST = 8
#: Sides up to which a polygon's points may be tested with all of them: it needs few cells.
FEW_SIDES = 64
#: Parts of a cell by which a side is taken to reach beyond itself, against rounding.
MARGIN = 1e-6


def from_corners(corners: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rings) of rows (keys, ring, n, x, y)."""
    rings = corners.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("c"))
    points = F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    every = rings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ring", points.alias("points")))).alias("r"))
    return every.select(*keys, F.transform("r", lambda r: r["points"]).alias("rings"))


def sides(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ax, ay, bx, by) of the sides of all rings, the last corner joined to the first. Sides that have no length or
    a missing coordinate are left out."""
    ring = F.explode("rings").alias("ring")
    own = polygons.select(*keys, ring).where(F.size("ring") > 1)
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    pair = F.explode(F.arrays_zip(F.col("ring").alias("a"), after.alias("b"))).alias("s")
    return own.select(*keys, pair).select(*keys, *[F.col(f"s.{e}.{c}").cast("double").alias(e + c) for e in "ab" for c in "xy"]).where("ax <> bx or ay <> by")


def sized(edges: DataFrame, keys: list[str], few: int = 0) -> DataFrame:
    """edges with level, the size class of their polygon, and cell, the width of that class's cells: FINEST along the longer side at
    least, or one where the polygon has at most `few` sides."""
    bounds = [f(g(c)).alias(f"{n}{c[-1]}") for n, f, g in (("lo", F.min, lambda c: F.least(f"a{c}", f"b{c}")), ("hi", F.max, lambda c: F.greatest(f"a{c}", f"b{c}"))) for c in "xy"]
    boxes = edges.groupBy(*keys).agg(*bounds, F.count(F.lit(1)).alias("_sides"))
    side = F.greatest(F.col("hix") - F.col("lox"), F.col("hiy") - F.col("loy"))
    level = (F.floor(F.log2(side / F.when(F.col("_sides") <= few, 1).otherwise(FINEST)) / 2) * 2).cast("int")
    return edges.join(boxes.withColumn("level", level).drop("_sides").withColumn("cell", F.pow(F.lit(2.0), "level")), keys)


def reach(low: Column, high: Column, cell: Column, beyond: int = 0) -> Column:
    """The numbers of the cells from low to high."""
    return F.sequence(F.floor(low / cell - MARGIN) - beyond, F.floor(high / cell + MARGIN) + beyond)


def crossed_cells(edges: DataFrame, beyond: int = 0) -> DataFrame:
    """edges (ax, ay, bx, by, cell) with each cell (cx, cy) that they touch, and those `beyond` away from one."""
    cell = F.col("cell")
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    own = edges.withColumn("cx", F.explode(reach(left, right, cell, beyond)))
    slope = (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    steep = (right - left) < MARGIN * cell
    at = lambda x: F.when(steep, None).otherwise(F.col("ay") + (F.least(F.greatest(x, left), right) - F.col("ax")) * slope)
    from_, to = at((F.col("cx") - beyond) * cell), at((F.col("cx") + 1 + beyond) * cell)
    low, high = F.coalesce(F.least(from_, to), F.least("ay", "by")), F.coalesce(F.greatest(from_, to), F.greatest("ay", "by"))
    low, high = F.when(steep, F.least("ay", "by")).otherwise(low), F.when(steep, F.greatest("ay", "by")).otherwise(high)
    return own.withColumn("cy", F.explode(reach(low, high, cell, beyond)))


def odd_crossings(band: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right crosses an odd number of the sides in band."""

    def crossed(s: Column) -> Column:
        cut = s["ax"] + (y - s["ay"]) * (s["bx"] - s["ax"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0))
        return ((s["ay"] > y) != (s["by"] > y)) & (x < cut)

    return F.size(F.filter(band, crossed)) % 2 == 1


def cover(polygons: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, level, cx, cy, edge) of the cells that a polygon touches, edge telling whether a side runs through; and (keys,
    cy, band) of the sides that reach each row of its cells."""
    edges = sized(sides(polygons, keys), keys)
    edge_cells = crossed_cells(edges).select(*keys, "level", "cx", "cy").distinct()
    cell = F.col("cell")
    rows = edges.withColumn("cy", F.explode(reach(F.least("ay", "by"), F.greatest("ay", "by"), cell)))
    bands = rows.groupBy(*keys, "cy").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("band"), *[F.first(c).alias(c) for c in ("level", "cell", "lox", "hix")])
    whole = bands.withColumn("cx", F.explode(reach(F.col("lox"), F.col("hix"), cell))).join(edge_cells, [*keys, "level", "cx", "cy"], "left_anti")
    inside = whole.where(odd_crossings(F.col("band"), (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell)).select(*keys, "level", "cx", "cy")
    cells = edge_cells.withColumn("edge", F.lit(True)).unionByName(inside.withColumn("edge", F.lit(False)))
    return cells, bands.select(*keys, "cy", "band")


def located(points: DataFrame, polygons: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """points (x, y, ...) with the key of each polygon they are in, a row for each; points in none have no row.

    by: columns that a point and its polygon have in common. polygons has each key once (with by); points has no column of
    the key's name. A point tests the sides that reach its row of cells, of the polygons that have its cell in their box; cells are as
    wide as a polygon of few sides, and narrower for those of many, so that these are never looked through whole. A point on a side is
    in at most one of two polygons that share it. Points without a coordinate and polygons without sides are in no pair."""
    by = by or []
    keys = [*by, key]
    edges = sized(sides(polygons.select(*keys, "rings"), keys), keys, FEW_SIDES)
    levels = [r.level for r in edges.select("level").distinct().collect()]  # doublings of size, two a class: a few dozen at most
    if not levels:
        return points.join(polygons.select(F.col(key).alias(key)).limit(0), F.lit(False))
    cell = F.col("cell")
    rows = edges.withColumn("cy", F.explode(reach(F.least("ay", "by"), F.greatest("ay", "by"), cell)))
    bands = rows.groupBy(*keys, "level", "cell", "lox", "hix", "cy").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("band"))
    cells = bands.withColumn("cx", F.explode(reach(F.col("lox"), F.col("hix"), cell))).select(*keys, "level", "cx", "cy", "band", "lox", "hix")
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    placed = points.where(sound("x") & sound("y")).select(F.struct("*").alias("_p"), *by, F.explode(F.array(*map(F.lit, levels))).alias("level"))
    at = lambda c: F.floor(F.col(f"_p.{c}") / F.pow(F.lit(2.0), "level"))
    met = placed.withColumn("cx", at("x")).withColumn("cy", at("y")).join(cells, [*by, "level", "cx", "cy"])
    x, y = F.col("_p.x").cast("double"), F.col("_p.y").cast("double")
    return met.where((x >= F.col("lox")) & (x <= F.col("hix")) & odd_crossings(F.col("band"), x, y)).select("_p.*", key)


def gap(a: list[Column], b: list[Column]) -> Column:
    """The distance of two segments (ax, ay, bx, by): zero where they cross."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    turn = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    apart = lambda *t: F.signum(turn(*t[:6])) * F.signum(turn(*t[:4], *t[6:])) < 0
    crossing = apart(ax, ay, bx, by, cx, cy, dx, dy) & apart(cx, cy, dx, dy, ax, ay, bx, by)
    ends = [segment_distance(ax, ay, *b), segment_distance(bx, by, *b), segment_distance(cx, cy, *a), segment_distance(dx, dy, *a)]
    return F.when(crossing, 0.0).otherwise(F.least(*ends))


def in_band(polygons: DataFrame, lines: DataFrame, key: str, line: str, distance: float) -> DataFrame:
    """(key, line, d): polygons that reach into the band of `distance` around each of lines (line, path: array of x, y), with
    how far they are from the line; zero where they meet or the line lies inside.

    Sides meet the line's segments by cells as wide as the distance or the shorter of both, and no more than some 64 to the longer. A line that keeps away from all sides of a
    polygon is inside as a whole or not at all, so its first place decides."""
    edges = sides(polygons, [key])
    path = F.col("path")
    pairs = F.explode(F.arrays_zip(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(1))).alias("a"), F.when(F.size(path) > 1, F.slice(path, 2, F.size(path) - 1)).otherwise(path).alias("b")))
    own = lines.where(F.size("path") > 0).select(line, pairs.alias("s")).select(line, *[F.col(f"s.{e}.{c}").cast("double").alias(e + c) for e in "ab" for c in "xy"])
    length = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    typical = [x or 0.0 for t in (edges, own) for x in t.agg(F.avg(length)).first()]
    cell = F.lit(float(max(distance, min(typical), max(typical) / 64, 1e-9)))
    a = crossed_cells(edges.withColumn("cell", cell)).drop("cell")
    b = crossed_cells(own.withColumn("cell", cell), 1).select(line, "cx", "cy", *[F.col(c).alias(f"l{c}") for c in ("ax", "ay", "bx", "by")])
    apart = gap([F.col(c) for c in ("ax", "ay", "bx", "by")], [F.col(f"l{c}") for c in ("ax", "ay", "bx", "by")])
    near = a.join(b, ["cx", "cy"]).select(key, line, apart.alias("d")).where(F.col("d") <= distance)
    first = lines.where(F.size("path") > 0).select(line, F.col("path")[0]["x"].alias("x"), F.col("path")[0]["y"].alias("y"))
    inside = located(first, polygons, key).select(key, line, F.lit(0.0).alias("d"))
    return near.unionByName(inside).groupBy(key, line).agg(F.min("d").alias("d"))


def near_lines(points: DataFrame, lines: DataFrame, key: str, line: str, distance: float) -> DataFrame:
    """(line, key, d, along): the points (key, x, y) at most `distance` from each of lines (line, path), how far they are, and how far
    along the line its place nearest to them is, the first of equal ones."""
    path = F.col("path")
    pair = F.posexplode(F.arrays_zip(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))).alias("a"), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))).alias("b"))).alias("n", "s")
    own = lines.where(F.size("path") > 1).select(line, pair).select(line, "n", *[F.col(f"s.{e}.{c}").cast("double").alias(e + c) for e in "ab" for c in "xy"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.sqrt(dx * dx + dy * dy)
    before = Window.partitionBy(line).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_start", F.coalesce(F.sum(length).over(before), F.lit(0.0)))
    cell = F.lit(float(max(distance, own.agg(F.avg(F.greatest(F.abs(dx), F.abs(dy)))).first()[0] or 0.0, 1e-9)))
    cells = crossed_cells(own.withColumn("cell", cell), 1).drop("cell")
    at = lambda c: F.floor(F.col(c).cast("double") / cell)
    placed = points.where("x is not null and y is not null").select(key, F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), at("x").alias("cx"), at("y").alias("cy"))
    met = placed.join(cells, ["cx", "cy"])
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    gap_ = segment_distance(F.col("px"), F.col("py"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    near = met.select(line, key, gap_.alias("d"), (F.col("_start") + t * length).alias("along")).where(F.col("d") <= distance)
    return near.groupBy(line, key).agg(F.min(F.struct("d", "along")).alias("b")).select(line, key, "b.d", "b.along")


def dissolved(polygons: DataFrame, group: str, key: str, grain: float = 1e-3) -> DataFrame:
    """(group, ax, ay, bx, by): the outline of the union of each group's polygons, the inside to the left of each piece.

    Sides are cut at the borders of square tiles, and split where sides of the group's other polygons cross or touch them. Of the
    pieces, each taken once, those stay that have the union on one side only: what two parcels share, and what lies inside another, has
    it on both. A tile that a polygon covers has no outline, whatever else lies there; the sides of any other tile, and those to the right
    of it that decide what is inside, meet as arrays in a task. What is narrower than grain isn't told apart. Equal polygons of a group
    count once."""
    ship_package(polygons.sparkSession)
    once = polygons.select(group, key, "rings").where(F.col(group).isNotNull()).groupBy(group, "rings").agg(F.min(key).alias(key))
    edges = sides(once, [group, key])
    length = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    wide = edges.groupBy(group).agg(F.pow(F.lit(2.0), F.floor(F.log2(F.avg(length) / 2))).alias("cell"))
    spans = edges.groupBy(group, key).agg(F.min(F.least("ax", "bx")).alias("lox"), F.max(F.greatest("ax", "bx")).alias("hix"))
    edges = edges.join(spans, [group, key]).join(F.broadcast(wide), group)
    cell, tile = F.col("cell"), [group, "cx", "cy"]
    covered = covered_cells(edges, [group, key]).select(*tile).distinct()
    rows = edges.withColumn("cy", F.explode(reach(F.least("ay", "by") - grain, F.greatest("ay", "by") + grain, cell)))
    met = rows.withColumn("cx", F.explode(reach(F.col("lox") - grain, F.greatest("ax", "bx") + grain, cell))).join(covered, tile, "left_anti")
    kind = polygons.schema[group].dataType.simpleString()

    def trace(held: pa.Table) -> pa.Table:
        box, names = held.slice(0, 1).to_pylist()[0], ("ax", "ay", "bx", "by")
        low = (box["cx"] * box["cell"], box["cy"] * box["cell"])
        out = outline_in(*(held[c].to_numpy() for c in names), pc.index_in(held[key], value_set=held[key].unique()).to_numpy(), low, box["cell"], grain)
        return pa.table([held[group].take(pa.array(np.zeros(len(out), np.int64))), *[pa.array(c) for c in out.T]], names=[group, *names])

    return met.select(*tile, key, "cell", "ax", "ay", "bx", "by").groupBy(*tile).applyInArrow(trace, f"`{group}` {kind}, ax double, ay double, bx double, by double")


def covered_cells(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cx, cy) of the cells that lie inside a polygon, no side running through: edges has lox, hix and cell."""
    cell = F.col("cell")
    through = crossed_cells(edges).select(*keys, "cx", "cy").distinct()
    bands = edges.withColumn("cy", F.explode(reach(F.least("ay", "by"), F.greatest("ay", "by"), cell))).groupBy(*keys, "cy", "cell", "lox", "hix").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("band"))
    whole = bands.withColumn("cx", F.explode(reach(F.col("lox"), F.col("hix"), cell))).join(through, [*keys, "cx", "cy"], "left_anti")
    return whole.where(odd_crossings(F.col("band"), (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell)).select(*keys, "cx", "cy")


#: Pairs that a task holds at once while it traces an outline.
PAIRS = 1 << 19


def outline_in(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, of: np.ndarray, low: tuple[float, float], cell: float, grain: float) -> np.ndarray:
    """Rows ax, ay, bx, by of the union's outline in the tile whose lower left corner is low, from the sides of polygons `of`."""
    order = np.argsort(of, kind="stable")
    ax, ay, bx, by, of = ax[order], ay[order], bx[order], by[order], of[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    start, stop = np.zeros(len(ax)), np.ones(len(ax))
    for a, b, edge in ((ax, bx, low[0]), (ay, by, low[1])):
        with np.errstate(divide="ignore", invalid="ignore"):
            one, two = (edge - a) / (b - a), (edge + cell - a) / (b - a)
        start, stop = np.where(a == b, start, np.maximum(start, np.minimum(one, two))), np.where(a == b, stop, np.minimum(stop, np.maximum(one, two)))
    middle = (start + stop) / 2
    mx, my = ax + middle * (bx - ax), ay + middle * (by - ay)
    on = np.flatnonzero((stop > start) & (mx >= low[0]) & (mx < low[0] + cell) & (my >= low[1]) & (my < low[1] + cell))
    if not len(on):
        return np.empty((0, 4))
    margin = cell * MARGIN
    near = np.flatnonzero((np.maximum(ax, bx) >= low[0] - margin) & (np.minimum(ax, bx) <= low[0] + cell + margin) & (np.maximum(ay, by) >= low[1] - margin) & (np.minimum(ay, by) <= low[1] + cell + margin))
    which, at = [np.arange(len(on)), np.arange(len(on))], [start[on], stop[on]]
    step = max(1, PAIRS // len(near))
    for i in range(0, len(on), step):
        few = on[i : i + step]
        for t in touched(*(c[few, None] for c in (ax, ay, bx, by)), *(c[near] for c in (ax, ay, bx, by))):
            k, j = np.nonzero((t > np.maximum(start[few, None], 1e-9)) & (t < np.minimum(stop[few, None], 1 - 1e-9)) & (of[few, None] != of[near]))
            which.append(k + i)
            at.append(np.round(t[k, j], 12))
    which, at = np.concatenate(which), np.concatenate(at)
    order = np.lexsort((at, which))
    which, at = which[order], at[order]
    side = on[which]
    x, y = np.round(ax[side] + at * (bx[side] - ax[side]), 6), np.round(ay[side] + at * (by[side] - ay[side]), 6)
    cut = np.flatnonzero((which[1:] == which[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    ends = np.column_stack([x[cut], y[cut], x[cut + 1], y[cut + 1]])
    turned = (ends[:, 0] > ends[:, 2]) | ((ends[:, 0] == ends[:, 2]) & (ends[:, 1] > ends[:, 3]))
    ends[turned] = ends[turned][:, [2, 3, 0, 1]]
    ends = np.unique(ends, axis=0)
    dx, dy = ends[:, 2] - ends[:, 0], ends[:, 3] - ends[:, 1]
    norm = np.sqrt(dx * dx + dy * dy)
    mx, my = (ends[:, 0] + ends[:, 2]) / 2, (ends[:, 1] + ends[:, 3]) / 2
    held = []
    flat = np.where(by == ay, 1.0, by - ay)
    step = max(1, PAIRS // len(ax))
    for s in (1, -1):
        px, py, inside = mx - s * grain * dy / norm, my + s * grain * dx / norm, np.zeros(len(mx), bool)
        for i in range(0, len(mx), step):
            x, y = px[i : i + step, None], py[i : i + step, None]
            crossed = ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / flat)
            inside[i : i + step] = (np.add.reduceat(crossed, first, axis=1, dtype=np.int32) % 2 == 1).any(axis=1)
        held.append(inside)
    left, right = held
    ends[right] = ends[right][:, [2, 3, 0, 1]]
    return ends[left != right]


def touched(ax, ay, bx, by, cx, cy, dx, dy) -> Iterator[np.ndarray]:
    """Shares of the way from a to b where the segment from c to d crosses or touches it, or ends on it, none where it doesn't."""
    rx, ry, sx, sy, qx, qy = bx - ax, by - ay, dx - cx, dy - cy, cx - ax, cy - ay
    turn, size, small = rx * sy - ry * sx, rx * rx + ry * ry, 1e-9
    flat = np.abs(turn) <= small * np.sqrt(size * (sx * sx + sy * sy))
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (qx * sy - qy * sx) / turn, (qx * ry - qy * rx) / turn
    yield np.where(~flat & (u >= -small) & (u <= 1 + small), t, np.nan)
    along = flat & (np.abs(qx * ry - qy * rx) <= small * size)
    yield np.where(along, (qx * rx + qy * ry) / size, np.nan)
    yield np.where(along, ((dx - ax) * rx + (dy - ay) * ry) / size, np.nan)


def outline_area(outline: DataFrame, group: str) -> DataFrame:
    """(group, area, pieces) of what `dissolved` returns."""
    return outline.groupBy(group).agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"), F.count(F.lit(1)).alias("pieces"))


def area_of(rings: Column) -> Column:
    """The first ring's area less that of the others."""

    def one(ring: Column) -> Column:
        n = F.size(ring)
        turn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
        return F.when(n > 2, F.abs(F.aggregate(turn, F.lit(0.0), lambda s, t: s + t)) / 2).otherwise(0.0)

    signed = F.transform(rings, lambda r, i: F.when(i == 0, one(r)).otherwise(-one(r)))
    return F.aggregate(signed, F.lit(0.0), lambda s, t: s + t)
