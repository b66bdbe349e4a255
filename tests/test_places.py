"""Polygons, bands, unions, sampled trips and corridors against plain versions, on tables with odd rows."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from rostrum.operators import corridors as K
from rostrum.operators import graph as G
from rostrum.operators import models as Z
from rostrum.operators import polygons as P
from rostrum.operators import trails as R
from rostrum.operators import ways as W

RINGS = "array<array<struct<x:double,y:double>>>"


def shape(rng, holes=True):
    """A star of random size, at times with a hole, at times tiny or huge."""
    cx, cy, r = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.01, 1, 10, 40])
    ring = lambda s: [(cx + s * r * rng.uniform(0.3, 1) * math.cos(a), cy + s * r * rng.uniform(0.3, 1) * math.sin(a)) for a in [2 * math.pi * k / 9 for k in range(9)]]
    return [ring(1), ring(0.3)] if holes and rng.random() < 0.5 else [ring(1)]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def test_points_in_a_table_of_polygons(spark):
    rng = random.Random(1)
    shapes = {k: shape(rng) for k in range(60)}
    shapes[60] = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]  # closed by its first corner
    shapes[61] = [[(5.0, 5.0), (5.0, 5.0)]]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(700)]
    points += [(1000 + k, *s[0][0]) for k, s in shapes.items()] + [(2000 + k, (s[0][0][0] + s[0][1][0]) / 2, (s[0][0][1] + s[0][1][1]) / 2) for k, s in shapes.items()]
    points += [(3000 + k, sum(c[0] for c in s[0]) / len(s[0]), sum(c[1] for c in s[0]) / len(s[0])) for k, s in shapes.items()]
    points += [(4000 + i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (2, 0), (0, 2), (4, 4), (2, 2), (1, 1)])]
    odd = [(9000, None, 1.0), (9001, float("nan"), 1.0), (9002, 1.0, None)]
    table = spark.createDataFrame([(k, s) for k, s in shapes.items()] + [(70, None), (71, []), (72, [[]])], f"parcel int, rings {RINGS}")
    got = {(r.id, r.parcel) for r in P.located(spark.createDataFrame(points + odd, "id int, x double, y double"), table, "parcel").collect()}
    assert got == {(i, k) for i, x, y in points for k, s in shapes.items() if inside(x, y, s)} and len(got) > 300
    assert P.located(spark.createDataFrame(points, "id int, x double, y double"), table.where("parcel >= 70"), "parcel").count() == 0
    assert P.located(spark.createDataFrame(odd, "id int, x double, y double"), table, "parcel").count() == 0


def test_located_by_group_and_edge_cells_hold_all_sides(spark):
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    table = spark.createDataFrame([("a", 1, square), ("b", 1, square)], f"town string, parcel int, rings {RINGS}")
    points = spark.createDataFrame([("a", 5.0, 5.0), ("b", 5.0, 5.0), ("c", 5.0, 5.0), ("a", 50.0, 5.0)], "town string, x double, y double")
    assert sorted((r.town, r.parcel) for r in P.located(points, table, "parcel", ["town"]).collect()) == [("a", 1), ("b", 1)]
    cells, bands = P.cover(table, ["town", "parcel"])
    edge = cells.where("edge").count() / 2
    assert cells.where("not edge").count() > 0 and 32 <= edge < 200 and bands.count() > 0


def test_parcels_in_a_band(spark):
    rng = random.Random(2)
    shapes = {k: shape(rng) for k in range(40)}
    shapes[40] = [[(-500.0, -500.0), (500.0, -500.0), (500.0, 500.0), (-500.0, 500.0)]]  # holds lines far from its sides
    lines = {k: [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(rng.randint(1, 4))] for k in range(15)}

    def point_gap(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def gap(a, b, c, d):
        if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
            return 0.0
        return min(point_gap(a, c, d), point_gap(b, c, d), point_gap(c, a, b), point_gap(d, a, b))

    want = {}
    for k, rings in shapes.items():
        for n, path in lines.items():
            d = min(gap(a, b, p, q) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) for p, q in (zip(path, path[1:], strict=False) if len(path) > 1 else [(path[0], path[0])]))
            d = 0.0 if inside(*path[0], rings) else d
            if d <= 6:
                want[k, n] = round(d, 6)
    polygons = spark.createDataFrame([(k, s) for k, s in shapes.items()], f"parcel int, rings {RINGS}")
    paths = spark.createDataFrame([(k, p) for k, p in lines.items()] + [(90, []), (91, None)], "line int, path array<struct<x:double,y:double>>")
    got = {(r.parcel, r.line): round(r.d, 6) for r in P.in_band(polygons, paths, "parcel", "line", 6.0).collect()}
    assert got == pytest.approx(want) and len(want) > 60 and 0.0 in want.values()


def rectangle(x, y, w, h):
    return [[(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]]


def test_union_counts_what_overlaps_once(spark):
    rng = random.Random(3)
    sites, rows = {}, []
    for site in range(12):
        own = [(rng.randrange(30), rng.randrange(30), rng.randint(1, 12), rng.randint(1, 12)) for _ in range(rng.randint(1, 14))]
        own += own[:2]  # equal lots
        if site == 0:
            own = [(0, 0, 4, 4), (4, 0, 4, 4), (0, 4, 4, 4), (4, 4, 4, 4), (20, 0, 3, 3), (21, 1, 1, 1)]  # they share sides; one lies in another
        sites[site] = {(x, y) for ox, oy, w, h in own for x in range(ox, ox + w) for y in range(oy, oy + h)}
        rows += [(site, len(rows) + k, rectangle(*r)) for k, r in enumerate(own)]
    out = P.dissolved(spark.createDataFrame([*rows, (None, 999, rectangle(0, 0, 1, 1)), (50, 998, None)], f"site int, lot int, rings {RINGS}"), "site", "lot")
    got = {r.site: r.area for r in P.outline_area(out, "site").collect()}
    assert got == pytest.approx({k: float(len(v)) for k, v in sites.items()})
    border = lambda c: sum((x + i, y + j) not in c for x, y in c for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    length = {r.site: r.n for r in out.groupBy("site").agg(F.sum(F.abs(F.col("ax") - F.col("bx")) + F.abs(F.col("ay") - F.col("by"))).alias("n")).collect()}
    assert length == pytest.approx({k: float(border(v)) for k, v in sites.items()})


def test_union_of_slanted_shapes(spark):
    diamond = lambda x, y, r: [[(x - r, y), (x, y - r), (x + r, y), (x, y + r)]]
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    holed = [*square, [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)]]
    rows = [("two", 1, square), ("two", 2, diamond(10.0, 5.0, 5.0)), ("hole", 3, holed), ("hole", 4, diamond(5.0, 5.0, 2.0)), ("filled", 5, holed), ("filled", 6, [holed[1]]), ("turned", 7, [square[0][::-1]])]
    got = {r.site: r.area for r in P.outline_area(P.dissolved(spark.createDataFrame(rows, f"site string, lot int, rings {RINGS}"), "site", "lot"), "site").collect()}
    assert got == pytest.approx({"two": 125.0, "hole": 64.0 + 8.0, "filled": 100.0, "turned": 100.0})


# trips


def plain_ways(edges, source):
    best, todo = {source: 0.0}, [source]
    while todo:
        u = todo.pop()
        for a, b, m in edges:
            if a == u and best[u] + m < best.get(b, math.inf):
                best[b] = best[u] + m
                todo.append(b)
    return best


def plain_path(edges, best, source, node):
    path = []
    while node != source:
        before = min(a for a, b, m in edges if b == node and a in best and best[a] + m == best[node])
        path.append((before, node))
        node = before
    return path


def test_sampled_baseline_counts_every_edge_of_every_trip(spark):
    rng = random.Random(4)
    edges = sorted({(u, v, float(rng.randint(1, 4))) for u in range(24) for v in rng.sample(range(24), 3) if u != v})
    edges = [e for e in edges if e[1] != 23]  # nothing leads to 23
    table = spark.createDataFrame(edges, "u int, v int, minutes double")
    pop = spark.createDataFrame([(k, float(k % 5)) for k in range(24)], "node int, weight double")
    shops = spark.createDataFrame([(k, 3.0 if k in (2, 9, 23) else 0.0) for k in range(24)] + [(24, None)], "node int, weight double")
    trips = [(r["from"], r["to"]) for r in G.sampled_pairs(pop, 2000, 5, shops).collect()]
    assert len(trips) == 2000 and {t for _, t in trips} == {2, 9, 23} and all(f % 5 for f, _ in trips)
    want = collections.Counter()
    for f, t in trips:
        best = plain_ways(edges, f)
        if t in best:
            want.update(plain_path(edges, best, f, t))
    got = {(r.u, r.v): r["count"] for r in G.sampled_baseline(table, pop, shops, 2000, 5).collect()}
    assert got == dict(want)


def test_draws_follow_the_weights_and_none_is_lost(spark):
    heavy = spark.createDataFrame([(k, 1000.0 if k == 7 else 0.1 + k % 3) for k in range(900)], "node int, weight double")
    rows = G.drawn(heavy, 20000, 1, "from").collect()
    assert sorted(r.draw for r in rows) == list(range(20000))
    total = 1000 + sum(0.1 + k % 3 for k in range(900) if k != 7)
    assert sum(r.node == 7 for r in rows) / 20000 == pytest.approx(1000 / total, abs=0.01)
    assert sum(r.node % 3 == 0 for r in rows) / 20000 == pytest.approx(0.1 * 300 / total, abs=0.01)


def test_long_ways_take_few_rounds(spark):
    chain = spark.createDataFrame([(0, k, k - 1 if k else None) for k in range(200)], "source int, node int, previous int")
    got = {(r.u, r.v): r.amount for r in G.gathered(chain, spark.createDataFrame([(0, 199, 2.0), (0, 100, 1.0)], "source int, node int, amount double"), rounds=9).collect()}
    assert got == {(k - 1, k): 3.0 if k <= 100 else 2.0 for k in range(1, 200)}


def test_equal_ways_end_with_the_smallest_node(spark):
    edges = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (2, 4, 1.0), (4, 3, 1.0), (1, 3, 1.0), (3, 5, 0.0)], "u int, v int, minutes double")
    got = {r.node: (r.minutes, r.previous) for r in G.shortest(edges, spark.createDataFrame([(0,)], "source int")).collect()}
    assert got == {0: (0.0, None), 1: (2.0, 0), 2: (1.0, 0), 4: (2.0, 2), 3: (3.0, 1), 5: (3.0, 3)}


def test_edge_changes(spark):
    flows = spark.createDataFrame([(0, 1, 10.0), (1, 2, 6.0), (2, 3, 1.0)], "u int, v int, flow double")
    counts = spark.createDataFrame([(0, 1, 5), (1, 2, 4)], "u int, v int, count int")
    assert [r.change for r in G.edge_changes(flows, counts, 0.5).orderBy("u").collect()] == [400.0, None, None]


# corridors


STEP = 0.001


def town():
    """Main Street runs through nodes 1 to 5; A Street meets it at 2, B Street at 4."""
    nodes = {k: (k * STEP, 0.0) for k in range(1, 6)} | {10: (2 * STEP, STEP), 11: (4 * STEP, STEP)}
    ways = [(k, k + 1, "Main Street", 100.0) for k in range(1, 5)] + [(2, 10, "A Street", 80.0), (4, 11, "B Street", 80.0)]
    return nodes, ways


def asked(spark, nodes, ways, *requests, inside=None):
    both = [(u, v, s, m) for a, b, s, m in ways for u, v in ((a, b), (b, a))]
    edges = spark.createDataFrame(both, "u int, v int, street string, length double")
    table = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node int, x double, y double")
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], "request int, street string, from_street string, to_street string")
    found, steps = K.resolved(rows, edges, table, spark.createDataFrame([(k,) for k in inside], "node int") if inside else None)
    parts = collections.defaultdict(set)
    for r in steps.collect():
        parts[r.request].add(frozenset((r.u, r.v)))
    return {r.request: (r.method, r.length, r.note) for r in found.collect()}, parts


def test_corridors_between_cross_streets(spark):
    got, parts = asked(spark, *town(), ("Main Street", "A Street", "B Street"), ("Main St.", "A St", "b st"), ("Main Street", "B Street", "A Street"), ("Oak Avenue", None, None), ("Main Street", "A Street", "Nonexistent Road"), ("Main Street", "A Street", "A Street"), (None, None, None))
    assert [got[k] for k in (0, 1, 2)] == [("between cross streets", 200.0, None)] * 3 and parts[0] == {frozenset((2, 3)), frozenset((3, 4))}
    assert got[3][2] == "no street named Oak Avenue" and got[4][2] == "no street named Nonexistent Road" and got[5][2] == "the crossings aren't connected" and got[6][2] == "no street named "
    assert not parts[3] and not parts[4]


def test_corridor_snaps_to_a_cross_street_that_ends_near_by(spark):
    nodes, ways = town()
    nodes |= {12: (3 * STEP, 0.0005), 13: (3 * STEP, 0.002), 20: (0.05, 0.05), 21: (0.05, 0.06)}
    ways += [(12, 13, "C Street", 150.0), (20, 21, "D Street", 100.0)]
    got, parts = asked(spark, nodes, ways, ("Main Street", "A Street", "C Street"), ("Main Street", "A Street", "D Street"))
    assert got[0] == ("between cross streets", 100.0, None) and parts[0] == {frozenset((2, 3))}
    assert got[1][2] == "Main Street and D Street share no intersection"


def test_corridor_bridges_a_gap_in_the_naming_but_no_more(spark):
    nodes, ways = town()
    bridged = [(u, v, "Route 236" if (u, v) == (3, 4) else s, m) for u, v, s, m in ways]
    got, parts = asked(spark, nodes, bridged, ("Main Street", "A Street", "B Street"))
    assert got[0] == ("between cross streets", 200.0, None) and len(parts[0]) == 2
    lost = [(u, v, None if u in (2, 3) and v in (3, 4) else s, m) for u, v, s, m in ways]
    got, parts = asked(spark, nodes, lost, ("Main Street", "A Street", "B Street"))
    assert got[0][2] == "the way runs mostly off the street" and not parts[0]


def test_whole_street_is_its_longest_stretch_inside(spark):
    got, parts = asked(spark, *town(), ("Main Street", None, None), ("Main Street", "A Street", None), inside=[1, 2, 3, 4, 10, 11])
    assert got[0] == got[1] == ("whole street", 300.0, None) and len(parts[0]) == 3
    nodes, ways = town()
    cut = [w for w in ways if w[:2] != (2, 3)]
    got, parts = asked(spark, nodes, cut, ("Main Street", None, None))
    assert got[0] == ("whole street", 200.0, None) and parts[0] == {frozenset((3, 4)), frozenset((4, 5))}
    got, _ = asked(spark, nodes, cut, ("Main Street", None, None), inside=[10, 11])
    assert got[0][2] == "the street isn't inside the boundary"


# lines through a network


def test_points_near_lines_and_how_far_along(spark):
    rng = random.Random(9)
    lines = {k: [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(rng.randint(2, 5))] for k in range(12)} | {20: [(5.0, 5.0)], 21: []}
    points = {k: (rng.uniform(-5, 65), rng.uniform(-5, 65)) for k in range(150)}
    want = {}
    for n, path in lines.items():
        for k, (x, y) in points.items():
            best, walked = None, 0.0
            for (ax, ay), (bx, by) in zip(path, path[1:], strict=False):
                dx, dy = bx - ax, by - ay
                t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
                found = (math.hypot(x - ax - t * dx, y - ay - t * dy), walked + t * math.hypot(dx, dy))
                best = min(best or found, found)
                walked += math.hypot(dx, dy)
            if best and best[0] <= 4:
                want[n, k] = (round(best[0], 6), round(best[1], 6))
    got = P.near_lines(spark.createDataFrame([(k, *v) for k, v in points.items()] + [(999, None, 1.0)], "id int, x double, y double"), spark.createDataFrame(list(lines.items()), "line int, path array<struct<x:double,y:double>>"), "id", "line", 4.0)
    assert {(r.line, r.id): (round(r.d, 6), round(r.along, 6)) for r in got.collect()} == want and len(want) > 50


def network(spark):
    """Nodes 0 to 9, 100 apart along a street, and the street."""
    nodes = spark.createDataFrame([(k, 100.0 * k, 0.0) for k in range(10)], "node int, x double, y double")
    edges = spark.createDataFrame([(u, v, 1.0, 100.0) for k in range(9) for u, v in ((k, k + 1), (k + 1, k))], "u int, v int, minutes double, length double")
    return nodes, edges


def test_bike_spending_is_dealt_in_full(spark):
    nodes, edges = network(spark)
    lines = spark.createDataFrame([(1, [(0.0, 10.0), (300.0, 10.0)]), (2, [(0.0, 9000.0), (300.0, 9000.0)]), (3, [(850.0, 20.0), (900.0, 20.0)])], "corridor int, path array<struct<x:double,y:double>>")
    blocks = spark.createDataFrame([(k, 100.0) for k in range(10)] + [(77, 1e6)], "node int, pop double")
    shops = spark.createDataFrame([(1, "restaurant_bar", 10.0, 50.0), (2, "grocery", 20.0, 50.0), (3, "retail_comparison", 30.0, 90.0), (4, "retail_convenience", 30.0, 500.0)], "shop int, taxonomy string, x double, y double")
    out, each = R.bike_corridors(lines, nodes, edges, blocks, shops)
    got = {r.corridor: r for r in out.collect()}
    minutes = [0, 0, 0, 0, 1, 2, 3, 4, 5, 6]
    v, lo, hi = Z.ASSUMPTIONS["beta_bike"]
    people = [sum(100 * math.exp(-b * t) for t in minutes) for b in (v, hi, lo)]
    assert [got[1].catchment[k] for k in range(3)] == pytest.approx(people) and got[1].shops == 3 and got[1].note is None
    assert got[1].spending.value == pytest.approx(people[0] * 0.035 * 0.1 * 365 * (12 / 3 + 10 * 2 / 3)) and got[1].catchment.low < got[1].catchment.value < got[1].catchment.high
    dealt = each.where("corridor = 1").agg(*[F.sum(f"dollars.{c}") for c in ("value", "low", "high")]).first()
    assert list(dealt) == pytest.approx(list(got[1].spending)) and got[1].uplift.value == pytest.approx(got[1].spending.value / (3 * 800000))
    assert (got[2].note, got[2].catchment, got[2].spending, got[2].shops) == ("the corridor touches no nodes", None, None, None)
    assert got[3].note == "no retail beside the corridor" and got[3].catchment.value > 0 and got[3].spending is None


def test_trail_spending_is_dealt_in_full(spark):
    nodes, edges = network(spark)
    lines = spark.createDataFrame([(1, [(0.0, 10.0), (620.0, 10.0)]), (2, [(0.0, 9000.0), (300.0, 9000.0)])], "trail int, path array<struct<x:double,y:double>>")
    blocks = spark.createDataFrame([(k, k, 10.0 + k) for k in range(10)], "block int, node int, pop double")
    shops = spark.createDataFrame([(1, 0), (2, 9), (3, 55)], "shop int, node int")
    lot = lambda x, y: [[(x, y), (x + 10, y), (x + 10, y + 10)]]
    parcels = spark.createDataFrame([("a", lot(0.0, 400.0), 1000.0), ("b", lot(0.0, 600.0), 500.0), ("c", lot(50.0, -300.0), None)], f"pin string, rings {RINGS}, assessed double")
    assert sorted((r.trail, r.node, r.along) for r in R.access_points(lines, nodes).collect()) == [(1, 0, 0.0), (1, 3, 300.0), (1, 6, 600.0)]
    out, each = R.trails(lines, nodes, edges, blocks, shops, parcels)
    got = {r.trail: r for r in out.collect()}
    km = [0, 0.1, 0.1, 0, 0.1, 0.1, 0, 0.1, 0.2, 0.3]
    assert got[1].access == 3 and got[1].catchment.value == pytest.approx(sum((10 + k) * math.exp(-0.333 * d) for k, d in enumerate(km)))
    assert (got[1].parcels, got[1].assessed) == (2, 1000.0) and got[1].tax.value == pytest.approx(1000 * 0.03 * 0.010725)
    dealt = each.agg(*[F.sum(f"dollars.{c}") for c in ("value", "low", "high")]).first()
    assert list(dealt) == pytest.approx(list(got[1].spending)) and {r.shop for r in each.collect()} == {1, 2}
    assert (got[2].note, got[2].access, got[2].spending) == ("the trail touches no nodes", 0, None)


def test_access_points_are_thinned_evenly(spark):
    nodes = spark.createDataFrame([(k, 256.0 * k, 0.0) for k in range(97)], "node int, x double, y double")
    line = spark.createDataFrame([(1, [(0.0, 0.0), (25000.0, 0.0)])], "trail int, path array<struct<x:double,y:double>>")
    assert sorted(r.node for r in R.access_points(line, nodes).collect()) == [int(i * 97 / 40) for i in range(40)]


def test_nearest_places_near_and_far(spark):
    from rostrum.operators import spatial as S

    rng = random.Random(10)
    to = {k: (rng.gauss(0, 3), rng.gauss(0, 3)) for k in range(300)} | {k: (50.0 + k % 7, 50.0) for k in range(300, 340)} | {400: (1e6, -1e6)}
    from_ = {k: (rng.uniform(-20, 70), rng.uniform(-20, 70)) for k in range(150)} | {200: (1e5, 1e5), 201: (-1e9, 0.0), 202: (9e5, -9e5), 203: to[3], 204: (53.5, 50.0)}
    want = {k: min((math.sqrt((x - a) ** 2 + (y - b) ** 2), n) for n, (a, b) in to.items()) for k, (x, y) in from_.items()}
    table = spark.createDataFrame([(k, *v) for k, v in from_.items()] + [(999, None, 1.0)], "id int, x double, y double")
    places = spark.createDataFrame([(k, *v) for k, v in to.items()] + [(998, None, 1.0)], "place int, x double, y double")
    got = {r.id: (r.d, r.place) for r in S.nearest(table, places, "id", "place", 0.5).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and all(got[k][0] == pytest.approx(want[k][0]) for k in want)
    assert S.nearest(table, places.where("place = 998"), "id", "place", 1.0).count() == 0
    one = S.nearest(table, places.where("place = 400"), "id", "place", 1.0).collect()
    assert len(one) == len(from_) and {r.place for r in one} == {400}


def test_ways_of_a_thousand_steps(spark):
    n = 1000
    chain = spark.createDataFrame([(u, v, 1.0) for k in range(n) for u, v in ((k, k + 1), (k + 1, k))], "u int, v int, minutes double")
    got = {r.node: (r.minutes, r.previous) for r in G.shortest(chain, spark.createDataFrame([(0,)], "source int")).collect()}
    assert got == {k: (float(k), k - 1 if k else None) for k in range(n + 1)}


def random_network(seed):
    rng = random.Random(seed)
    edges = [(u, v, float(rng.randint(0, 3))) for u in range(30) for v in rng.sample(range(30), 3) if u != v]
    return edges + edges[:5] + [(0, 29, 50.0), (40, 41, 1.0)]


def test_ways_in_tasks_and_in_rounds_are_the_same(spark):
    edges = [(u, v, m + 0.5) for u, v, m in random_network(11)]
    table = spark.createDataFrame([*edges, (None, 3, 1.0), (3, None, 1.0), (3, 5, None)], "u int, v int, minutes double")
    starts = spark.createDataFrame([("a", 0), ("a", 7), ("b", 3), ("c", 99)], "source string, node int")
    few, many = ({(r.source, r.node): (r.minutes, r.previous) for r in df.collect()} for df in (G.shortest(table, starts), G.relaxed(W.sound(table), starts)))
    assert few == many and few["c", 99] == (0.0, None) and few["a", 7] == (0.0, None) and len(few) > 50


def test_loads_go_along_ways_with_steps_of_no_time(spark):
    edges = random_network(12)
    table = spark.createDataFrame(edges, "u int, v int, minutes double")
    loads = [(s, t, float(1 + (s * t) % 4)) for s in range(0, 30, 4) for t in range(0, 30, 3)] + [(1, 41, 9.0), (77, 1, 2.0)]
    got = {(r.u, r.v): r.amount for r in G.carried(table, spark.createDataFrame(loads, "source int, node int, amount double")).collect()}
    out, in_ = collections.Counter(), collections.Counter()
    for (u, v), a in got.items():
        out[u] += a
        in_[v] += a
    ways = {s: plain_ways(edges, s) for s in {s for s, _, _ in loads}}
    sent = [(s, t, a) for s, t, a in loads if t in ways[s] and s != t]
    for k in range(30):  # what comes in and isn't passed on stays
        assert in_[k] - out[k] == pytest.approx(sum(a for _, t, a in sent if t == k) - sum(a for s, _, a in sent if s == k))
    least = {(u, v): min(m for a, b, m in edges if (a, b) == (u, v)) for u, v, _ in edges}
    assert sum(a * least[e] for e, a in got.items()) == pytest.approx(sum(a * ways[s][t] for s, t, a in sent))


def test_checkpoints_forget_the_estimates_of_their_plans(spark):
    df = spark.range(4).selectExpr("id as a", "id as b")
    for _ in range(4):
        df = G.cut_lineage(df.join(df.selectExpr("a as b", "b as c"), "b").select("a", F.col("c").alias("b")))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64


def crowd(seed, n=260):
    """Points in clumps and alone, some at one place, and odd ones."""
    rng = random.Random(seed)
    places = [(rng.gauss(0, 3), rng.gauss(0, 3)) if k % 3 else (rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(n)]
    places[5] = places[4] = places[50]
    return {k: (x, y, ("a", "b")[k % 5 == 0]) for k, (x, y) in enumerate(places)}


def plain_roots(links, nodes):
    root = {k: k for k in nodes}
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_of_one_name_by_cells(spark, monkeypatch):
    from rostrum.operators import cells as C

    points = crowd(20)
    table = spark.createDataFrame([(k, *v) for k, v in points.items()] + [(900, None, 1.0, "a"), (901, 1.0, 1.0, ""), (902, float("nan"), 1.0, "a"), (903, 1.0, 1.0, None)], "id long, x double, y double, name string")
    for radius in (0.7, 4.0):
        links = [(a, b) for a, (x, y, n) in points.items() for b, (p, q, m) in points.items() if a != b and n == m and math.sqrt((x - p) ** 2 + (y - q) ** 2) <= radius]
        linked = {a for a, _ in links}
        want = {k: r for k, r in plain_roots(links, points).items() if k in linked}
        assert {r.node: r.root for r in C.named_components(table, "name", "id", radius).collect()} == want
        monkeypatch.setattr(C, "SMALL_PIECE", 3)  # cells of several pieces


def test_clusters_by_cells(spark):
    from rostrum.operators import spatial as S

    points = crowd(21)
    near = {a: [b for b, (p, q, _) in points.items() if math.sqrt((x - p) ** 2 + (y - q) ** 2) <= 1.0] for a, (x, y, _) in points.items()}
    core = {k for k, v in near.items() if len(v) >= 4}
    root = plain_roots([(a, b) for a in core for b in near[a] if b in core], core)
    want = {k: root[k] if k in core else min((root[b] for b in near[k] if b in core), default=None) for k in points}
    table = spark.createDataFrame([(k, x, y) for k, (x, y, _) in points.items()] + [(900, None, 1.0)], "point_id long, x double, y double")
    assert {r.point_id: r.cluster for r in S.dbscan(table, 1.0, 4).collect()} == want | {900: None} and len(core) > 50 and None in want.values()


def test_sums_near_by_pieces(spark, monkeypatch):
    from rostrum.operators import cells as C

    monkeypatch.setattr(C, "PIECE", 7)
    monkeypatch.setattr(C, "BLOCK", 20)
    points, centres = crowd(22), {k: v[:2] for k, v in crowd(23, 80).items()} | {500: (900.0, 900.0)}
    table = spark.createDataFrame([(k, x, y, 1.0 + k % 7, k % 3) for k, (x, y, _) in points.items()] + [(900, None, 1.0, 1.0, 1)], "id long, x double, y double, w double, kind long")
    near = {c: [(k, d) for k, (p, q, _) in points.items() if (d := math.sqrt((x - p) ** 2 + (y - q) ** 2)) <= 5] for c, (x, y) in centres.items()}
    at = spark.createDataFrame([(k, *v) for k, v in centres.items()], "node_id long, x double, y double")
    got = {r.node_id: (r.a, r.b) for r in C.sums_near(at, table, 5.0, "node_id", ["w"], {"a": 0.1, "b": 0.0}).collect()}
    assert set(got) == {c for c, v in near.items() if v}
    assert all(got[c] == pytest.approx((sum((1 + k % 7) * math.exp(-0.1 * d) for k, d in near[c]), sum(1 + k % 7 for k, _ in near[c]))) for c in got)
    from rostrum.operators import spatial as S

    counts = {r.node_id: (r.kind_0, r.kind_2) for r in S.counts_near(at, table, 5.0, "kind", [0, 2]).collect()}
    assert counts == {c: (sum(k % 3 == 0 for k, _ in v), sum(k % 3 == 2 for k, _ in v)) for c, v in near.items()} and counts[500] == (0, 0)


def test_components_in_a_task_and_in_rounds_are_the_same(spark, monkeypatch):
    rng = random.Random(24)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(k, k + 1) for k in range(300, 360)]
    table = spark.createDataFrame(links, "a long, b long")
    one = {r.node: r.root for r in G.components(table).collect()}
    monkeypatch.setattr(W, "MOST_EDGES", 0)
    assert one == {r.node: r.root for r in G.components(table).collect()} == {k: r for k, r in plain_roots(links, {x for e in links for x in e}).items()}


def test_outline_in_a_tile_takes_blocks_and_skips_covered_tiles(spark, monkeypatch):
    monkeypatch.setattr(P, "PAIRS", 40)
    rng = random.Random(25)
    own = [(rng.randrange(60), rng.randrange(60), rng.randint(5, 25), rng.randint(5, 25)) for _ in range(60)] + [(10, 10, 40, 40)]
    held = {(x, y) for ox, oy, w, h in own for x in range(ox, ox + w) for y in range(oy, oy + h)}
    rows = [("a", k, rectangle(*r)) for k, r in enumerate(own)]
    table = spark.createDataFrame(rows, f"site string, lot int, rings {RINGS}")
    out = P.dissolved(table, "site", "lot")
    assert P.outline_area(out, "site").first().area == pytest.approx(float(len(held)))
    border = sum((x + i, y + j) not in held for x, y in held for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    assert out.agg(F.sum(F.abs(F.col("ax") - F.col("bx")) + F.abs(F.col("ay") - F.col("by")))).first()[0] == pytest.approx(float(border))
    edges = P.sides(table, ["site", "lot"]).withColumn("cell", F.lit(4.0))
    spans = edges.groupBy("site", "lot").agg(F.min(F.least("ax", "bx")).alias("lox"), F.max(F.greatest("ax", "bx")).alias("hix"))
    covered = {(r.cx, r.cy) for r in P.covered_cells(edges.join(spans, ["site", "lot"]), ["site", "lot"]).collect()}
    assert len(covered) > 50 and all((4 * i + x, 4 * j + y) in held for i, j in covered for x in range(4) for y in range(4))


def test_nearest_joins_few_places_where_they_lie_close(spark, monkeypatch):
    from rostrum.operators import spatial as S

    rng = random.Random(26)
    to = {k: (rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(400)} | {k: (50 + rng.gauss(0, 0.5), 50.0) for k in range(400, 500)}
    from_ = {k: (rng.uniform(-5, 105), rng.uniform(-5, 105)) for k in range(200)} | {300: (50.0, 50.0)}
    late = []
    tree = S.nearest_by_tree
    monkeypatch.setattr(S, "nearest_by_tree", lambda left, *a: (late.append(left.count()), tree(left, *a))[1])
    got = {r.id: r.place for r in S.nearest(spark.createDataFrame([(k, *v) for k, v in from_.items()], "id int, x double, y double"), spark.createDataFrame([(k, *v) for k, v in to.items()], "place int, x double, y double"), "id", "place", 1000.0).collect()}
    assert got == {k: min((math.sqrt((x - a) ** 2 + (y - b) ** 2), n) for n, (a, b) in to.items())[1] for k, (x, y) in from_.items()}
    assert late and 0 < late[0] < 60  # a radius of 1000 would have joined all with all
