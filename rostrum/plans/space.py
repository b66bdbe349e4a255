"""Queries over points, networks and the models built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import cells as C
from rostrum.operators import graph as G
from rostrum.operators import models as Z
from rostrum.operators import spatial as S
from rostrum.plans.registry import registry
from rostrum.sources.tables import load

QUERIES, ORACLES, query = registry()


@query("nodes points", "SELECT n.node_id, coalesce(sum(p.pop), 0) AS pop FROM nodes n LEFT JOIN points p ON sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) <= 400 GROUP BY 1")
def j22_radius_pop(s, d):  # J22
    return S.population_near(load(s, d, "nodes"), load(s, d, "points"), 400.0).select("node_id", "pop")


@query("nodes points", "SELECT n.node_id, " + ", ".join(f"count(*) FILTER (p.kind = {k}) AS kind_{k}" for k in range(5)) + " FROM nodes n LEFT JOIN points p ON sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) <= 1500 GROUP BY 1")
def j23_poi_pivot(s, d):  # J23
    return S.counts_near(load(s, d, "nodes"), load(s, d, "points"), 1500.0, "kind", [0, 1, 2, 3, 4])


@query("points", "SELECT a.point_id AS a, b.point_id AS b FROM points a JOIN points b ON a.kind = b.kind AND a.point_id < b.point_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 300")
def j24_near_dupes(s, d):  # J24
    return S.same_name_pairs(load(s, d, "points").withColumn("name", F.col("kind").cast("string")), "name", "point_id", 300.0)


@query("points", """WITH RECURSIVE l AS (SELECT a.point_id AS a, b.point_id AS b FROM points a JOIN points b ON a.kind = b.kind AND a.point_id <> b.point_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 300),
    r AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a) SELECT node, least(node, min(other)) AS root FROM r GROUP BY node""")
def g08_components(s, d):  # G08
    return C.named_components(load(s, d, "points").withColumn("name", F.col("kind").cast("string")), "name", "point_id", 300.0)


@query("points nodes", "SELECT p.point_id, n.node_id, round(sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)), 6) AS d FROM points p, nodes n QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)), n.node_id) = 1")
def j25_nearest(s, d):  # J25
    return S.nearest(load(s, d, "points").select("point_id", "x", "y"), load(s, d, "nodes"), "point_id", "node_id", 600.0).select("point_id", "node_id", F.round("d", 6).alias("d"))


LINE = [(500.0, 500.0), (4000.0, 5200.0), (9000.0, 6000.0)]


def _segment(a, b):
    (ax, ay), (bx, by) = a, b
    dx, dy = bx - ax, by - ay
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - {ax}) * {dx} + (y - {ay}) * {dy}) / ({dx}::DOUBLE * {dx} + {dy}::DOUBLE * {dy})))"
    return f"sqrt(pow(x - ({ax} + {t} * {dx}), 2) + pow(y - ({ay} + {t} * {dy}), 2))"


@query("points", f"SELECT point_id, round(d, 6) AS d FROM (SELECT point_id, least({', '.join(_segment(a, b) for a, b in zip(LINE, LINE[1:], strict=False))}) AS d FROM points) WHERE d <= 700")
def j26_near_line(s, d):  # J26, J27
    return S.near_line(load(s, d, "points"), LINE, 700.0).select("point_id", F.round("d", 6).alias("d"))


RING = [(1000.0, 1000.0), (8000.0, 2000.0), (6500.0, 5000.0), (9000.0, 9000.0), (2000.0, 7500.0)]


def _crossings():
    parts = []
    for (ax, ay), (bx, by) in zip(RING, [*RING[1:], RING[0]], strict=True):
        parts.append(f"CASE WHEN (({ay} > y) <> ({by} > y)) AND x < {ax}::DOUBLE + (y - {ay}) * ({bx}::DOUBLE - {ax}) / ({by}::DOUBLE - {ay}) THEN 1 ELSE 0 END")
    return " + ".join(parts)


@query("points", f"SELECT point_id FROM points WHERE ({_crossings()}) % 2 = 1")
def j28_point_in_polygon(s, d):  # J28, P21
    return load(s, d, "points").where(S.in_polygon(F.col("x"), F.col("y"), RING)).select("point_id")


@query("points", "SELECT kind, min(x) - 10 AS west, max(x) + 10 AS east, min(y) - 10 AS south, max(y) + 10 AS north, avg(x) AS mx, avg(y) AS my FROM points GROUP BY 1")
def a30_bounding_box(s, d):  # A27, A30
    return load(s, d, "points").groupBy("kind").agg((F.min("x") - 10).alias("west"), (F.max("x") + 10).alias("east"), (F.min("y") - 10).alias("south"), (F.max("y") + 10).alias("north"), F.avg("x").alias("mx"), F.avg("y").alias("my"))


@query("points nodes", "SELECT n.node_id, " + ", ".join(f"round(sum(p.pop * exp(-{b} * sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) / 1000)), 6) AS {c}" for c, b in (("mid", 0.333), ("low", 0.45), ("high", 0.25))) + " FROM nodes n, points p WHERE sqrt((n.x - p.x) * (n.x - p.x) + (n.y - p.y) * (n.y - p.y)) <= 2000 GROUP BY 1")
def a18_decay_catchment(s, d):  # A18
    near = C.sums_near(load(s, d, "nodes"), load(s, d, "points"), 2000.0, "node_id", ["pop"], {"mid": 0.333 / 1000, "low": 0.45 / 1000, "high": 0.25 / 1000})
    return near.select("node_id", *[F.round(c, 6).alias(c) for c in ("mid", "low", "high")])


@query("points", """WITH RECURSIVE pr AS (SELECT a.point_id AS a, b.point_id AS b FROM points a JOIN points b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 250), core AS (SELECT a FROM pr GROUP BY 1 HAVING count(*) >= 4),
    st AS (SELECT pr.a, pr.b FROM pr JOIN core c1 ON pr.a = c1.a JOIN core c2 ON pr.b = c2.a), r AS (SELECT a AS node, b AS other FROM st UNION SELECT r.node, st.b FROM r JOIN st ON r.other = st.a), roots AS (SELECT node, min(other) AS root FROM r GROUP BY 1)
    SELECT p.point_id, coalesce(max(o.root), min(n.root)) AS cluster FROM points p LEFT JOIN roots o ON o.node = p.point_id LEFT JOIN pr ON pr.a = p.point_id LEFT JOIN roots n ON n.node = pr.b GROUP BY 1""")
def g09_dbscan(s, d):  # G09
    return S.dbscan(load(s, d, "points"), 250.0, 4)


@query("edges", """WITH RECURSIVE w AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS minutes, 0 AS hops UNION SELECT e.v, w.minutes + e.minutes, w.hops + 1 FROM w JOIN edges e ON e.u = w.node WHERE w.hops < 24 AND w.minutes + e.minutes <= 40)
    SELECT node, min(minutes) AS minutes FROM w GROUP BY 1""")
def g01_dijkstra(s, d):  # G01
    return G.shortest(load(s, d, "edges"), s.createDataFrame([(0,)], "source int")).select(F.col("node").cast("long").alias("node"), "minutes")


@query("edges", """WITH RECURSIVE w AS (SELECT CAST(unnest([0, 7, 15]) AS BIGINT) AS source, 0 AS z), f AS (SELECT source, source AS node, CAST(0 AS DOUBLE) AS minutes, 0 AS hops FROM w UNION SELECT f.source, e.v, f.minutes + e.minutes, f.hops + 1 FROM f JOIN edges e ON e.u = f.node WHERE f.hops < 24 AND f.minutes + e.minutes <= 40),
    b AS (SELECT source, node, min(minutes) AS minutes FROM f GROUP BY 1, 2) SELECT node, source, minutes FROM b QUALIFY row_number() OVER (PARTITION BY node ORDER BY minutes, source) = 1""")
def g03_nearest_access(s, d):  # G02, G03
    return G.nearest_source(load(s, d, "edges"), s.createDataFrame([(0,), (7,), (15,)], "source int")).select(F.col("node").cast("long").alias("node"), F.col("source").cast("long").alias("source"), "minutes")


@query("edges", "WITH e AS (SELECT u, v, CASE WHEN u % 5 = 0 THEN NULL ELSE 'street ' || CAST((u + v) % 7 AS VARCHAR) END AS street FROM edges), x AS (SELECT u AS node, street FROM e UNION ALL SELECT v, street FROM e), n AS (SELECT node, list_sort(list_distinct(list(street))) AS names FROM x WHERE street IS NOT NULL GROUP BY 1) SELECT CAST(node AS BIGINT) AS node, array_to_string(names[1:2], ' & ') AS label FROM n WHERE len(names) >= 2")
def a29_crossings(s, d):  # A29
    street = F.when(F.col("u") % 5 != 0, F.concat(F.lit("street "), ((F.col("u") + F.col("v")) % 7).cast("string")))
    return G.crossings(load(s, d, "edges").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), street.alias("street")))


U = "CASE WHEN attractiveness > 0 THEN attractiveness * exp(-{b} * {m}) ELSE 0 END"


@query("destinations", f"SELECT origin, dest, round(coalesce(u / nullif(sum(u) OVER (PARTITION BY origin), 0), 0), 9) AS p FROM (SELECT *, {U.format(b=0.1, m='walk_min')} AS u FROM destinations)")
def m03_huff(s, d):  # M03, M06
    return Z.huff(load(s, d, "destinations"), ["origin"], "walk_min").select("origin", "dest", F.round("p", 9).alias("p"))


@query("destinations", f"WITH x AS (SELECT *, {U.format(b=0.1, m='walk_min')} AS w, {U.format(b=0.15, m='drive_min')} AS v FROM destinations) SELECT origin, dest, round(0.6 * w / sum(w) OVER (PARTITION BY origin) + 0.4 * v / sum(v) OVER (PARTITION BY origin), 9) AS p FROM x")
def m04_blended(s, d):  # M04
    return Z.blended(load(s, d, "destinations"), ["origin"], 0.6).select("origin", "dest", F.round("p", 9).alias("p"))


@query("destinations", f"""WITH x AS (SELECT *, 0.6 * {U.format(b=0.1, m='walk_min')} AS w, 0.02 * {U.format(b=0.1, m='bike_min')} AS b, 0.38 * {U.format(b=0.15, m='drive_min')} AS v FROM destinations), t AS (SELECT *, sum(w + b + v) OVER (PARTITION BY origin) AS total FROM x)
    SELECT origin, dest, round(w / total, 9) AS p_walk, round(b / total, 9) AS p_bike, round(v / total, 9) AS p_drive FROM t""")
def m05_joint_modes(s, d):  # M05
    modes = {"walk": (0.6, 0.1, "walk_min"), "bike": (0.02, 0.1, "bike_min"), "drive": (0.38, 0.15, "drive_min")}
    return Z.joint_modes(load(s, d, "destinations"), ["origin"], modes).select("origin", "dest", *[F.round(f"p_{m}", 9).alias(f"p_{m}") for m in modes])


SPEND = {c: (x * 100.0, x * 80.0, x * 120.0) for c, (x, _) in Z.SPENDING.items()}


def _grid():
    rows = []
    for c, a in SPEND.items():
        g = Z.GROUP_OF.get(c, "neighborhood")
        for slot, (i, j) in {"value": (0, 0), "low": (1, 2), "high": (2, 1)}.items():
            w, b = Z.ASSUMPTIONS[f"walk_share_{g}"][i], Z.ASSUMPTIONS[f"bike_share_{g}"][i]
            rows.append(f"('{c}', '{slot}', {a[i]}::DOUBLE, {w}::DOUBLE, {b}::DOUBLE, {1 - w - b}::DOUBLE, {Z.ASSUMPTIONS['beta_walk'][j]}::DOUBLE, {Z.ASSUMPTIONS['beta_bike'][j]}::DOUBLE)")
    return ", ".join(rows)


CAPTURE = f"""grid(category, slot, spend, sw, sb, sd, bw, bb) AS (VALUES {_grid()}), x AS (SELECT *, sw * {U.format(b='bw', m='walk_min')} AS w, sb * {U.format(b='bb', m='bike_min')} AS b, sd * {U.format(b='0.15', m='drive_min')} AS v FROM destinations, grid),
    t AS (SELECT *, sum(w + b + v) OVER (PARTITION BY origin, category, slot) AS total FROM x), c AS (SELECT origin, category, slot, dest, in_city, spend * (w + b + v) / total AS dollars, spend * w / total AS walk FROM t)"""


@query("destinations", f"WITH {CAPTURE} SELECT dest, slot, round(sum(dollars), 4) AS dollars, round(sum(walk), 4) AS walk FROM c GROUP BY 1, 2")
def g16_capture(s, d):  # G15, G16, A19
    out = Z.capture(load(s, d, "destinations"), SPEND)
    return out.groupBy("dest", "slot").agg(F.round(F.sum("dollars"), 4).alias("dollars"), F.round(F.sum("walk"), 4).alias("walk"))


@query("destinations", f"WITH {CAPTURE}, p AS (SELECT origin, slot, sum(CASE WHEN in_city THEN dollars ELSE 0 END) / sum(dollars) AS s FROM c GROUP BY 1, 2) SELECT origin, round(max(CASE WHEN slot = 'value' THEN s END), 8) AS value, round(min(s), 8) AS low, round(max(s), 8) AS high FROM p GROUP BY 1")
def g17_in_city_share(s, d):  # G17
    out = Z.in_city_share(Z.capture(load(s, d, "destinations"), SPEND))
    return out.select("origin", *[F.round(c, 8).alias(c) for c in ("value", "low", "high")])


AB = "SELECT c_custkey AS id, floor(c_acctbal) AS a, floor(c_acctbal) - 10 AS al, floor(c_acctbal) + 20 AS ah, 2.0 + c_custkey % 3 AS b, 1.0 + c_custkey % 3 AS bl, 4.0 + c_custkey % 3 AS bh FROM customer"


@query(oracle=f"SELECT id, a + b AS plus, al - bh AS minus_low, ah - bl AS minus_high, a * b AS times, least(al * bl, al * bh, ah * bl, ah * bh) AS times_low, greatest(al * bl, al * bh, ah * bl, ah * bh) AS times_high, round(a / b, 6) AS over, round(least(al / bl, al / bh, ah / bl, ah / bh), 6) AS over_low FROM ({AB})")
def m01_interval(s, d):  # M01
    k, x = F.col("c_custkey"), F.floor("c_acctbal").cast("double")
    a, b = Z.interval(x, x - 10, x + 20), Z.interval(2.0 + k % 3, 1.0 + k % 3, 4.0 + k % 3)
    c = load(s, d, "customer").select(k.alias("id"), a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    t, o, m = Z.mul(a, b), Z.div(a, b), Z.sub(a, b)
    return c.select("id", Z.add(a, b)["value"].alias("plus"), m["low"].alias("minus_low"), m["high"].alias("minus_high"), t["value"].alias("times"), t["low"].alias("times_low"), t["high"].alias("times_high"), F.round(o["value"], 6).alias("over"), F.round(o["low"], 6).alias("over_low"))


@query(oracle="SELECT c_custkey AS id, round(c_acctbal * pow(1.1, 1) * pow(0.9, 2) + 5 * pow(0.9, 0.5), 6) AS value FROM customer")
def m02_power_terms(s, d):  # M02, G25
    exps = lambda **e: F.create_map(*[F.lit(x) for kv in e.items() for x in kv])
    terms = F.array(F.struct(F.col("c_acctbal").alias("value"), exps(a=1.0, b=2.0).alias("exps")), F.struct(F.lit(5.0).alias("value"), exps(b=0.5).alias("exps")))
    return load(s, d, "customer").select(F.col("c_custkey").alias("id"), F.round(Z.terms_value(terms, exps(a=1.1, b=1.8), exps(a=1.0, b=2.0)), 6).alias("value"))


SITES = "SELECT s_suppkey AS site, CAST(50 + s_suppkey % 200 AS DOUBLE) AS units, CAST(60000 + 500 * (s_suppkey % 90) AS DOUBLE) AS income FROM supplier"


def sites(s, d):
    k = F.col("s_suppkey")
    return load(s, d, "supplier").select(k.alias("site"), (50 + k % 200).cast("double").alias("units"), (60000 + 500 * (k % 90)).cast("double").alias("income"))


@query(oracle=f"SELECT site, round(units * 0.95, 6) AS households, round(units * 0.95 * 1.8, 6) AS residents, round(units * 0.9 * 1.5, 6) AS residents_low, round(units * 0.95 * 5703 * pow(income * 1.125 / 101805, 0.45), 4) AS grocery, round(units * 0.97 * 5703 * pow(income * 1.25 / 101805, 0.45) * 1.15, 4) AS grocery_high FROM ({SITES})")
def g18_demand(s, d):  # G18, M07
    out = Z.demand(sites(s, d))
    return out.select("site", F.round("households.value", 6).alias("households"), F.round("residents.value", 6).alias("residents"), F.round("residents.low", 6).alias("residents_low"), F.round("spend_grocery.value", 4).alias("grocery"), F.round("spend_grocery.high", 4).alias("grocery_high"))


@query(oracle=f"""WITH x AS (SELECT *, units * 3e5 AS value, site % 3 * 10000.0::DOUBLE AS office, site % 4 * 5000.0::DOUBLE AS retail FROM ({SITES})), y AS (SELECT site,
    value * 1.0725 / 100 + (office + retail) * 275 * 1.0725 / 100 + units * 0.95 * 1.4 * 14000 * 4.13 / 100 + retail * 400 * 0.01 + retail * 400 * 0.002 AS revenue,
    units * 0.95 * 1.8 * ((207912496 - 76429791) / 25026.0::DOUBLE) + units * 0.1 * ((76429791 - 14492271) / 3103.0::DOUBLE) AS naive, units * 0.95 * 1.8 * ((207912496 - 76429791) / 25026.0::DOUBLE) * 0.4 + units * 0.1 * ((76429791 - 14492271) / 3103.0::DOUBLE) AS marginal, office / 350 AS jobs FROM x)
    SELECT site, round(revenue, 3) AS revenue, round(naive, 3) AS naive, round(marginal, 3) AS marginal, round(revenue - (naive + marginal) / 2, 3) AS net, round(jobs, 6) AS jobs FROM y""")
def g21_fiscal(s, d):  # G19-G21
    k = F.col("site")
    own = Z.demand(sites(s, d)).select("site", "units", (F.col("units") * 3e5).alias("value"), (k % 3 * 10000.0).alias("office_sqft"), (k % 4 * 5000.0).alias("retail_sqft"), "residents", "households")
    out = Z.fiscal(own)
    return out.select("site", *[F.round(f"{c}.value", 3).alias(c) for c in ("revenue", "naive", "marginal", "net")], F.round("jobs.value", 6).alias("jobs"))


@query(oracle="SELECT n_nationkey AS corridor, round((500 + n_nationkey * 40) * 0.035 * 0.1 * 365, 6) AS trips, round((500 + n_nationkey * 40) * 0.035 * 0.1 * 365 * (12 * 0.3 + 8 * 0.2 + 10 * 0.5), 4) AS spend, round((500 + n_nationkey * 40) * 0.05 * 0.2 * 365 * (17 * 0.3 + 11 * 0.2 + 20 * 0.5), 4) AS spend_high FROM nation")
def g22_bike_lane(s, d):  # G22, A17
    c = load(s, d, "nation").select(F.col("n_nationkey").alias("corridor"), (500 + F.col("n_nationkey") * 40).cast("double").alias("residents"), F.lit(0.3).alias("restaurant_share"), F.lit(0.2).alias("convenience_share"))
    out = Z.bike_lane(c)
    return out.select("corridor", F.round("trips.value", 6).alias("trips"), F.round("spend.value", 4).alias("spend"), F.round("spend.high", 4).alias("spend_high"))


@query(oracle="SELECT c_nationkey AS access, round(sum((1 + c_custkey % 30) * exp(-0.333 * (c_custkey % 40) / 10.0)), 4) AS users, round(sum((1 + c_custkey % 30) * exp(-0.45 * (c_custkey % 40) / 10.0)) * 6 * 6, 4) AS spend_low, round(sum(CASE WHEN c_custkey % 40 <= 4 THEN 1000 ELSE 0 END) * 0.03, 4) AS premium FROM customer GROUP BY 1")
def g23_trail(s, d):  # G23
    k = F.col("c_custkey")
    b = load(s, d, "customer").select(F.col("c_nationkey").alias("access"), ((k % 40) / 10.0).alias("km"), (1.0 + k % 30).alias("pop"), F.lit(1000.0).alias("assessed"))
    out = Z.trail(b)
    return out.select("access", F.round("users.value", 4).alias("users"), F.round("spend.low", 4).alias("spend_low"), F.round("premium.value", 4).alias("premium"))


@query(oracle=f"SELECT site, 'avg_hh_size_multifamily' AS assumption, round(units * 0.95 * (2.2 - 1.5), 6) AS swing FROM ({SITES}) UNION ALL SELECT site, 'occupancy_rate', round(units * 1.8 * (0.97 - 0.9), 6) FROM ({SITES})")
def l09_sensitivity(s, d):  # L09, G27
    u = F.col("units")
    at = {"avg_hh_size_multifamily": (u * 0.95 * 1.5, u * 0.95 * 2.2), "occupancy_rate": (u * 1.8 * 0.9, u * 1.8 * 0.97)}
    return Z.sensitivity(sites(s, d), ["site"], u * 0.95 * 1.8, at).select("site", "assumption", F.round("swing", 6).alias("swing"))


@query("points", "SELECT point_id, round(sqrt(pow((lon - -77.3) * 111320 * cos(radians((lat + 38.85) / 2)), 2) + pow((lat - 38.85) * 110540, 2)), 4) AS metres FROM (SELECT point_id, -77.3 + x / 1e6 AS lon, 38.85 + y / 1e6 AS lat FROM points)")
def m10_equirectangular(s, d):  # M10
    lon, lat = -77.3 + F.col("x") / 1e6, 38.85 + F.col("y") / 1e6
    return load(s, d, "points").select("point_id", F.round(S.equirectangular(F.lit(38.85), F.lit(-77.3), lat, lon), 4).alias("metres"))


@query("points", "SELECT point_id, round(abs(x * (y + 3) + (x + 10) * (y + 9) + (x + 4) * y - (x + 10) * y - (x + 4) * (y + 3) - x * (y + 9)) / 2, 6) AS area FROM points")
def m11_ring_area(s, d):  # M11, G14
    x, y = F.col("x"), F.col("y")
    return load(s, d, "points").select("point_id", F.round(S.ring_area(F.array(x, x + 10, x + 4), F.array(y, y + 3, y + 9)), 6).alias("area"))


@query("points", """WITH RECURSIVE o AS (SELECT kind, x, row_number() OVER (PARTITION BY kind ORDER BY x) AS n FROM points), f AS (SELECT kind, n, x, x AS kept, TRUE AS ok FROM o WHERE n = 1 UNION ALL SELECT o.kind, o.n, o.x, CASE WHEN o.x - f.kept >= 250 THEN o.x ELSE f.kept END, o.x - f.kept >= 250 FROM f JOIN o ON o.kind = f.kind AND o.n = f.n + 1) SELECT kind, x FROM f WHERE ok""")
def w11_access_points(s, d):  # W11
    return S.thin_along(load(s, d, "points").select("kind", "x"), "kind", "x", 250.0)
