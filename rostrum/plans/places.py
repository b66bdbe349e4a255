"""Queries over parcels, lines, street networks and what resolves to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import corridors as K
from rostrum.operators import graph as G
from rostrum.operators import polygons as P
from rostrum.operators import trails as R
from rostrum.plans.registry import registry
from rostrum.sources.tables import load

QUERIES, ORACLES, query = registry()

SIDES = "s AS (SELECT parcel_id, site, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS ex, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ey FROM corners WINDOW w AS (PARTITION BY parcel_id, ring ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def held(x: str, y: str) -> str:
    return f"((ay > {y}) <> (ey > {y})) AND {x} < ax + ({y} - ay) * (ex - ax) / nullif(ey - ay, 0)"


def parcels(s, d):
    return P.from_corners(load(s, d, "corners"), ["parcel_id", "site"])


@query("points corners", f"WITH {SIDES} SELECT point_id, parcel_id FROM points AS p JOIN s ON {held('p.x', 'p.y')} GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def j28_points_in_parcels(s, d):  # J28, P21: two tables, holes
    return P.located(load(s, d, "points"), parcels(s, d), "parcel_id").select("point_id", "parcel_id")


def _from(px, py, ax, ay, bx, by):
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2), 0), 0)))"
    return f"sqrt(pow({px} - ({ax} + {t} * ({bx} - {ax})), 2) + pow({py} - ({ay} + {t} * ({by} - {ay})), 2))"


def _turn(px, py, qx, qy, rx, ry):
    return f"sign(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"


_A, _B = ("ax", "ay", "ex", "ey"), ("cx", "cy", "dx", "dy")
GAP = f"""CASE WHEN {_turn(*_A, 'cx', 'cy')} * {_turn(*_A, 'dx', 'dy')} < 0 AND {_turn(*_B, 'ax', 'ay')} * {_turn(*_B, 'ex', 'ey')} < 0 THEN 0
    ELSE least({_from('ax', 'ay', *_B)}, {_from('ex', 'ey', *_B)}, {_from('cx', 'cy', *_A)}, {_from('dx', 'dy', *_A)}) END"""


@query("corners lines", f"""WITH {SIDES}, l AS (SELECT line_id, n, x AS cx, y AS cy, coalesce(lead(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) AS dy, count(*) OVER (PARTITION BY line_id) AS m FROM lines WINDOW w AS (PARTITION BY line_id ORDER BY n)),
    near AS (SELECT parcel_id, line_id, {GAP} AS d FROM s, l WHERE m = 1 OR n < m - 1), inside AS (SELECT parcel_id, line_id FROM s, l WHERE n = 0 AND {held('cx', 'cy')} GROUP BY 1, 2 HAVING count(*) % 2 = 1)
    SELECT parcel_id, line_id, round(min(d), 6) AS d FROM (SELECT * FROM near WHERE d <= 500 UNION ALL SELECT parcel_id, line_id, 0 FROM inside) GROUP BY 1, 2""")
def j27_band(s, d):  # J27: parcels that reach into the band around a line
    paths = load(s, d, "lines").groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("path"))
    return P.in_band(parcels(s, d), paths, "parcel_id", "line_id", 500.0).select("parcel_id", "line_id", F.round("d", 6).alias("d"))


@query("lots", """WITH xs AS (SELECT DISTINCT site, x0 AS x FROM lots UNION SELECT site, x0 + w FROM lots), ys AS (SELECT DISTINCT site, y0 AS y FROM lots UNION SELECT site, y0 + h FROM lots),
    xx AS (SELECT site, x, lead(x) OVER (PARTITION BY site ORDER BY x) AS x2 FROM xs), yy AS (SELECT site, y, lead(y) OVER (PARTITION BY site ORDER BY y) AS y2 FROM ys),
    c AS (SELECT DISTINCT xx.site, x, x2, y, y2 FROM xx JOIN yy ON xx.site = yy.site JOIN lots AS l ON l.site = xx.site AND l.x0 <= x AND x2 <= l.x0 + l.w AND l.y0 <= y AND y2 <= l.y0 + l.h)
    SELECT site, CAST(sum((x2 - x) * (y2 - y)) AS DOUBLE) AS area FROM c GROUP BY 1""")
def g14_dissolve(s, d):  # G14: lots that overlap count once
    x, y = F.col("x0").cast("double"), F.col("y0").cast("double")
    corner = lambda i, j: F.struct((x + i * F.col("w")).alias("x"), (y + j * F.col("h")).alias("y"))
    lots = load(s, d, "lots").select("lot_id", "site", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings"))
    return P.outline_area(P.dissolved(lots, "site", "lot_id"), "site").select("site", F.round("area", 3).alias("area"))


SEED = 20260718


def _ways(edges: str, start: str, cost: str = "minutes") -> str:
    """SQL of w: least sums from each of start; of p: the smallest node before each."""
    return f"""w(source, node, spent) USING KEY (source, node) AS (SELECT source, source, 0.0::DOUBLE FROM {start} UNION SELECT w.source, e.v, min(w.spent + e.{cost}) FROM w JOIN {edges} AS e ON e.u = w.node LEFT JOIN recurring.w AS r ON r.source = w.source AND r.node = e.v WHERE r.spent IS NULL OR w.spent + e.{cost} < r.spent GROUP BY 1, 2),
    p AS (SELECT b.source, b.node, min(e.u) AS previous FROM w AS b JOIN {edges} AS e ON e.v = b.node JOIN w AS a ON a.source = b.source AND a.node = e.u WHERE a.spent + e.{cost} = b.spent AND b.node <> b.source GROUP BY 1, 2)"""


def _drawn(side: str, weight: str) -> str:
    return f"""{side}_spans AS (SELECT node, {weight} AS weight, sum({weight}) OVER (ORDER BY substr(md5(CAST(node AS VARCHAR)), 1, 2), node) AS hi, sum({weight}) OVER () AS total FROM corner_nodes WHERE {weight} > 0),
    {side}_draws AS (SELECT i AS draw, node FROM (SELECT i, ('0x' || substr(md5('{SEED}:{side}:' || CAST(i AS VARCHAR)), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE AS u FROM range(2000) AS r(i)) AS d, {side}_spans WHERE u * total >= hi - weight AND u * total < hi)"""


PAIRS = f"{_drawn('from', 'pop')}, {_drawn('to', 'shops')}, trips AS (SELECT draw, f.node AS source, t.node AS target FROM from_draws AS f JOIN to_draws AS t USING (draw)), starts AS (SELECT DISTINCT source FROM trips)"
BASELINE = f"""{PAIRS}, {_ways('streets', 'starts')}, b(draw, source, u, v) AS (SELECT draw, t.source, previous, target FROM trips AS t JOIN p ON p.source = t.source AND p.node = t.target UNION ALL SELECT draw, b.source, previous, b.u FROM b JOIN p ON p.source = b.source AND p.node = b.u),
    counts AS (SELECT u, v, count(*) AS n FROM b GROUP BY 1, 2)"""


def _places(s, d, weight):
    return load(s, d, "corner_nodes").select("node", F.col(weight).cast("double").alias("weight"))


@query("corner_nodes", f"WITH {PAIRS} SELECT draw, source AS \"from\", target AS \"to\" FROM trips")
def g06_sampled_pairs(s, d):  # G06: seeded draws by population and by shops
    return G.sampled_pairs(_places(s, d, "pop"), 2000, SEED, _places(s, d, "shops"))


@query("corner_nodes streets", f"WITH RECURSIVE {BASELINE} SELECT u, v, n AS count FROM counts")
def g06_baseline(s, d):  # G06, G04: sampled trips routed and counted by edge
    return G.sampled_baseline(load(s, d, "streets"), _places(s, d, "pop"), _places(s, d, "shops"), 2000, SEED)


@query("corner_nodes streets", f"""WITH RECURSIVE {BASELINE.replace('starts AS (SELECT DISTINCT source FROM trips)', 'starts AS (SELECT source FROM trips UNION SELECT 0)')},
    pull AS (SELECT w.node, c.shops * exp(-0.1 * w.spent) AS k FROM w JOIN corner_nodes AS c ON c.node = w.node WHERE w.source = 0 AND w.node <> 0 AND c.shops > 0),
    f(u, v, flow) AS (SELECT previous, pull.node, 400 * k / (SELECT sum(k) FROM pull) FROM pull JOIN p ON p.source = 0 AND p.node = pull.node UNION ALL SELECT previous, f.u, flow FROM f JOIN p ON p.source = 0 AND p.node = f.u),
    flows AS (SELECT u, v, round(sum(flow), 9) AS flow FROM f GROUP BY 1, 2)
    SELECT u, v, round(flow, 6) AS flow, CASE WHEN n >= 5 THEN round(100 * flow / (n * (SELECT sum(pop) FROM corner_nodes) * 0.5 / 2000), 6) END AS change FROM flows LEFT JOIN counts USING (u, v) ORDER BY flows.flow DESC, u, v LIMIT 300""")
def g07_edge_change(s, d):  # G07, G05, A20, A28, L07: a site's trips against the sampled baseline
    edges, people = load(s, d, "streets"), load(s, d, "corner_nodes")
    flows = G.edge_flows(edges, 0, _places(s, d, "shops"), 400.0, 0.1).withColumn("flow", F.round("flow", 9))
    counts = G.sampled_baseline(edges, _places(s, d, "pop"), _places(s, d, "shops"), 2000, SEED)
    total = people.agg(F.sum("pop")).first()[0]
    top = G.top_edges(G.edge_changes(flows, counts, total * 0.5 / 2000), 300)
    return top.select("u", "v", F.round("flow", 6).alias("flow"), F.round("change", 6).alias("change"))


@query("edges", f"""WITH RECURSIVE {_ways('edges', '(SELECT CAST(0 AS BIGINT) AS source)')}, pull AS (SELECT node, (1.0::DOUBLE + node % 3) * exp(-0.1 * spent) AS k FROM w WHERE node <> 0),
    f(u, v, flow) AS (SELECT previous, pull.node, 100 * k / (SELECT sum(k) FROM pull) FROM pull JOIN p ON p.node = pull.node UNION ALL SELECT previous, f.u, flow FROM f JOIN p ON p.node = f.u) SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, round(sum(flow), 8) AS flow FROM f GROUP BY 1, 2""")
def g05_edge_flows(s, d):  # G04, G05, A20
    e = load(s, d, "edges").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "minutes")
    w = load(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (1.0 + F.col("n_nationkey") % 3).alias("weight"))
    return G.edge_flows(e, 0, w, 100.0, 0.1).select("u", "v", F.round("flow", 8).alias("flow"))


ASKED = """asked AS (SELECT n_nationkey AS request, 'Row ' || (n_nationkey % 11) || ' Street' AS street, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE 'Col ' || (n_nationkey % 12) || ' Avenue' END AS f, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE 'Col ' || ((n_nationkey * 7 + 4) % 10) || ' Avenue' END AS t FROM nation)"""


@query("corner_nodes streets", f"""WITH RECURSIVE {ASKED}, named AS (SELECT street, u AS node FROM streets WHERE street IS NOT NULL UNION SELECT street, v FROM streets WHERE street IS NOT NULL),
    sides AS (SELECT request, street, 'f' AS side, f AS cross_street FROM asked WHERE f IS NOT NULL UNION ALL SELECT request, street, 't', t FROM asked WHERE t IS NOT NULL),
    shared AS (SELECT request, side, a.node FROM sides JOIN named AS a ON a.street = sides.street JOIN named AS b ON b.street = cross_street AND b.node = a.node),
    gaps AS (SELECT request, side, a.node, sqrt(pow((o.x - n.x) * 111320 * cos(radians(n.y)), 2) + pow((o.y - n.y) * 110540, 2)) AS gap FROM (SELECT * FROM sides WHERE (request, side) NOT IN (SELECT request, side FROM shared)) AS x JOIN named AS a ON a.street = x.street JOIN corner_nodes AS n ON n.node = a.node JOIN named AS b ON b.street = cross_street JOIN corner_nodes AS o ON o.node = b.node),
    ends AS (SELECT request, side, node FROM shared UNION ALL SELECT request, side, node FROM gaps WHERE gap <= 200 QUALIFY row_number() OVER (PARTITION BY request, side ORDER BY gap, node) = 1),
    w(request, node, spent) USING KEY (request, node) AS (SELECT request, node, 0.0::DOUBLE FROM ends WHERE side = 'f' UNION SELECT w.request, e.v, min(w.spent + e.length * CASE WHEN e.street = a.street THEN 1 ELSE 5 END) FROM w JOIN asked AS a ON a.request = w.request JOIN streets AS e ON e.u = w.node LEFT JOIN recurring.w AS r ON r.request = w.request AND r.node = e.v WHERE r.spent IS NULL OR w.spent + e.length * CASE WHEN e.street = a.street THEN 1 ELSE 5 END < r.spent GROUP BY 1, 2),
    best AS (SELECT w.request, min(spent) AS cost, min_by(w.node, [spent, w.node]) AS node FROM w JOIN ends ON ends.request = w.request AND ends.node = w.node AND side = 't' GROUP BY 1 HAVING min(spent) > 0),
    p AS (SELECT z.request, z.node, min(e.u) AS previous FROM w AS z JOIN asked AS a ON a.request = z.request JOIN streets AS e ON e.v = z.node JOIN w AS y ON y.request = z.request AND y.node = e.u WHERE z.spent > 0 AND y.spent + e.length * CASE WHEN e.street = a.street THEN 1 ELSE 5 END = z.spent GROUP BY 1, 2),
    walk(request, u, v) AS (SELECT best.request, previous, best.node FROM best JOIN p ON p.request = best.request AND p.node = best.node UNION ALL SELECT k.request, previous, k.u FROM walk AS k JOIN p ON p.request = k.request AND p.node = k.u),
    steps AS (SELECT k.request, k.u, k.v, min([CASE WHEN e.street = a.street THEN 0 ELSE 1 END, e.length]) AS l FROM walk AS k JOIN asked AS a ON a.request = k.request JOIN streets AS e ON e.u = k.u AND e.v = k.v GROUP BY 1, 2, 3), lost AS (SELECT request, sum(l[1] * l[2]) > 0.5 * sum(l[2]) AS most FROM steps GROUP BY 1),
    runs AS (SELECT request, least(u, v) AS a, greatest(u, v) AS b, min(length) AS length FROM asked JOIN streets USING (street) WHERE f IS NULL GROUP BY ALL), hop(request, a, b) AS (SELECT request, a, b FROM runs UNION SELECT request, b, a FROM runs UNION SELECT h.request, h.a, r.b FROM hop AS h JOIN (SELECT request, a, b FROM runs UNION SELECT request, b, a FROM runs) AS r ON r.request = h.request AND r.a = h.b),
    whole AS (SELECT request, max(total) AS run FROM (SELECT runs.request, root, sum(length) AS total FROM runs JOIN (SELECT request, a, min(b) AS root FROM hop GROUP BY 1, 2) AS h ON h.request = runs.request AND h.a = runs.a GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT a.request, CASE WHEN a.street NOT IN (SELECT street FROM named) THEN 'no street named ' || a.street WHEN f NOT IN (SELECT street FROM named) THEN 'no street named ' || f WHEN f IS NOT NULL AND (a.request, 'f') NOT IN (SELECT request, side FROM ends) THEN a.street || ' and ' || f || ' share no intersection'
      WHEN t NOT IN (SELECT street FROM named) THEN 'no street named ' || t WHEN t IS NOT NULL AND (a.request, 't') NOT IN (SELECT request, side FROM ends) THEN a.street || ' and ' || t || ' share no intersection' WHEN f IS NOT NULL AND cost IS NULL THEN 'the crossings aren''t connected' WHEN most THEN 'the way runs mostly off the street' END AS note, f, cost, run FROM asked AS a LEFT JOIN best USING (request) LEFT JOIN whole USING (request) LEFT JOIN lost USING (request))
    SELECT request, CASE WHEN note IS NULL THEN CASE WHEN f IS NULL THEN 'whole street' ELSE 'between cross streets' END END AS method, CASE WHEN note IS NULL THEN CASE WHEN f IS NULL THEN run ELSE cost END END AS cost, note FROM s""")
def g11_corridors(s, d):  # G11: cost of the way, which is its length where it keeps to the street
    n = F.col("n_nationkey")
    cross = lambda c: F.when(n % 4 != 3, F.concat(F.lit("col "), c.cast("string"), F.lit(" Ave")))
    asked = load(s, d, "nation").select(n.alias("request"), F.concat(F.lit("Row "), (n % 11).cast("string"), F.lit(" Street")).alias("street"), cross(n % 12).alias("from_street"), cross((n * 7 + 4) % 10).alias("to_street"))
    found, steps = K.resolved(asked, load(s, d, "streets"), load(s, d, "corner_nodes"))
    cost = F.col("length") * F.when(F.col("on_street"), 1.0).otherwise(K.OFF_STREET)
    paid = steps.groupBy("request").agg(F.sum(cost).alias("cost"))
    note = F.regexp_replace("note", r"\bcol (\d+) Ave\b", "Col $1 Avenue")
    return found.join(paid, "request", "left").select("request", "method", "cost", note.alias("note"))


PATHS = "paths AS (SELECT n_nationkey AS line, 90.0::DOUBLE * (n_nationkey % 12) + 20 AS y0, CASE WHEN n_nationkey % 6 = 5 THEN 5000.0::DOUBLE ELSE 0 END AS x0 FROM nation), spots AS (SELECT s_suppkey AS node, (s_suppkey % 10) * 100.0::DOUBLE AS x, floor(s_suppkey / 10) * 100.0::DOUBLE AS y FROM supplier)"
FLAT = "sqrt(pow(greatest(x0 - x, 0, x - x0 - 850), 2) + pow(y - y0, 2))"


def _paths(s, d, key):
    n = F.col("n_nationkey")
    x, y = F.when(n % 6 == 5, 5000.0).otherwise(0.0), 90.0 * (n % 12) + 20.0
    at = lambda dx: F.struct((x + dx).alias("x"), y.alias("y"))
    return load(s, d, "nation").select(n.alias(key), F.array(at(0.0), at(400.0), at(850.0)).alias("path"))


def _spots(s, d):
    k = F.col("s_suppkey")
    return load(s, d, "supplier").select(k.alias("node"), (k % 10 * 100.0).alias("x"), (F.floor(k / 10) * 100.0).alias("y"))


@query("streets", f"""WITH RECURSIVE {PATHS}, starts AS (SELECT line, node FROM paths, spots WHERE {FLAT} <= 50), w(source, node, spent) USING KEY (source, node) AS (SELECT line, node, 0.0::DOUBLE FROM starts UNION SELECT w.source, e.v, min(w.spent + e.minutes) FROM w JOIN streets AS e ON e.u = w.node LEFT JOIN recurring.w AS r ON r.source = w.source AND r.node = e.v WHERE r.spent IS NULL OR w.spent + e.minutes < r.spent GROUP BY 1, 2),
    c AS (SELECT source AS line, sum(pop * exp(-0.1 * spent)) AS v, sum(pop * exp(-0.15 * spent)) AS l, sum(pop * exp(-0.05 * spent)) AS h FROM w JOIN (SELECT s_suppkey AS node, 1 + s_suppkey % 7 AS pop FROM supplier) USING (node) GROUP BY 1),
    shop AS (SELECT line, CASE node % 3 WHEN 0 THEN 'r' WHEN 1 THEN 'c' ELSE 'o' END AS g FROM paths, spots WHERE {FLAT} <= 100), m AS (SELECT line, count(*) AS n, count(*) FILTER (g = 'r') / count(*) AS r, count(*) FILTER (g = 'c') / count(*) AS c, count(*) FILTER (g = 'o') / count(*) AS o FROM shop GROUP BY 1),
    k AS (SELECT line, count(*) AS nodes FROM starts GROUP BY 1)
    SELECT line AS corridor, coalesce(k.nodes, 0) AS nodes, CASE WHEN k.nodes IS NOT NULL THEN coalesce(m.n, 0) END AS shops, round(c.v, 6) AS catchment, round(c.l * 0.02 * 0.03, 8) AS visits_low, round(c.v * 0.035 * 0.1 * 365 * (12 * m.r + 8 * m.c + 10 * m.o), 5) AS spending, round(c.h * 0.05 * 0.2 * 365 * (17 * m.r + 11 * m.c + 20 * m.o), 5) AS spending_high,
    CASE WHEN k.nodes IS NULL THEN 'the corridor touches no nodes' WHEN m.n IS NULL THEN 'no retail beside the corridor' END AS note FROM paths LEFT JOIN k USING (line) LEFT JOIN c USING (line) LEFT JOIN m USING (line)""")
def g22_bike_corridors(s, d):  # G22, G02, J26, A17, A18: from the line to what is spent beside it
    spots, k = _spots(s, d), F.col("node")
    taxonomy = F.when(k % 3 == 0, "restaurant_bar").when(k % 3 == 1, "retail_convenience").otherwise("retail_comparison")
    shops = spots.select(k.alias("shop"), taxonomy.alias("taxonomy"), "x", "y")
    blocks = spots.select("node", (1 + k % 7).cast("double").alias("pop"))
    out, _ = R.bike_corridors(_paths(s, d, "corridor"), spots, load(s, d, "streets"), blocks, shops)
    return out.select("corridor", "nodes", "shops", F.round("catchment.value", 6).alias("catchment"), F.round("visits.low", 8).alias("visits_low"), F.round("spending.value", 5).alias("spending"), F.round("spending.high", 5).alias("spending_high"), "note")


@query("streets", f"""WITH RECURSIVE {PATHS}, near AS (SELECT line, node, least(greatest(x - x0, 0), 850) AS place FROM paths, spots WHERE {FLAT} <= 50), o AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY place, node) AS n FROM near),
    f AS (SELECT line, node, place, n, place AS kept, TRUE AS ok FROM o WHERE n = 1 UNION ALL SELECT o.line, o.node, o.place, o.n, CASE WHEN o.place - f.kept >= 250 THEN o.place ELSE f.kept END, o.place - f.kept >= 250 FROM f JOIN o ON o.line = f.line AND o.n = f.n + 1), access AS (SELECT line, node, place FROM f WHERE ok),
    w(source, node, spent) USING KEY (source, node) AS (SELECT DISTINCT node, node, 0.0::DOUBLE FROM access UNION SELECT w.source, e.v, min(w.spent + e.length) FROM w JOIN streets AS e ON e.u = w.node LEFT JOIN recurring.w AS r ON r.source = w.source AND r.node = e.v WHERE r.spent IS NULL OR w.spent + e.length < r.spent GROUP BY 1, 2),
    home AS (SELECT a.line, w.node AS block, min([w.spent, a.place, a.node]) AS b FROM access AS a JOIN w ON w.source = a.node GROUP BY 1, 2), people AS (SELECT line, CAST(b[3] AS BIGINT) AS access, sum((1 + block % 7) * exp(-0.333 * b[1] / 1000)) AS v, sum((1 + block % 7) * exp(-0.45 * b[1] / 1000)) AS l, sum((1 + block % 7) * exp(-0.25 * b[1] / 1000)) AS h FROM home GROUP BY 1, 2),
    sums AS (SELECT line, sum(v) AS v, sum(l) AS l, sum(h) AS h FROM people GROUP BY 1), pull AS (SELECT a.line, a.node AS access, w.node AS shop, exp(-0.1 * w.spent * 0.0125) AS p, sum(exp(-0.1 * w.spent * 0.0125)) OVER (PARTITION BY a.line, a.node) AS every FROM access AS a JOIN w ON w.source = a.node WHERE w.node % 2 = 0),
    shop AS (SELECT pull.line, shop, sum(people.v / sums.v * p / every) * any_value(sums.v) * 12 * 7.5 AS dollars FROM pull JOIN people ON people.line = pull.line AND people.access = pull.access JOIN sums ON sums.line = pull.line GROUP BY 1, 2),
    best AS (SELECT line, max(dollars) AS top, sum(dollars) AS dealt FROM shop GROUP BY 1), lot AS (SELECT line, count(*) AS parcels, sum(1000.0::DOUBLE * (1 + node % 9)) AS assessed FROM paths, spots WHERE sqrt(pow(greatest(x0 - (x + 40), 0, x - x0 - 850), 2) + pow(greatest(y0 - (y + 40), 0, y - y0), 2)) <= 1650 / 3.28084 GROUP BY 1),
    n AS (SELECT line, count(*) AS access FROM access GROUP BY 1)
    SELECT line AS trail, coalesce(n.access, 0) AS access, round(sums.v, 6) AS catchment, round(sums.l * 6 * 6, 5) AS spending_low, round(dealt, 5) AS dealt, round(top, 5) AS top, coalesce(parcels, 0) AS parcels, CASE WHEN n.access IS NOT NULL AND assessed > 0 THEN round(assessed * 0.03 * 0.010725, 6) END AS tax FROM paths LEFT JOIN n USING (line) LEFT JOIN sums USING (line) LEFT JOIN best USING (line) LEFT JOIN lot USING (line)""")
def g23_trails(s, d):  # G23, G03, J27, W11, A18: access points, people, shops and parcels of each trail
    spots, k = _spots(s, d), F.col("node")
    corner = lambda i, j: F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"))
    lots = spots.select(k.alias("pin"), F.array(F.array(corner(0, 0), corner(40, 0), corner(40, 40), corner(0, 40))).alias("rings"), (1000.0 * (1 + k % 9)).alias("assessed"))
    blocks = spots.select(k.alias("block"), "node", (1 + k % 7).cast("double").alias("pop"))
    out, each = R.trails(_paths(s, d, "trail"), spots, load(s, d, "streets"), blocks, spots.where(k % 2 == 0).select(k.alias("shop"), "node"), lots)
    dealt = each.groupBy("trail").agg(F.max("dollars.value").alias("top"), F.sum("dollars.value").alias("dealt"))
    return out.join(dealt, "trail", "left").select("trail", "access", F.round("catchment.value", 6).alias("catchment"), F.round("spending.low", 5).alias("spending_low"), F.round("dealt", 5).alias("dealt"), F.round("top", 5).alias("top"), "parcels", F.round("tax.value", 6).alias("tax"))
