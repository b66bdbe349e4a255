"""Queries over project pages, layers, budgets, scales, streets and lookups between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import scale as L
from rostrum.operators import civic_ops as C
from rostrum.operators import graph as G
from rostrum.operators import mentions as M
from rostrum.operators import relational as R
from rostrum.operators import spatial as S
from rostrum.plans.registry import registry
from rostrum.sources import parse as P
from rostrum.sources.tables import load
from rostrum.streaming import streams as T

QUERIES, ORACLES, query = registry()
BASE_URL = "https://town.example.org"


@query(oracle="""SELECT s_suppkey AS page_id, 0 AS n, 'Project-' || CAST(s_suppkey AS VARCHAR) AS slug, s_name || ' & Co' AS name, 'https://town.example.org/Development/Projects/Project-' || CAST(s_suppkey AS VARCHAR) AS detail_url,
    CASE WHEN s_suppkey % 3 = 0 THEN 'City Project' ELSE 'Private Development' END AS project_type, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'nation ' || CAST(s_nationkey AS VARCHAR) END AS description FROM supplier""")
def s07_project_list(s, d):  # S07, S08: landed directory pages
    k = F.col("s_suppkey").cast("string")
    icon = F.when(F.col("s_suppkey") % 3 == 0, '<img alt="" src="/icons/City-Project.png">').otherwise('<img alt="private">')
    about = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("<p>nation <b>"), F.col("s_nationkey").cast("string"), F.lit("</b></p>")))
    html = F.concat(F.lit('<article><a href="/Development/Projects/Menu">menu</a></article><div class="list-item-container"><article><a href="/Development/Projects/Project-'), k, F.lit('"><h2 class="list-item-title">'), icon, F.col("s_name"), F.lit(" &amp; Co</h2>"), about, F.lit('</a></article><article><a href="/News/1"><h2 class="list-item-title">News</h2></a></article></div><article><a href="/Development/Projects/Other"><h2 class="list-item-title">Other</h2></a></article>'))
    return P.project_list(load(s, d, "supplier").select(F.col("s_suppkey").alias("page_id"), html.alias("html")), BASE_URL)


@query(oracle="""SELECT s_suppkey AS page_id, 'Rezoning' AS project_type, CASE WHEN s_suppkey % 2 = 0 THEN 'Under review' END AS official_status, s_name AS description, 38.5 + s_suppkey AS lat, -77.25 AS lng, CAST(s_suppkey AS VARCHAR) || ' Main Street' AS address,
    'p' || CAST(s_suppkey AS VARCHAR) || '@town.gov' AS planner_email, '(703) 385-0001' AS planner_phone, 'Ann Lee' AS planner_name, 'Plan A>https://town.example.org/a.pdf' AS documents, 'filed|heard' AS official_timeline FROM supplier""")
def s07_project_detail(s, d):  # S07
    k = F.col("s_suppkey").cast("string")
    html = F.concat(F.lit("<ul><li>Project type Menu</li><li>Project division Menu</li></ul><main><ul><li>Project type <b>Rezoning</b></li>"), F.when(F.col("s_suppkey") % 2 == 0, "<li>Project schedule Under review</li>").otherwise(""), F.lit("</ul><h2>Project</h2><ul><li>filed</li><li></li><li>heard</li></ul><h2>Background</h2><p>"), F.col("s_name"), F.lit("</p><h3>Concept Plans</h3><a href='/a.pdf'>Plan A</a><h3>Location</h3><p>"), k, F.lit(" Main Street View Map "), (38.5 + F.col("s_suppkey")).cast("string"), F.lit(", -77.25</p><h3>Contact Details</h3><p>Ann Lee, p"), k, F.lit("@town.gov</p><p>(703) 385-0001</p></main>"))
    out = P.project_detail(load(s, d, "supplier").select(F.col("s_suppkey").alias("page_id"), html.alias("html")), BASE_URL)
    documents = F.array_join(F.transform("documents", lambda x: F.concat_ws(">", x["label"], x["url"])), "|")
    return out.select("page_id", "project_type", "official_status", "description", "lat", "lng", "address", "planner_email", "planner_phone", "planner_name", documents.alias("documents"), F.array_join("official_timeline", "|").alias("official_timeline"))


@query(oracle="""WITH p AS (SELECT c_nationkey AS layer, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 3 AS page, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 3 AS n, c_custkey AS pin FROM customer)
    SELECT layer, page * 3 AS "offset", n, pin FROM p WHERE page < coalesce((SELECT min(q.page) FROM (SELECT layer, page FROM p GROUP BY 1, 2 HAVING count(*) < 3) AS q WHERE q.layer = p.layer), 1000000000) + 1""")
def s09_layer_pages(s, d):  # S09, N07: landed pages of a layer
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    rows = load(s, d, "customer").select(F.col("c_nationkey").alias("layer"), "c_custkey", place.alias("i")).withColumn("offset", F.col("i") - F.col("i") % 3)
    feature = F.struct("i", F.struct(F.struct(F.col("c_custkey").alias("pin")).alias("attributes")).alias("f"))
    pages = rows.groupBy("layer", "offset").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(feature)), lambda x: x["f"]).alias("features"))).alias("json"))
    return P.paged_features(pages, "pin:bigint", 3)


@query("chunks names", """WITH v AS (SELECT entity_id, name AS v FROM names WHERE entity_type <> 'person' UNION SELECT entity_id, alias FROM names WHERE entity_type <> 'person'),
    h AS (SELECT DISTINCT meeting_id, entity_id FROM chunks JOIN v ON length(v) >= 5 AND contains(lower(text), v)) SELECT meeting_id, entity_id, row_number() OVER (PARTITION BY meeting_id ORDER BY entity_id) AS place FROM h QUALIFY place <= 60""")
def j11_known_entities(s, d):  # J11
    return M.known_entities(load(s, d, "chunks"), load(s, d, "names"))


@query(oracle="SELECT 's' || CAST(c_custkey AS VARCHAR) AS slug, s_suppkey AS target_id, CASE WHEN s_suppkey IS NULL THEN 'SKIP s' || CAST(c_custkey AS VARCHAR) || ': no such target' END AS note FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def j34_slug_lookup(s, d):  # J34, K07: lookups by slug, misses told
    slug = lambda c: F.concat(F.lit("s"), F.col(c).cast("string")).alias("slug")
    return C.slug_lookup(load(s, d, "customer").select(slug("c_custkey")), load(s, d, "supplier").select(slug("s_suppkey"), F.col("s_suppkey").alias("target_id")))


@query("hits", """WITH a AS (SELECT DISTINCT user_id, event_type AS metric FROM hits UNION SELECT DISTINCT user_id, upper(event_type) FROM hits) SELECT a.user_id, a.metric, (SELECT min_by(h.value, h.event_id) FROM hits h WHERE h.user_id = a.user_id AND h.event_type = a.metric) AS value FROM a""")
def j36_prior_metric(s, d):  # J36: by the exact name, the first one
    h = load(s, d, "hits")
    found = h.select("user_id", F.col("event_type").alias("metric"), "value", "event_id")
    asked = found.select("user_id", "metric").unionByName(found.select("user_id", F.upper("metric").alias("metric"))).distinct()
    return C.prior_metrics(asked, found, ["user_id"], "event_id")


@query("items", "SELECT item_id, 2 AS raw_length FROM items WHERE contains(lower(title), '7')")
def t10_query_forms(s, d):  # T10: the raw query is long enough, the stripped one is looked for
    needle, raw = R.search_forms(" 7")
    return load(s, d, "items").where(R.contains_text(F.col("title"), needle)).select("item_id", F.lit(len(raw)).alias("raw_length"))


@query("items", "WITH b AS (SELECT 'last' || CAST(member AS VARCHAR) AS k, count(*) AS n FROM items WHERE motion_result IS NOT NULL GROUP BY 1) SELECT c_custkey AS person_id, coalesce(n, 0) AS votes_cast FROM customer LEFT JOIN b ON k = 'last' || CAST(c_nationkey AS VARCHAR)")
def t11_shared_last_names(s, d):  # T11: who shares a last name shares its votes
    people = load(s, d, "customer").select(F.col("c_custkey").alias("person_id"), F.concat(F.lit("First"), F.col("c_custkey").cast("string"), F.lit(" Last"), F.col("c_nationkey").cast("string"), F.lit(" Jr.")).alias("name"))
    ballots = load(s, d, "items").where("motion_result is not null").groupBy(F.concat(F.lit("LAST"), F.col("member").cast("string")).alias("member")).agg(F.count(F.lit(1)).alias("n"))
    return C.votes_by_last_name(people, ballots).select("person_id", "votes_cast")


@query("items", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS vote FROM items")
def t12_first_key(s, d):  # T12: of two keys that are the name, the first counts
    votes = F.when(F.col("item_id") % 3 == 0, '{"Lee":"no","SMITH":"yes","Smith":"no"}').when(F.col("item_id") % 3 == 1, '{"smith":"no","Smith":"yes"}').otherwise('{"Smithson":"yes"}')
    return load(s, d, "items").select("item_id", C.first_cast(votes, F.lit("Smith")).alias("vote"))


@query("edges", "WITH e AS (SELECT u % 5 AS street, u AS node FROM edges UNION SELECT u % 5, v FROM edges) SELECT a.street AS a, b.street AS b, a.node FROM e a JOIN e b ON a.node = b.node WHERE a.street < b.street")
def u04_shared_nodes(s, d):  # U04
    edges = load(s, d, "edges").withColumn("street", F.col("u") % 5)
    streets = edges.select("street").distinct()
    return G.shared_nodes(edges, streets.select(F.col("street").alias("a")).join(streets.select(F.col("street").alias("b")), F.col("a") < F.col("b")))


@query("edges", """WITH RECURSIVE e AS (SELECT CAST(u * 100000 + v * 100 + minutes AS BIGINT) AS edge, u % 5 AS street, u, v, minutes AS length FROM edges), p AS (SELECT street, edge, u AS node FROM e UNION ALL SELECT street, edge, v FROM e),
    j AS (SELECT street, node, min(edge) AS a, max(edge) AS b FROM p GROUP BY 1, 2 HAVING count(*) = 2), l AS (SELECT a, b FROM j UNION SELECT b, a FROM j UNION SELECT edge, edge FROM e), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    root AS (SELECT a AS edge, min(b) AS run FROM r GROUP BY 1) SELECT street, run, count(*) AS pieces, sum(length) AS length FROM e JOIN root USING (edge) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY street ORDER BY sum(length) DESC, run) = 1""")
def g12_longest_runs(s, d):  # G12: merged pieces, the longest of a street
    edge = (F.col("u") * 100000 + F.col("v") * 100 + F.col("minutes")).cast("long")
    return G.longest_runs(load(s, d, "edges").select(edge.alias("edge"), (F.col("u") % 5).alias("street"), "u", "v", F.col("minutes").alias("length")))


@query("hits", """WITH RECURSIVE o AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, ts, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM hits),
    f AS (SELECT user_id, day, n, event_id, ts, [ts] AS live, TRUE AS allowed FROM o WHERE n = 1 UNION ALL
    SELECT o.user_id, o.day, o.n, o.event_id, o.ts, CASE WHEN len(list_filter(f.live, lambda t: t >= o.ts - INTERVAL 6 HOUR)) < 2 THEN list_append(list_filter(f.live, lambda t: t >= o.ts - INTERVAL 6 HOUR), o.ts) ELSE list_filter(f.live, lambda t: t >= o.ts - INTERVAL 6 HOUR) END, len(list_filter(f.live, lambda t: t >= o.ts - INTERVAL 6 HOUR)) < 2 FROM f JOIN o ON o.user_id = f.user_id AND o.day = f.day AND o.n = f.n + 1)
    SELECT user_id, event_id, allowed AND row_number() OVER (PARTITION BY day, allowed ORDER BY ts, event_id) <= 200 AS allowed FROM f""")
def d06_daily_budget(s, d):  # D06, W13, R03: windows by key, a budget by day
    return T.daily_budget(load(s, d, "hits"), 2, 6 * 3600, 200)


@query(oracle="""WITH m AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice <= 0 THEN 0 ELSE pow(10, floor(log10(o_totalprice))) END AS p FROM orders)
    SELECT o_orderkey AS k, CASE WHEN p = 0 THEN 1.0 ELSE p * list_min(list_filter([1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0]::DOUBLE[], lambda s: s * p >= o_totalprice)) END AS top, round(sqrt(least(greatest(o_totalprice, 0), 400000.0) / 400000.0), 9) AS place FROM m""")
def m09_colour_ramp(s, d):  # M09
    v = F.col("o_totalprice")
    return load(s, d, "orders").select(F.col("o_orderkey").alias("k"), L.nice_ceiling(v).alias("top"), F.round(L.ramp(v, F.lit(400000.0)), 9).alias("place"))


@query(oracle="SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'WARNING: area differs from stated by 20%' END AS area, CASE WHEN p_partkey % 4 = 3 THEN 'WARNING: corridor differs from stated by 50%' END AS corridor FROM part")
def m13_drift(s, d):  # M13: within 15 % of an area, 30 % of a corridor
    k = F.col("p_partkey")
    found = F.when(k % 4 == 1, 12.0).when(k % 4 == 3, 5.0).otherwise(11.5)
    p = load(s, d, "part")
    area = L.drift_note(F.lit("area"), found, F.when(k % 4 == 0, 0.0).when(k % 4 == 3, 5.5).otherwise(10.0), 0.15)
    return p.select(k.alias("k"), area.alias("area"), L.drift_note(F.lit("corridor"), found, F.lit(10.0), 0.30).alias("corridor"))


@query(oracle="""SELECT o_orderkey AS k, '{"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","seen":["' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.500000"],"status":"' || o_orderstatus || '"}' AS meta FROM orders""")
def n06_iso_dates(s, d):  # N06: dates at any depth
    at = F.col("o_orderdate")
    meta = F.struct(at.cast("date").alias("day"), F.array(at, at + F.expr("INTERVAL '0.5' SECOND")).alias("seen"), F.col("o_orderstatus").alias("status"))
    return C.iso_dates(load(s, d, "orders").select(F.col("o_orderkey").alias("k"), meta.alias("meta"))).select("k", F.to_json("meta").alias("meta"))


@query("points nodes", """WITH m AS (SELECT kind AS cluster, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM points GROUP BY 1), c AS (SELECT kind AS cluster, min_by(point_id, sqrt((x - mx) ** 2 + (y - my) ** 2)) AS p FROM points JOIN m ON cluster = kind GROUP BY 1),
    j AS (SELECT cluster, min_by(node_id, sqrt((x - mx) ** 2 + (y - my) ** 2)) AS node FROM m JOIN nodes ON sqrt((x - mx) ** 2 + (y - my) ** 2) <= 450 GROUP BY 1) SELECT cluster, coalesce('crossing ' || CAST(node AS VARCHAR), 'shop ' || CAST(p AS VARCHAR) || ' area') AS name, n FROM m JOIN c USING (cluster) LEFT JOIN j USING (cluster)""")
def g10_cluster_names(s, d):  # G10
    members = load(s, d, "points").select(F.col("kind").alias("cluster"), F.col("point_id").alias("key"), F.concat(F.lit("shop "), F.col("point_id").cast("string")).alias("name"), "x", "y")
    junctions = load(s, d, "nodes").select(F.col("node_id").alias("node"), F.concat(F.lit("crossing "), F.col("node_id").cast("string")).alias("label"), "x", "y")
    return S.name_clusters(members, junctions, 450.0)


@query("points", "SELECT avg(pop) AS mean FROM (SELECT pop FROM points ORDER BY sqrt((x - 5000) ** 2 + (y - 5000) ** 2), pop LIMIT 10)")
def a28_nearest_mean(s, d):  # A28
    return S.nearest_mean(load(s, d, "points"), 5000.0, 5000.0, "pop")
