"""Queries over briefs, the directory, sites, layers and identifiers with wildcards."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import briefs as B
from rostrum.operators import fiscal as V
from rostrum.operators import layers as L
from rostrum.operators import patterns as W
from rostrum.operators import sites as T
from rostrum.plans.places import SIDES, held, parcels
from rostrum.plans.registry import joined, registry
from rostrum.plans.texts import TOK
from rostrum.sources.tables import load
from rostrum.streaming import streams as S

QUERIES, ORACLES, query = registry()


@query("chunks names updates meetings", """WITH tr AS (SELECT entity_id, count(*) AS n, max(meeting_date) AS last_seen, max_by(update_text, [CAST(epoch(meeting_date) AS BIGINT), update_id]) AS said FROM updates JOIN meetings USING (meeting_id) GROUP BY 1),
    v AS (SELECT DISTINCT entity_id, unnest([name, alias]) AS v FROM names WHERE entity_type <> 'person'), h AS (SELECT chunk_id, text, entity_id, v FROM chunks JOIN v ON length(v) >= 5 AND contains(lower(text), v) QUALIFY row_number() OVER (PARTITION BY chunk_id, entity_id ORDER BY length(v) DESC, v) = 1),
    l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), v))[1] AS line FROM h), p AS (SELECT *, instr(lower(line), v) - 1 AS at0 FROM l),
    e AS (SELECT s_suppkey % 40 AS entity_id, min(s_suppkey) AS project_id FROM supplier GROUP BY 1)
    SELECT chunk_id AS event_id, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, entity_id) AS place, entity_id, n AS update_count, CAST(last_seen AS VARCHAR) AS last_seen, said AS latest_text, CASE WHEN project_id % 3 = 0 THEN 'p' || project_id END AS evaluation_slug,
    CASE WHEN at0 > 80 THEN '…' ELSE '' END || trim(regexp_replace(substr(line, greatest(0, at0 - 80) + 1, least(length(line), at0 + length(v) + 120) - greatest(0, at0 - 80)), '\\s+', ' ', 'g')) || CASE WHEN at0 + length(v) + 120 < length(line) THEN '…' ELSE '' END AS agenda_context
    FROM p JOIN tr USING (entity_id) LEFT JOIN e USING (entity_id)""")
def e15_briefs(s, d):  # E15: what an agenda is about
    names, sup = load(s, d, "names"), load(s, d, "supplier")
    entities = names.select("entity_id", F.concat(F.lit("e"), F.col("entity_id").cast("string")).alias("slug"), "name", "entity_type", F.lit(None).cast("string").alias("current_status"))
    k = F.col("s_suppkey")
    projects = sup.select(k.alias("project_id"), (k % 40).alias("entity_id"), F.concat(F.lit("p"), k.cast("string")).alias("external_slug"))
    evaluations = sup.where(k % 3 != 2).select(k.alias("project_id"), F.when(k % 3 == 0, "synthesized").otherwise("extracted").alias("status"))
    upcoming = load(s, d, "chunks").select(F.col("chunk_id").alias("event_id"), F.col("text").alias("agenda_text"))
    out = B.meeting_briefs(upcoming, entities, names.select("entity_id", "alias"), load(s, d, "updates"), load(s, d, "meetings"), projects, evaluations)
    t = out.select("event_id", F.posexplode("topics").alias("i", "t"))
    return t.select("event_id", (F.col("i") + 1).alias("place"), "t.entity_id", "t.update_count", F.col("t.last_seen").cast("string").alias("last_seen"), "t.agenda_context", F.col("t.latest_update.text").alias("latest_text"), "t.evaluation_slug")


@query(oracle=f"""WITH RECURSIVE e AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE p_name || ' ' || p_brand END AS name FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 10 <> 1),
    o AS (SELECT {TOK} AS t FROM (SELECT p_name || ' ' || p_brand || ' Project' AS name FROM part WHERE p_partkey % 10 = 0)),
    m AS (SELECT id, name, {TOK} AS t FROM e), r AS (SELECT id, name, t, row_number() OVER (ORDER BY name, id) AS n FROM m WHERE len(t) > 0 AND NOT EXISTS (SELECT 1 FROM o WHERE len(o.t) > 0 AND (list_has_all(o.t, m.t) OR list_has_all(m.t, o.t)))),
    f AS (SELECT n, id, name, [t] AS kept, TRUE AS ok FROM r WHERE n = 1 UNION ALL SELECT r.n, r.id, r.name, CASE WHEN len(list_filter(f.kept, lambda k: list_has_all(k, r.t) OR list_has_all(r.t, k))) > 0 THEN f.kept ELSE list_append(f.kept, r.t) END, len(list_filter(f.kept, lambda k: list_has_all(k, r.t) OR list_has_all(r.t, k))) = 0 FROM f JOIN r ON r.n = f.n + 1)
    SELECT 'official' AS source, 'p-' || p_partkey AS slug, p_name || ' ' || p_brand || ' Project' AS name, CASE WHEN p_partkey % 20 = 0 THEN p_partkey + 1 END AS entity_id, p_partkey % 30 = 0 AS has_evaluation FROM part WHERE p_partkey % 10 = 0
    UNION ALL SELECT 'meetings', NULL, name, id, FALSE FROM f WHERE ok""")
def e18_suppressed(s, d):  # E18, J14 to J16, U02: official rows, then what only meetings know, without what says the same
    p, k = load(s, d, "part"), F.col("p_partkey")
    both, none = F.concat_ws(" ", "p_name", "p_brand"), F.lit(None).cast("string")
    projects = p.where(k % 10 == 0).select(k.alias("project_id"), F.concat(F.lit("p-"), k.cast("string")).alias("external_slug"), F.concat(both, F.lit(" Project")).alias("name"), *[none.alias(c) for c in ("project_type", "division", "official_status", "description", "requests")], F.when(k % 20 == 0, k + 1).alias("entity_id"))
    kind = F.when((k % 4 == 0) | ((k % 10 == 1) & (k % 20 != 1)), "topic").otherwise("project")  # those with 1 in the end are topics or linked
    entities = p.select(k.alias("entity_id"), F.concat(F.lit("e"), k.cast("string")).alias("slug"), F.when(k % 3 == 0, F.col("p_name")).otherwise(both).alias("name"), kind.alias("entity_type"), none.alias("current_status"))
    evaluations = p.where(k % 30 == 0).select(k.alias("project_id"), F.lit("synthesized").alias("status"))
    return B.directory(projects, entities, evaluations).select("source", "slug", "name", "entity_id", "has_evaluation")


@query("corners nodes", f"""WITH {SIDES}, areas AS (SELECT parcel_id, sum(CASE WHEN ring = 0 THEN a ELSE -a END) / 43560 AS acres FROM (SELECT parcel_id, ring, abs(sum(x * ey - ex * y)) / 2 AS a FROM (SELECT parcel_id, ring, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS ex, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ey FROM corners WINDOW w AS (PARTITION BY parcel_id, ring ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1, 2) GROUP BY 1),
    inside AS (SELECT node_id, parcel_id FROM nodes AS p JOIN s ON {held('p.x', 'p.y')} GROUP BY 1, 2 HAVING count(*) % 2 = 1), pr AS (SELECT s_suppkey AS k FROM supplier),
    f AS (SELECT k, k AS parcel_id, 0 AS rung FROM pr WHERE k % 5 = 0 UNION ALL SELECT k, parcel_id, 1 FROM pr JOIN inside ON node_id = k WHERE k % 5 IN (1, 4) UNION ALL SELECT k, parcel_id, 2 FROM pr JOIN inside ON node_id = k + 1 WHERE k % 5 IN (2, 4) AND k % 3 <> 0 UNION ALL SELECT k, parcel_id, 2 FROM pr JOIN inside ON node_id = k WHERE k % 5 = 3),
    b AS (SELECT k, min(rung) AS rung FROM f GROUP BY 1), t AS (SELECT k, rung, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pins, sum(acres) AS acres FROM (SELECT f.k, f.rung, 'PIN ' || f.parcel_id AS p, acres FROM f JOIN b USING (k, rung) JOIN areas USING (parcel_id)) GROUP BY 1, 2)
    SELECT k AS project, CASE rung WHEN 0 THEN 'document_pins' WHEN 1 THEN 'address_geocode' WHEN 2 THEN 'review_map' END AS method, coalesce(pins, '') AS pins, round(acres, 6) AS acres FROM pr LEFT JOIN t USING (k)""")
def g13_sites(s, d):  # G13, S17: stated parcels, else around the published place, else around the review map's
    k, nodes = F.col("s_suppkey"), load(s, d, "nodes")
    lots = parcels(s, d).select(F.concat(F.lit("PIN "), F.col("parcel_id").cast("string")).alias("pin"), "rings")
    sup = load(s, d, "supplier")
    at = sup.join(nodes.withColumnRenamed("node_id", "s_suppkey"), "s_suppkey")
    empty = F.lit(None).cast("double")
    pick = lambda c, r: F.when(k % 5 == r, F.col(c)).otherwise(empty)
    pins = F.when(k % 5 == 0, F.array(F.concat(F.lit(" PIN   "), k.cast("string")), F.lit("PIN 999999999")))
    projects = at.select(k.alias("project"), F.concat(F.lit("slug-of-"), k.cast("string"), F.lit("-end")).alias("slug"), F.concat(F.lit("Name "), k.cast("string")).alias("name"), pins.alias("pins"), pick("x", 1).alias("x"), pick("y", 1).alias("y"), pick("x", 4).alias("geo_x"), pick("y", 4).alias("geo_y"))
    after = at.where((k - 1) % 5 == 2).unionByName(at.where((k - 1) % 5 == 4)).where((k - 1) % 3 != 0)
    by_url = after.select((2 * (k - 1)).alias("review"), F.lit("other").alias("name"), F.concat(F.lit("https://x.org/Slug-Of-"), (k - 1).cast("string"), F.lit("-end?a=1")).alias("url"), "x", "y")
    by_name = at.where(k % 5 == 3).select((2 * k + 1).alias("review"), F.concat(F.lit("NAME "), k.cast("string")).alias("name"), F.lit(None).cast("string").alias("url"), "x", "y")
    out = T.resolved_sites(projects, lots, by_url.unionByName(by_name))
    return out.select("project", "method", F.coalesce(joined(F.col("pins")), F.lit("")).alias("pins"), F.round("acres", 6).alias("acres"))


@query("hits", """WITH RECURSIVE p AS (SELECT user_id, event_id AS n, CAST(event_id AS DOUBLE) AS x, value AS y FROM hits), e AS (SELECT user_id, min(n) AS a, max(n) AS b FROM p GROUP BY 1),
    f AS (SELECT user_id, a, b FROM e UNION ALL SELECT g.user_id, unnest([g.a, g.m]), unnest([g.m, g.b]) FROM (SELECT f.user_id, f.a, f.b, (SELECT max_by(q.n, [sqrt(pow(q.x - (s.x + t * (z.x - s.x)), 2) + pow(q.y - (s.y + t * (z.y - s.y)), 2)), -q.n]) FILTER (sqrt(pow(q.x - (s.x + t * (z.x - s.x)), 2) + pow(q.y - (s.y + t * (z.y - s.y)), 2)) > 20)
      FROM (SELECT q.*, greatest(0.0, least(1.0, ((q.x - s.x) * (z.x - s.x) + (q.y - s.y) * (z.y - s.y)) / (pow(z.x - s.x, 2) + pow(z.y - s.y, 2)))) AS t FROM p AS q WHERE q.user_id = f.user_id AND q.n > f.a AND q.n < f.b) AS q) AS m FROM f JOIN p AS s ON s.user_id = f.user_id AND s.n = f.a JOIN p AS z ON z.user_id = f.user_id AND z.n = f.b) AS g WHERE m IS NOT NULL)
    SELECT user_id, a AS n FROM f UNION SELECT user_id, b FROM f""")
def g12_simplified(s, d):  # G12: lines with fewer corners
    h = load(s, d, "hits").select("user_id", F.col("event_id").alias("n"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    return L.simplified(h, "user_id", "n", 20.0).select("user_id", "n")


@query("points", """WITH f AS (SELECT kind, pop, point_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ']},"properties":{"pop":' || CAST(pop AS VARCHAR) || '}}' AS j FROM points WHERE pop >= 10),
    t AS (SELECT *, sum(strlen(j) + 1) OVER (PARTITION BY kind ORDER BY pop DESC, point_id ROWS UNBOUNDED PRECEDING) + 41 AS total FROM f)
    SELECT kind, count(*) AS n, '{"type":"FeatureCollection","features":[' || string_agg(j, ',' ORDER BY pop DESC, point_id) || ']}' AS layer FROM t WHERE total <= 1500 GROUP BY 1""")
def g26_budget(s, d):  # G25, G26, K08: the largest features within a budget of bytes
    p = load(s, d, "points")
    f = p.select("kind", "pop", "point_id", L.feature("Point", F.array(F.struct("x", "y")), ["pop"]).alias("j"))
    fit = L.within_budget(f, ["kind"], "pop", "point_id", "j", 1500, 10.0)
    return L.collections(fit, ["kind"], "pop", "point_id", "j", 1500)


@query(oracle="""WITH v AS (SELECT c_custkey AS id, 'PIN ' || c_custkey || ' 4' AS pin FROM customer), p AS (SELECT s_suppkey AS mask, CASE s_suppkey % 5 WHEN 0 THEN 'PIN ' || s_suppkey || '? 4' WHEN 1 THEN '*' || s_suppkey || ' 4' WHEN 2 THEN 'PIN*' || (s_suppkey % 7) || '? ?' WHEN 3 THEN '?' || '???????' ELSE 'PIN ' || s_suppkey || ' 4' END AS pattern FROM supplier)
    SELECT id, mask FROM v JOIN p ON pin LIKE replace(replace(pattern, '*', '%'), '?', '_')""")
def j33_wildcards(s, d):  # J33: identifiers with wildcards
    k = F.col("s_suppkey")
    text = k.cast("string")
    pattern = F.when(k % 5 == 0, F.concat(F.lit("PIN "), text, F.lit("? 4"))).when(k % 5 == 1, F.concat(F.lit("*"), text, F.lit(" 4"))).when(k % 5 == 2, F.concat(F.lit("PIN*"), (k % 7).cast("string"), F.lit("? ?"))).when(k % 5 == 3, "????????").otherwise(F.concat(F.lit("PIN "), text, F.lit(" 4")))
    values = load(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("PIN "), F.col("c_custkey").cast("string"), F.lit(" 4")).alias("pin"))
    return W.pattern_join(values, load(s, d, "supplier").select(k.alias("mask"), pattern.alias("pattern")), "pin", "pattern").select("id", "mask")


SLOTS = "slots(slot, cv, veh, vav, sales, stu, mcf, occ, hh) AS (VALUES ('v', 275.0::DOUBLE, 1.4::DOUBLE, 14000.0::DOUBLE, 400.0::DOUBLE, 0.1::DOUBLE, 0.4::DOUBLE, 0.95::DOUBLE, 1.8::DOUBLE), ('l', 200, 1.0, 9000, 250, 0.05, 0.25, 0.9, 1.5), ('h', 400, 1.8, 20000, 600, 0.15, 0.6, 0.97, 2.2))"
RANGE = "Net annual fiscal impact (range across both cost methods)"


@query(oracle=f"""WITH {SLOTS}, c AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM (SELECT CAST(floor(p_retailprice * 100) AS DOUBLE) AS x FROM part WHERE 1990 + p_partkey % 40 >= 2011)),
    q AS (SELECT median(x) AS v, sum(CASE WHEN i = floor(0.25 * (n + 1)) THEN x * (1 - (0.25 * (n + 1) - floor(0.25 * (n + 1)))) WHEN i = floor(0.25 * (n + 1)) + 1 THEN x * (0.25 * (n + 1) - floor(0.25 * (n + 1))) ELSE 0 END) AS l, sum(CASE WHEN i = floor(0.75 * (n + 1)) THEN x * (1 - (0.75 * (n + 1) - floor(0.75 * (n + 1)))) WHEN i = floor(0.75 * (n + 1)) + 1 THEN x * (0.75 * (n + 1) - floor(0.75 * (n + 1))) ELSE 0 END) AS h FROM c),
    s AS (SELECT s_suppkey AS site, CAST(s_suppkey % 200 AS DOUBLE) AS units, CASE WHEN s_suppkey % 5 <> 0 THEN 1e6 + s_suppkey * 1000.0 END AS av, CAST((s_suppkey % 4) * 5000 AS DOUBLE) AS retail FROM supplier),
    x AS (SELECT s.*, slot, units * CASE slot WHEN 'v' THEN q.v WHEN 'l' THEN q.l ELSE q.h END + retail * cv AS pv, units * occ AS hhs, units * occ * hh AS people, units * stu AS pupils, slots.* EXCLUDE (slot) FROM s, slots, q),
    y AS (SELECT *, CASE WHEN units > 0 THEN pv * 0.010725 END AS tax, hhs * veh * vav * 0.0413 AS cars, CASE WHEN retail > 0 THEN retail * sales * 0.002 END AS bpol, CASE WHEN site % 3 <> 0 THEN hhs * 1000 * 0.5 * 0.045 END AS meals, CASE WHEN site % 3 <> 0 THEN hhs * 3000 * 0.4 * 0.01 END AS retail_tax,
      people * (207912496 - 76429791) / 25026.0::DOUBLE AS other, pupils * (76429791 - 14492271) / 3103.0::DOUBLE AS school FROM x),
    z AS (SELECT *, coalesce(tax - av * 0.010725, tax, 0) + cars + coalesce(bpol, 0) + coalesce(meals, 0) + coalesce(retail_tax, 0) AS revenue, other + school AS naive, other * mcf + school AS marginal FROM y),
    m AS (SELECT site, slot, unnest(['Current real estate tax (site)', 'Projected real estate tax', 'Real estate tax increase', 'Personal property tax on resident vehicles (rough estimate)', 'BPOL business license tax on project retail (rough estimate)', 'Meals tax on captured in-city dining', 'Local sales tax share on captured in-city retail', 'Estimated K-12 students', 'Annual school cost within the service-cost estimates', 'Annual service cost — naive per-capita method', 'Annual service cost — marginal framing']) AS metric,
      unnest([av * 0.010725, tax, tax - av * 0.010725, cars, bpol, meals, retail_tax, pupils, school, naive, marginal]) AS a FROM z),
    p AS (SELECT site, metric, max(a) FILTER (slot = 'v') AS value, max(a) FILTER (slot = 'l') AS low, max(a) FILTER (slot = 'h') AS high FROM m WHERE a IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT v.site, round(v.revenue - (v.naive + v.marginal) / 2) AS value, round(l.revenue - h.naive) AS low, round(h.revenue - l.marginal) AS high FROM z AS v JOIN z AS l ON l.site = v.site AND l.slot = 'l' JOIN z AS h ON h.site = v.site AND h.slot = 'h' WHERE v.slot = 'v')
    SELECT site, metric, round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high FROM p UNION ALL SELECT site, '{RANGE}', value, low, high FROM n""")
def g21_fiscal_module(s, d):  # G21, A16, J36: taxes, costs and the net, from comps and the economic module's metrics
    k = F.col("s_suppkey")
    sup, part = load(s, d, "supplier"), load(s, d, "part")
    sites = sup.select(k.alias("site"), (k % 200).cast("double").alias("units"), F.lit(2.0).alias("acres"), F.when(k % 5 != 0, 1e6 + k * 1000.0).alias("assessed_value"), (k % 4 * 5000).cast("double").alias("retail_sqft"))
    comps = part.select(F.col("p_partkey").alias("pin"), (1990 + F.col("p_partkey") % 40).alias("year_built"), F.floor(F.col("p_retailprice") * 100).alias("per_unit_value"))
    homes = V.demand_basis(sites)
    prior = homes.where("metric in ('New households', 'New residents')")
    lived = homes.where("metric = 'New households' and site % 3 <> 0")
    scaled = lambda name, f: lived.select("site", F.lit(name).alias("metric"), *[(F.col(c) * f).alias(c) for c in ("value", "low", "high")])
    fixed = lambda name, v: lived.select("site", F.lit(name).alias("metric"), F.lit(v).alias("value"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    for row in (scaled(V.PRIOR["dining"], 1000.0), scaled(V.PRIOR["grocery"], 500.0), scaled(V.PRIOR["comparison"], 1500.0), scaled(V.PRIOR["convenience"], 1000.0), fixed(V.PRIOR["food_share"], 0.5), fixed(V.PRIOR["retail_share"], 0.4)):
        prior = prior.unionByName(row)
    out = V.fiscal_metrics(sites, comps, prior, 2026)
    shown = ~F.col("metric").isin("Current value per acre", "Projected value per acre", "Projected assessed value", "Net annual fiscal impact — naive per-capita method", "Net annual fiscal impact — marginal framing")
    return out.where(shown).select("site", "metric", *[F.round(c, 6).alias(c) for c in ("value", "low", "high")])


@query("hits", """WITH RECURSIVE o AS (SELECT user_id % 5 AS ip, event_id, ts, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM hits WHERE event_type = 'signup'),
    f AS (SELECT ip, n, event_id, [ts] AS live, TRUE AS allowed FROM o WHERE n = 1 UNION ALL
    SELECT o.ip, o.n, o.event_id, CASE WHEN len(list_filter(f.live, lambda t: t >= o.ts - INTERVAL 24 HOUR)) < 10 THEN list_append(list_filter(f.live, lambda t: t >= o.ts - INTERVAL 24 HOUR), o.ts) ELSE list_filter(f.live, lambda t: t >= o.ts - INTERVAL 24 HOUR) END, len(list_filter(f.live, lambda t: t >= o.ts - INTERVAL 24 HOUR)) < 10 FROM f JOIN o ON o.ip = f.ip AND o.n = f.n + 1)
    SELECT ip, event_id, allowed FROM f""")
def r03_signup_limit(s, d):  # R03, W13: sign-ups from one address
    own = load(s, d, "hits").where("event_type = 'signup'").withColumn("ip", F.col("user_id") % 5)
    return S.rate_limit(own, 10, 24 * 3600, "ip")
