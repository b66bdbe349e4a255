"""Queries over directories, members, briefs, evaluations and curated pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.operators import mentions as M
from rostrum.operators import relational as R
from rostrum.operators import report as Q
from rostrum.operators import spatial as S
from rostrum.plans.registry import joined, registry
from rostrum.sources import parse as P
from rostrum.sources.tables import load

QUERIES, ORACLES, query = registry()


@query("items", "SELECT meeting_id, count(*) FILTER (motion_result = 'passed') AS yes, count(*) FILTER (motion_result = 'failed') AS no, CASE WHEN count(*) FILTER (motion_result = 'passed') = 0 THEN 'none passed' WHEN count(*) FILTER (motion_result = 'failed') = 0 THEN 'all passed' ELSE 'split' END AS tally FROM items WHERE motion_result IS NOT NULL GROUP BY 1")
def a10_tally(s, d):  # A10, A32: over a vote map's values
    votes = load(s, d, "items").where("motion_result is not null").groupBy("meeting_id").agg(F.collect_list("motion_result").alias("v"))
    n = lambda w: F.size(F.filter("v", lambda x: x == w))
    words = F.when(n("passed") == 0, "none passed").when(n("failed") == 0, "all passed").otherwise("split")
    return votes.select("meeting_id", n("passed").cast("long").alias("yes"), n("failed").cast("long").alias("no"), words.alias("tally"))


@query("points", "WITH p AS (SELECT kind, CASE point_id % 3 WHEN 0 THEN 'osm' WHEN 1 THEN 'overture' ELSE 'fsq' END AS source, point_id FROM points) SELECT kind, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, min_by(point_id, (CASE source WHEN 'overture' THEN 0 WHEN 'fsq' THEN 1 ELSE 2 END) * 1000000 + point_id) AS kept FROM p GROUP BY 1")
def a22_contributors(s, d):  # A22, U03
    k = F.col("point_id")
    p = load(s, d, "points").select("kind", k, F.when(k % 3 == 0, "osm").when(k % 3 == 1, "overture").otherwise("fsq").alias("source"))
    rank = F.when(F.col("source") == "overture", 0).when(F.col("source") == "fsq", 1).otherwise(2)
    return p.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min_by("point_id", F.struct(rank, "point_id")).alias("kept"))


@query("items", "SELECT meeting_id, item_no, title FROM items WHERE NOT regexp_matches(title, '(?i)\\b(minutes|remote participation|part 1\\d)\\b') QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY item_no) <= 6")
def l11_briefing(s, d):  # L11
    own = load(s, d, "items").where(~F.col("title").rlike(r"(?i)\b(minutes|remote participation|part 1\d)\b"))
    return R.latest_by(own, ["meeting_id"], [F.col("item_no")], 6).select("meeting_id", "item_no", "title")


@query("destinations", "SELECT origin, dest FROM destinations QUALIFY row_number() OVER (PARTITION BY origin ORDER BY attractiveness DESC, walk_min, dest) <= 5")
def l06_top_places(s, d):  # L05, L06
    return S.top_places(load(s, d, "destinations"), ["origin"], [F.col("attractiveness").desc(), F.col("walk_min"), F.col("dest")], 5).select("origin", "dest")


@query(oracle="SELECT CAST(s_suppkey AS BIGINT) AS id, lower(CASE WHEN s_suppkey % 3 = 0 THEN 'Lee' || s_suppkey ELSE 'Day' || s_suppkey END) AS last, CASE s_suppkey % 4 WHEN 0 THEN 'mayor' WHEN 1 THEN 'councilmember' WHEN 2 THEN 'commissioner' END AS role FROM supplier")
def f09_member_names(s, d):  # F09, F10, F21
    k = F.col("s_suppkey")
    last = F.concat(F.when(k % 3 == 0, "Lee").otherwise("Day"), k.cast("string"))
    name = F.concat(F.lit("Ann B. "), last, F.when(k % 2 == 0, " Jr.").otherwise(""))
    alias = F.concat(F.when(k % 4 == 0, "Mayor ").when(k % 4 == 1, "Councilmember ").when(k % 4 == 2, "Commissioner ").otherwise("Ms. "), last)
    role = F.when(alias.startswith("Mayor"), "mayor").when(alias.startswith("Council"), "councilmember").when(alias.startswith("Commission"), "commissioner")
    return load(s, d, "supplier").select(k.alias("id"), X.last_name(name).alias("last"), role.alias("role"))


@query("chunks names", """WITH t AS (SELECT c.chunk_id, n.name AS v, list_filter(string_split(c.text, chr(10)), lambda l: contains(lower(l), n.name))[1] AS line FROM chunks c JOIN (SELECT DISTINCT name FROM names WHERE length(name) >= 5 AND entity_type <> 'person') n ON contains(lower(c.text), n.name)), p AS (SELECT *, instr(lower(line), v) - 1 AS at0 FROM t)
    SELECT chunk_id, v AS variant, CASE WHEN at0 > 80 THEN '…' ELSE '' END || trim(regexp_replace(substr(line, greatest(0, at0 - 80) + 1, least(length(line), at0 + length(v) + 120) - greatest(0, at0 - 80)), '\\s+', ' ', 'g')) || CASE WHEN at0 + length(v) + 120 < length(line) THEN '…' ELSE '' END AS excerpt FROM p""")
def f11_agenda_excerpt(s, d):  # F11, E15
    named = load(s, d, "names").where("entity_type <> 'person' and length(name) >= 5").select("name", F.array("name").alias("variants")).distinct()
    own = M.matches(load(s, d, "chunks").select("chunk_id", "text"), named, entity="name")
    return own.select("chunk_id", "variant", X.agenda_excerpt(F.col("text"), F.col("variant")).alias("excerpt"))


@query(oracle="SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'analysis in preparation' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'not yet evaluated' ELSE 'no residential program to model' END ELSE CASE WHEN p_partkey % 2 = 0 THEN 'awaiting submitted plans' ELSE 'not yet evaluated' END END AS reason FROM part")
def f08_reason(s, d):  # F08
    k = F.col("p_partkey")
    about = F.when((k % 3 == 1) & (k % 2 == 0), "Multimodal path").when(k % 3 == 1, "a hotel").otherwise("40 apartments")
    status = F.when(k % 2 == 0, "Pre-Application").otherwise("Approved")
    return load(s, d, "part").select(k.alias("id"), X.no_analysis_reason(about, F.lit(None).cast("string"), status, F.when(k % 3 == 0, "computed")).alias("reason"))


@query(oracle="SELECT c_custkey AS id, c_custkey % 4 <> 0 AS ok FROM customer")
def f31_email(s, d):  # F31
    k = F.col("c_custkey")
    return load(s, d, "customer").select(k.alias("id"), X.is_email(F.when(k % 8 == 0, None).when(k % 4 == 0, "no at.example").otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@example.org")))).alias("ok"))


@query(oracle="SELECT doc_id, split_part(text, '. ', 1) AS first, len(string_split(text, chr(10))) AS sections FROM documents")
def f28_first_sentence(s, d):  # F28, F33
    return load(s, d, "documents").select("doc_id", F.substring_index("text", ". ", 1).alias("first"), F.size(F.split("text", "\n")).cast("long").alias("sections"))


@query(oracle="SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) - 5 ELSE least(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) - 5) END AS oldest FROM orders")
def d05_page_dates(s, d):  # D01, D05
    k, o = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 3 == 0, "soon").otherwise(F.date_format(o, "yyyy-MM-dd'T'HH:mm:ss"))
    day = F.try_to_timestamp(F.left(raw, F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")
    return load(s, d, "orders").select(k.alias("id"), day.alias("day"), F.least(day, F.date_sub(o, 5)).alias("oldest"))


@query("items", "SELECT meeting_id, member, coalesce(len(list(title) FILTER (member % 3 = 0)), 0) AS remarks FROM items GROUP BY 1, 2")
def n03_commentary(s, d):  # N03, N05: filter an array of structs by a field
    rows = load(s, d, "items").groupBy("meeting_id", "member").agg(F.collect_list(F.struct(F.col("member").alias("slug"), "title")).alias("all"))
    mine = F.filter("all", lambda e: e["slug"] % 3 == 0)
    return rows.select("meeting_id", "member", F.coalesce(F.size(mine), F.lit(0)).cast("long").alias("remarks"))


@query("meetings", """WITH a AS (SELECT meeting_id, body, CASE WHEN meeting_id % 3 = 0 THEN ['Ann Lee' || meeting_id, 'Bo Day'] ELSE [] END AS names, row_number() OVER (PARTITION BY body ORDER BY meeting_date DESC, meeting_id DESC) AS rn FROM meetings) SELECT body, array_to_string(min_by(names, rn), ',') AS roster FROM a WHERE rn <= 5 AND len(names) > 0 GROUP BY 1""")
def w08_current_roster(s, d):  # W08, E17, F20
    k = F.col("meeting_id")
    head = F.when(k % 3 == 0, F.concat(F.lit("Chair: X / Vice-Chair: Y / Commissioners: Ann Lee"), k.cast("string"), F.lit(", Bo Day"))).otherwise("no header")
    names = F.regexp_extract(head, r"Commissioners?:\s*([^\n]+)", 1)
    own = load(s, d, "meetings").select("meeting_id", "body", "meeting_date", F.filter(F.split(names, r",\s*"), lambda x: x != "").alias("names"))
    five = R.latest_by(own, ["body"], [F.col("meeting_date").desc(), k.desc()], 5, "rn").where(F.size("names") > 0)
    return five.groupBy("body").agg(joined(F.min_by("names", "rn")).alias("roster"))


@query("updates meetings", "SELECT entity_id, min_by(meeting_id, (meeting_date, meeting_id)) AS first_meeting FROM updates JOIN meetings USING (meeting_id) GROUP BY 1")
def w10_first_seen(s, d):  # W10
    u = load(s, d, "updates").join(load(s, d, "meetings").select("meeting_id", "meeting_date"), "meeting_id")
    return u.groupBy("entity_id").agg(F.min_by("meeting_id", F.struct("meeting_date", "meeting_id")).alias("first_meeting"))


@query("meetings updates items", """SELECT u.entity_id, m.meeting_id, m.meeting_date, u.update_text, coalesce(v.votes, '') AS votes FROM updates u JOIN meetings m USING (meeting_id) LEFT JOIN (SELECT meeting_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_no) AS votes FROM items WHERE motion_result = 'failed' GROUP BY 1) v ON v.meeting_id = m.meeting_id""")
def e14_timeline(s, d):  # E14, O5: votes nested in each entry
    votes = load(s, d, "items").where("motion_result = 'failed'").groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "item_id"))), lambda x: x["item_id"]).alias("votes"))
    u = load(s, d, "updates").join(load(s, d, "meetings").select("meeting_id", "meeting_date"), "meeting_id").join(votes, "meeting_id", "left")
    return u.select("entity_id", "meeting_id", "meeting_date", "update_text", joined(F.coalesce("votes", F.array().cast("array<long>"))).alias("votes"))


@query("entities updates", "SELECT entity_id, name FROM entities e WHERE entity_type = 'project' AND (entity_id % 8 = 1 OR (SELECT count(*) FROM updates u WHERE u.entity_id = e.entity_id) >= 2)")
def e13_wiki_candidates(s, d):  # E13
    n = load(s, d, "updates").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    own = load(s, d, "entities").where("entity_type = 'project'").join(n, "entity_id", "left")
    return own.where((F.col("entity_id") % 8 == 1) | (F.coalesce("n", F.lit(0)) >= 2)).select("entity_id", "name")


@query("entities updates", "WITH p AS (SELECT entity_id, entity_id % 5 AS version, (SELECT max(meeting_id) FROM updates u WHERE u.entity_id = e.entity_id AND meeting_id % 2 = 0) AS through FROM entities e WHERE entity_id % 3 <> 0), l AS (SELECT entity_id, max(meeting_id) AS latest FROM updates GROUP BY 1) SELECT l.entity_id FROM l LEFT JOIN p USING (entity_id) WHERE p.entity_id IS NULL OR p.through IS DISTINCT FROM l.latest OR p.version <> 1")
def e10_stale_profiles(s, d):  # E10, B4
    u = load(s, d, "updates").select("entity_id", "meeting_id")
    latest = u.groupBy("entity_id").agg(F.max("meeting_id").alias("latest"), F.max(F.when(F.col("meeting_id") % 2 == 0, F.col("meeting_id"))).alias("through"))
    version = F.when(F.col("entity_id") % 3 != 0, F.col("entity_id") % 5)
    return latest.where(version.isNull() | ~F.col("through").eqNullSafe(F.col("latest")) | (version != 1)).select("entity_id")


@query("entities", "SELECT entity_id FROM entities WHERE entity_type = 'location' AND entity_id % 4 = 2 AND entity_id % 3 <> 0")
def e12_geocode_pending(s, d):  # E12, E11: locations without a cached answer, hit or miss
    e = load(s, d, "entities")
    cached = e.where("entity_id % 3 = 0").select("entity_id", F.when(F.col("entity_id") % 2 == 0, "ok").otherwise("miss").alias("status"))
    return e.where("entity_type = 'location'").join(cached, "entity_id", "left_anti").select("entity_id")


@query("entities", "SELECT entity_id, name, 'official' AS source, CAST(NULL AS VARCHAR) AS category FROM entities WHERE entity_id % 5 = 0 UNION ALL SELECT entity_id, name, 'meetings', CASE WHEN entity_type = 'topic' THEN 'civic' ELSE 'development' END FROM entities WHERE entity_id % 5 <> 0 AND entity_type <> 'person'")
def e18_directory(s, d):  # E18, U02, P20: meeting-derived rows after official ones
    e = load(s, d, "entities")
    official = e.where("entity_id % 5 = 0").select("entity_id", "name", F.lit("official").alias("source"))
    derived = e.where("entity_id % 5 <> 0 and entity_type <> 'person'").select("entity_id", "name", F.lit("meetings").alias("source"), F.when(F.col("entity_type") == "topic", "civic").otherwise("development").alias("category"))
    return official.unionByName(derived, allowMissingColumns=True)


@query(oracle="SELECT n_nationkey AS evaluation, 'economic' AS module, 'jobs' AS metric, CAST(n_nationkey * 2 AS DOUBLE) AS value FROM nation UNION ALL SELECT n_nationkey, 'fiscal', 'net', CAST(n_nationkey * 3 AS DOUBLE) FROM nation")
def e19_payload(s, d):  # E19, N01: modules' metrics, flattened and tagged
    k = F.col("n_nationkey")
    metric = lambda name, v: F.array(F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value")))
    modules = F.array(F.struct(F.lit("economic").alias("module"), metric("jobs", k * 2).alias("metrics")), F.struct(F.lit("fiscal").alias("module"), metric("net", k * 3).alias("metrics")))
    flat = F.flatten(F.transform(modules, lambda m: F.transform(m["metrics"], lambda x: F.struct(m["module"].alias("module"), x["metric"].alias("metric"), x["value"].alias("value")))))
    return load(s, d, "nation").select(k.alias("evaluation"), F.inline(flat))


@query(oracle="SELECT source AS path, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id) AS pages FROM documents GROUP BY 1")
def e20_wiki_payload(s, d):  # E20, L10, N08
    row = F.struct(F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2), "doc_id")
    return load(s, d, "documents").groupBy(F.col("source").alias("path")).agg(joined(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["doc_id"])).alias("pages"))


@query(oracle="SELECT doc_id, doc_id % 3 <> 0 AS kept FROM documents")
def e23_protected_regions(s, d):  # E23, F27: a curator may not touch marked regions
    mark = lambda body: F.concat(F.lit("<!-- keep -->"), body, F.lit("<!-- /keep -->"), F.col("text"))
    regions = lambda c: F.regexp_extract_all(c, F.lit(r"(?s)(<!-- keep -->.*?<!-- /keep -->)"), 1)
    old, new = mark(F.lit("a")), mark(F.when(F.col("doc_id") % 3 == 0, "b").otherwise("a"))
    return load(s, d, "documents").select("doc_id", (regions(old) == regions(new)).alias("kept"))


@query(oracle="SELECT p_partkey AS id, p_partkey + 1000 AS value FROM part")
def f25_untraceable(s, d):  # F24, F25, M12
    k = F.col("p_partkey")
    digits = (k + 1000).cast("string")
    drafts = load(s, d, "part").select(k.alias("id"), F.concat(F.lit("In all "), digits, F.lit(" units and 95% of them")).alias("text"))
    found = Q.numbers(drafts).withColumn("value", F.col("value"))
    allowed = s.createDataFrame([(95.0,)], "value double")
    return Q.untraceable(found, allowed).select("id", F.col("value").cast("long").alias("value"))


@query(oracle="WITH c AS (SELECT c_custkey AS id, 'PIN ' || (c_custkey % 700) || '  A' AS pin FROM customer), p AS (SELECT s_suppkey AS parcel, 'PIN ' || s_suppkey || ' A' AS pin FROM supplier) SELECT id, parcel FROM c JOIN p ON trim(regexp_replace(c.pin, '\\s+', ' ', 'g')) = p.pin")
def j33_pin_match(s, d):  # J33, S15
    key = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    k = F.col("c_custkey")
    c = load(s, d, "customer").select(k.alias("id"), key(F.concat(F.lit("PIN "), (k % 700).cast("string"), F.lit("  A"))).alias("pin"))
    p = load(s, d, "supplier").select(F.col("s_suppkey").alias("parcel"), key(F.concat(F.lit("PIN "), F.col("s_suppkey").cast("string"), F.lit(" A"))).alias("pin"))
    return c.join(p, "pin").select("id", "parcel")


@query(oracle="""WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'p-' || p_partkey END AS slug, p_name || ' ' || p_brand AS name FROM part), h AS (SELECT p_partkey AS page, 'p-' || p_partkey AS slug, upper(p_name || ' ' || p_brand) AS name FROM part WHERE p_partkey % 2 = 0), u AS (SELECT lower(name) AS name, min(page) AS page FROM h GROUP BY 1 HAVING count(*) = 1)
    SELECT a.id, coalesce(h.page, u.page) AS page FROM a LEFT JOIN h ON a.slug = h.slug LEFT JOIN u ON lower(a.name) = u.name""")
def j31_cascade_merge(s, d):  # J31: by slug, else by a name that is unique
    k, both = F.col("p_partkey"), F.concat_ws(" ", "p_name", "p_brand")
    p = load(s, d, "part")
    a = p.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("p-"), k.cast("string"))).alias("slug"), F.lower(both).alias("name"))
    h = p.where(k % 2 == 0).select(k.alias("page"), F.concat(F.lit("p-"), k.cast("string")).alias("slug"), F.lower(F.upper(both)).alias("name"))
    unique = h.groupBy("name").agg(F.min("page").alias("_u"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return a.join(h.select("slug", "page"), "slug", "left").join(unique, "name", "left").select("id", F.coalesce("page", "_u").alias("page"))


@query("points", """WITH c AS (SELECT point_id, x AS px, y AS py FROM points) SELECT point_id, CASE WHEN point_id % 20 = 0 THEN 'pin' WHEN point_id % 30 = 0 THEN 'address' WHEN px < 5000 THEN 'map' ELSE 'none' END AS via FROM c""")
def g13_site_ladder(s, d):  # G13: the first way of a ladder that answers
    own = load(s, d, "points")
    tries = [(0, "pin", F.col("point_id") % 20 == 0), (1, "address", F.col("point_id") % 30 == 0), (2, "map", F.col("x") < 5000), (3, "none", F.lit(True))]
    found = own.select("point_id", F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("r"), F.lit(n).alias("via"))) for r, n, c in tries])).alias("t"))
    return found.select("point_id", F.array_min("t")["via"].alias("via"))


@query("points", "SELECT kind, CAST(floor(sum(pop)) AS BIGINT) AS people, '{\"type\":\"Feature\",\"n\":' || CAST(count(*) AS VARCHAR) || '}' AS feature FROM points GROUP BY 1")
def g26_layers(s, d):  # G26, K08, N07
    return load(s, d, "points").groupBy("kind").agg(F.floor(F.sum("pop")).alias("people"), F.to_json(F.struct(F.lit("Feature").alias("type"), F.count(F.lit(1)).alias("n"))).alias("feature"))


@query("chunks", "SELECT chunk_id, chunk_id % 3 = 0 AS embedded FROM chunks WHERE chunk_id % 3 <> 0")
def r06_pending_rows(s, d):  # R06, P07: what a resumable batch has still to do
    c = load(s, d, "chunks").select("chunk_id")
    done = c.where("chunk_id % 3 = 0")
    return c.join(done, "chunk_id", "left_anti").withColumn("embedded", F.lit(False))


@query("meetings", "SELECT meeting_id, CASE WHEN body = 'city_council' THEN 'council' WHEN body = 'planning_commission' THEN 'commission' ELSE 'former' END AS part FROM meetings WHERE duration_seconds IS NOT NULL")
def p19_partition(s, d):  # P10, P17, P19
    part = F.when(F.col("body") == "city_council", "council").when(F.col("body") == "planning_commission", "commission").otherwise("former")
    return load(s, d, "meetings").where("duration_seconds is not null").select("meeting_id", part.alias("part"))


@query(oracle="SELECT DISTINCT lang, source FROM documents")
def a31_facets(s, d):  # A31
    return load(s, d, "documents").select("lang", "source").distinct()


@query(oracle="SELECT lang, avg(CASE WHEN source = 'src0' THEN 1.0 ELSE 0.0 END) AS share, round(avg(length(text)), 6) AS mean_chars, count(*) FILTER (length(text) = n_chars) AS exact FROM documents GROUP BY 1")
def a17_mix(s, d):  # A17, A21
    return load(s, d, "documents").groupBy("lang").agg(F.avg(F.when(F.col("source") == "src0", 1.0).otherwise(0.0)).alias("share"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.count_if(F.length("text") == F.col("n_chars")).alias("exact"))


@query("points", "WITH b AS (SELECT kind, CASE WHEN x < 5000 THEN 'west' ELSE 'east' END AS side, sum(pop) AS pop FROM points GROUP BY 1, 2) SELECT kind, side, pop, pop / sum(pop) OVER (PARTITION BY kind) AS share FROM b")
def g10_cluster_shares(s, d):  # G03: shares of a whole
    b = load(s, d, "points").groupBy("kind", F.when(F.col("x") < 5000, "west").otherwise("east").alias("side")).agg(F.sum("pop").alias("pop"))
    return b.withColumn("share", F.col("pop") / F.sum("pop").over(Window.partitionBy("kind")))


@query("meetings", "SELECT meeting_id AS page_id, CAST(meeting_id AS VARCHAR) AS event_id, CASE WHEN meeting_id % 4 = 0 THEN NULL ELSE CAST(meeting_date AS TIMESTAMP) + INTERVAL 19 HOUR END AS starts_at, meeting_id % 4 = 0 AS in_progress FROM meetings")
def s04_upcoming(s, d):  # S04, F16, P06
    k = F.col("meeting_id")
    when = F.when(k % 4 == 0, "In Progress").otherwise(F.concat(F.date_format("meeting_date", "MMMM d, yyyy"), F.lit(" - 07:00 PM")))
    page = F.concat(F.lit('<table id="upcoming"><tr><td headers="EventName">City Council</td><td headers="EventDate">'), when, F.lit('</td><td><a href="/AgendaViewer.php?event_id='), k.cast("string"), F.lit('">a</a></td></tr></table>'))
    pages = load(s, d, "meetings").select(k.alias("page_id"), page.alias("html"))
    return P.parse_upcoming(pages, "1").select("page_id", "event_id", "starts_at", "in_progress")


@query(oracle="SELECT c_nationkey AS k, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS row_no, CAST(c_custkey AS DOUBLE) AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 9 AS DOUBLE) END AS v FROM customer")
def s12_json_grid(s, d):  # S12: a header row and sentinels
    k = F.col("c_custkey")
    row = F.concat(F.lit('["'), k.cast("string"), F.lit('","'), F.when(k % 4 == 0, "-666666666").otherwise((k % 9).cast("string")), F.lit('"]'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("r")))), lambda x: x["r"]), ",")
    g = load(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.concat(F.lit('[["id","v"],'), body, F.lit("]")).alias("j"))
    return P.json_grid(g, "j", ["id", "v"]).select("k", F.col("row_no").cast("long").alias("row_no"), "id", "v")
