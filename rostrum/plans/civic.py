"""Queries over meetings, updates, votes and mentions, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as X
from rostrum.operators import mentions as M
from rostrum.operators import relational as R
from rostrum.operators import retrieval as V
from rostrum.plans.registry import joined, registry
from rostrum.sources.tables import load

QUERIES, ORACLES, query = registry()
AS_OF = "1999-06-30"


@query("meetings items", "SELECT m.meeting_id, m.title, count(i.item_id) AS n_items FROM meetings m LEFT JOIN items i USING (meeting_id) GROUP BY 1, 2")
def a01_item_counts(s: SparkSession, d: str) -> DataFrame:  # A01
    return R.count_per_parent(load(s, d, "meetings").select("meeting_id", "title"), load(s, d, "items").select("meeting_id"), "meeting_id", "n_items")


@query("meetings updates entities", "SELECT e.entity_id, e.name, count(*) AS n_updates, max(m.meeting_date) AS last_date FROM entities e JOIN updates u USING (entity_id) JOIN meetings m USING (meeting_id) GROUP BY 1, 2")
def a02_update_counts(s, d):  # A02, J06: entities without updates vanish
    dated = load(s, d, "updates").select("entity_id", "meeting_id").join(load(s, d, "meetings").select("meeting_id", "meeting_date"), "meeting_id")
    counts = dated.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_updates"), F.max("meeting_date").alias("last_date"))
    return load(s, d, "entities").select("entity_id", "name").join(counts, "entity_id")


@query("meetings items", f"""SELECT m.body, count(DISTINCT m.meeting_id) AS n_meetings, coalesce(i.motion_result, 'other') AS result, count(*) AS n_votes, count(*) FILTER (i.motion_result = 'passed') AS n_passed
    FROM meetings m JOIN items i USING (meeting_id) WHERE m.meeting_date >= DATE '{AS_OF}' - 365 GROUP BY m.body, coalesce(i.motion_result, 'other')""")
def a03_stats_tiles(s, d):  # A03, P03
    own = R.look_back(load(s, d, "meetings"), "meeting_date", AS_OF, 365).select("meeting_id", "body")
    votes = load(s, d, "items").select("meeting_id", "motion_result").join(own, "meeting_id")
    return votes.groupBy("body", F.coalesce("motion_result", F.lit("other")).alias("result")).agg(F.count_distinct("meeting_id").alias("n_meetings"), F.count(F.lit(1)).alias("n_votes"), F.count_if(F.col("motion_result") == "passed").alias("n_passed"))


@query("meetings", "SELECT body, count(*) AS n, sum(duration_seconds) / 3600.0 AS hours FROM meetings GROUP BY body")
def a03_hours(s, d):  # A03
    return load(s, d, "meetings").groupBy("body").agg(F.count(F.lit(1)).alias("n"), (F.sum("duration_seconds") / 3600.0).alias("hours"))


HOT = """v AS (SELECT DISTINCT entity_id, v FROM (SELECT entity_id, entity_type, lower(name) AS v FROM names UNION ALL SELECT entity_id, entity_type, lower(alias) FROM names) WHERE entity_type <> 'person' AND length(v) >= 5),
    hit AS (SELECT DISTINCT c.chunk_id, c.meeting_id, c.start_seconds, c.end_seconds, v.entity_id FROM c JOIN v ON contains(lower(c.text), v.v))"""


@query("sessions chunks names", f"""WITH own AS (SELECT * FROM sessions ORDER BY meeting_date DESC, meeting_id DESC LIMIT 12), c AS (SELECT chunks.* FROM chunks JOIN own USING (meeting_id)), {HOT},
    r AS (SELECT entity_id, sum(coalesce(CAST(end_seconds - start_seconds AS DOUBLE), 0)) AS seconds, count(*) AS chunk_mentions FROM hit GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30)
    SELECT entity_id, round(seconds, 6) AS seconds, chunk_mentions FROM r WHERE seconds > 0""")
def a04_hot_topics(s, d):  # J08, J12, A04, L05, P12
    out = M.hot_topics(load(s, d, "sessions"), load(s, d, "chunks"), load(s, d, "names"), n=12)
    return out.select("entity_id", F.round("seconds", 6).alias("seconds"), "chunk_mentions")


@query("sessions chunks names", f"""WITH own AS (SELECT * FROM sessions WHERE body = 'city_council' AND meeting_date >= DATE '2024-03-01' - 60 ORDER BY meeting_date DESC, meeting_id DESC LIMIT 12), c AS (SELECT chunks.* FROM chunks JOIN own USING (meeting_id)), {HOT}
    SELECT entity_id, meeting_id, round(sum(coalesce(CAST(end_seconds - start_seconds AS DOUBLE), 0)), 6) AS seconds FROM hit GROUP BY 1, 2""")
def a06_per_meeting(s, d):  # A06, T16: window mode by body
    out = M.hot_topics(load(s, d, "sessions"), load(s, d, "chunks"), load(s, d, "names"), as_of="2024-03-01", days=60, body="city_council", top=1_000_000)
    zero = M.matches(load(s, d, "chunks").join(F.broadcast(M.window_of_meetings(load(s, d, "sessions"), load(s, d, "chunks"), as_of="2024-03-01", body="city_council").select("meeting_id")), "meeting_id"), M.variants(load(s, d, "names").where("entity_type <> 'person'")))
    timed = out.select("entity_id", F.explode("meetings").alias("meeting_id", "seconds"))
    pairs = zero.select("entity_id", "meeting_id").distinct().join(timed, ["entity_id", "meeting_id"], "left")
    return pairs.select("entity_id", "meeting_id", F.round(F.coalesce("seconds", F.lit(0.0)), 6).alias("seconds"))


@query("sessions chunks names", f"""WITH c AS (SELECT * FROM chunks WHERE start_seconds IS NOT NULL AND end_seconds IS NOT NULL), {HOT.replace("entity_type <> 'person' AND ", "")},
    g AS (SELECT h.entity_id, h.meeting_id, s.meeting_date, sum(CAST(end_seconds - start_seconds AS DOUBLE)) AS seconds FROM hit h JOIN sessions s USING (meeting_id) GROUP BY 1, 2, 3)
    SELECT entity_id, meeting_id, meeting_date, round(seconds, 6) AS seconds FROM g QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY meeting_date DESC, meeting_id DESC) <= 24""")
def a05_discussion_series(s, d):  # A05, J10
    out = M.discussion_series(load(s, d, "sessions"), load(s, d, "chunks"), load(s, d, "names"))
    return out.select("entity_id", "meeting_id", "meeting_date", F.round("seconds", 6).alias("seconds"))


@query("items", "SELECT member, coalesce(motion_result, 'none') AS vote, count(*) AS n, count(DISTINCT meeting_id) AS meetings FROM items GROUP BY 1, 2")
def a08_vote_counts(s, d):  # A08, A09
    return load(s, d, "items").groupBy("member", F.coalesce("motion_result", F.lit("none")).alias("vote")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("meeting_id").alias("meetings"))


@query("items", "SELECT meeting_id, count(*) AS n, count(outcome) AS n_outcome, count(motion_result) AS n_result, count(DISTINCT label) AS labels FROM items GROUP BY 1")
def a11_status_counts(s, d):  # A11
    return load(s, d, "items").groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n"), F.count("outcome").alias("n_outcome"), F.count("motion_result").alias("n_result"), F.count_distinct("label").alias("labels"))


@query("items", """SELECT meeting_id, member, string_agg('[' || label || '] ' || title, ' ' ORDER BY item_no) AS texts, max_by(motion_result, item_no) FILTER (motion_result IS NOT NULL) AS status, min(item_no) AS first_item FROM items GROUP BY 1, 2""")
def a12_update_concat(s, d):  # A12
    row = F.struct("item_no", F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("title")).alias("t"))
    return load(s, d, "items").groupBy("meeting_id", "member").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), " ").alias("texts"), F.max_by("motion_result", F.when(F.col("motion_result").isNotNull(), F.col("item_no"))).alias("status"), F.min("item_no").alias("first_item"))


@query("", "SELECT left(CAST(c_custkey + 100000 AS VARCHAR), 4) AS prefix, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer GROUP BY 1")
def a13_prefix_rollup(s, d):  # A13
    return load(s, d, "customer").groupBy(F.left((F.col("c_custkey") + 100000).cast("string"), F.lit(4)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 4).alias("total"))


@query("", "WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'), t AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM s)), c AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS trips FROM t GROUP BY 1) SELECT s_suppkey, coalesce(trips, 0) AS trips FROM supplier LEFT JOIN c ON s_suppkey = l_suppkey")
def a14_weekday_trips(s, d):  # A14, J21, J35
    own = load(s, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"))
    trips = load(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(own, "l_orderkey", "left_semi").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_orderkey").alias("trips"))
    return load(s, d, "supplier").select("s_suppkey").join(trips, "s_suppkey", "left").select("s_suppkey", F.coalesce("trips", F.lit(0)).alias("trips"))


@query("", """WITH t AS (SELECT c_nationkey AS k, sum(c_acctbal) AS a, sum(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) AS h FROM customer GROUP BY 1), city AS (SELECT sum(c_acctbal) / count(*) AS v FROM customer)
    SELECT n_nationkey AS place, round(coalesce(a / nullif(h, 0), v), 6) AS mean_income FROM nation LEFT JOIN t ON n_nationkey = k CROSS JOIN city""")
def a15_mean_income(s, d):  # A15: ratio of sums, then the city's
    c = load(s, d, "customer")
    own = c.groupBy(F.col("c_nationkey").alias("place")).agg(F.try_divide(F.sum("c_acctbal"), F.count_if(F.col("c_custkey") % 3 == 0)).alias("own"))
    city = c.agg((F.sum("c_acctbal") / F.count(F.lit(1))).alias("city"))
    return load(s, d, "nation").select(F.col("n_nationkey").alias("place")).join(own, "place", "left").crossJoin(F.broadcast(city)).select("place", F.round(F.coalesce("own", "city"), 6).alias("mean_income"))


@query("", """WITH r AS (SELECT s_nationkey AS k, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
    q AS (SELECT k, v, r, n, least(greatest(q * (n + 1), 1), n) AS p, q FROM r, (VALUES (0.25), (0.5), (0.75)) AS t(q))
    SELECT k, CAST(q AS DOUBLE) AS q, round(sum(v * CASE WHEN r = floor(p) THEN 1 - (p - floor(p)) WHEN r = floor(p) + 1 THEN p - floor(p) ELSE 0 END), 6) AS value FROM q GROUP BY k, q""")
def a16_comp_quartiles(s, d):  # A16, T5: exclusive quartiles
    own = load(s, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_acctbal")
    parts = [R.exclusive_quantile(own, ["k"], "s_acctbal", q, "value").withColumn("q", F.lit(q)) for q in (0.25, 0.5, 0.75)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("k", "q", F.round("value", 6).alias("value"))


@query("meetings updates items", """SELECT u.update_id, m.meeting_date, i.title, u.status_after FROM updates u JOIN meetings m USING (meeting_id) LEFT JOIN items i ON i.meeting_id = u.meeting_id AND i.item_no = 1 AND u.entity_id % 2 = 0""")
def j02_timeline(s, d):  # J01, J02
    first = load(s, d, "items").where("item_no = 1").select("meeting_id", "title")
    u = load(s, d, "updates").join(load(s, d, "meetings").select("meeting_id", "meeting_date"), "meeting_id")
    return u.join(first, (u["meeting_id"] == first["meeting_id"]) & (u["entity_id"] % 2 == 0), "left").select("update_id", "meeting_date", first["title"], "status_after")


@query("meetings items", "SELECT i.item_id, m.meeting_date, m.body, i.motion_result FROM items i JOIN meetings m USING (meeting_id) WHERE i.motion_result IS NOT NULL")
def j03_vote_rows(s, d):  # J03
    return load(s, d, "items").where("motion_result is not null").join(load(s, d, "meetings"), "meeting_id").select("item_id", "meeting_date", "body", "motion_result")


@query("entities updates", """SELECT e.entity_id, e.name, u.n, CASE WHEN u.n IS NULL THEN 'untracked' ELSE 'tracked' END AS state FROM entities e LEFT JOIN (SELECT entity_id, count(*) AS n FROM updates WHERE status_after = 'approved' GROUP BY 1) u USING (entity_id)""")
def j05_directory(s, d):  # J04, J05
    n = load(s, d, "updates").where("status_after = 'approved'").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return load(s, d, "entities").select("entity_id", "name").join(n, "entity_id", "left").withColumn("state", F.when(F.col("n").isNull(), "untracked").otherwise("tracked"))


RELATED = """p AS (SELECT a.entity, b.entity AS other, count(DISTINCT a.meeting_id) AS shared FROM groups a JOIN groups b ON a.meeting_id = b.meeting_id AND a.entity <> b.entity AND b.entity_type <> 'person' GROUP BY 1, 2 HAVING count(DISTINCT a.meeting_id) >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY shared DESC, other) AS rank FROM p)"""


@query("groups", f"WITH {RELATED} SELECT entity, other, shared, rank FROM r WHERE rank <= 6")
def j07_related_entities(s, d):  # J07, A07
    g = load(s, d, "groups")
    return R.related(g, "entity", "meeting_id", g.where("entity_type <> 'person'").select("entity").distinct())


@query("groups", f"WITH {RELATED}, t AS (SELECT * FROM r WHERE rank <= 4 AND other NOT LIKE '%STEEL%'), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY rank) AS place FROM t) SELECT entity, other, place FROM k WHERE place <= 3")
def e16_map_related(s, d):  # E16, T6: four, then the filter, then three
    g = load(s, d, "groups")
    four = R.related(g, "entity", "meeting_id", g.where("entity_type <> 'person'").select("entity").distinct(), top=4)
    return R.latest_by(four.where(~F.col("other").like("%STEEL%")), ["entity"], [F.col("rank")], 3, "place").select("entity", "other", "place")


@query("chunks names", f"""WITH c AS (SELECT * FROM chunks), {HOT}, v2 AS (SELECT h.chunk_id, h.entity_id, v.v FROM hit h JOIN c USING (chunk_id) JOIN v ON v.entity_id = h.entity_id AND contains(lower(c.text), v.v))
    SELECT chunk_id, entity_id, v AS variant FROM v2 QUALIFY row_number() OVER (PARTITION BY chunk_id, entity_id ORDER BY length(v) DESC, v) = 1""")
def j09_longest_variant(s, d):  # J09
    return M.matches(load(s, d, "chunks"), M.variants(load(s, d, "names").where("entity_type <> 'person'"))).select("chunk_id", "entity_id", "variant")


@query("meetings items", "SELECT meeting_id FROM meetings WHERE meeting_id IN (SELECT meeting_id FROM items WHERE outcome IS NOT NULL)")
def j12_semi(s, d):  # J12
    return load(s, d, "meetings").select("meeting_id").join(load(s, d, "items").where("outcome is not null").select("meeting_id"), "meeting_id", "left_semi")


@query("meetings items", "SELECT meeting_id FROM meetings m WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.meeting_id = m.meeting_id)")
def j13_anti(s, d):  # J13, J14, P08, T8
    return load(s, d, "meetings").select("meeting_id").join(load(s, d, "items").select("meeting_id"), "meeting_id", "left_anti")


@query("", """SELECT coalesce(a.k, b.k) AS k, coalesce(n_orders, 0) AS n_orders, coalesce(n_suppliers, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_orders FROM customer GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) b ON a.k = b.k""")
def j19_full_outer(s, d):  # J18-J20
    a = load(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = load(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return a.join(b, "k", "full").select("k", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


@query("items", """WITH b AS (SELECT meeting_id, lower(rtrim(label, '.')) AS label, start_seconds FROM items QUALIFY row_number() OVER (PARTITION BY meeting_id, lower(rtrim(label, '.')) ORDER BY item_no) = 1)
    SELECT i.item_id, b.start_seconds AS linked_seconds FROM items i JOIN b ON i.meeting_id = b.meeting_id AND lower(rtrim(i.label, '.')) = b.label""")
def j29_first_label_match(s, d):  # J29, T17
    i = load(s, d, "items").withColumn("key", R.normalized_label(F.col("label")))
    build = R.first_per_label(i, ["meeting_id", "key"], ["item_no"]).select("meeting_id", "key", F.col("start_seconds").alias("linked_seconds"))
    return i.select("item_id", "meeting_id", "key").join(build, ["meeting_id", "key"]).select("item_id", "linked_seconds")


@query("", """WITH v AS (SELECT l_orderkey, lower(split_part(s_name, '#', 2)) AS k, l_returnflag AS vote FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) SELECT s.s_suppkey AS member, v.vote, count(*) AS n FROM supplier s JOIN v ON v.k = lower(split_part(s.s_name, '#', 2)) GROUP BY 1, 2""")
def j30_member_votes(s, d):  # J30, N02: votes by a key derived from the name
    key = lambda c: F.lower(F.split_part(c, F.lit("#"), F.lit(2)))
    sup = load(s, d, "supplier")
    ballots = load(s, d, "lineitem").join(sup, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", "l_linenumber", "l_returnflag", key(F.col("s_name")).alias("name")).agg(F.count(F.lit(1)).alias("times"))
    cast = ballots.select("l_orderkey", "times", F.explode(F.create_map("name", "l_returnflag")).alias("name", "vote"))
    return sup.select(F.col("s_suppkey").alias("member"), key(F.col("s_name")).alias("name")).join(cast, "name").groupBy("member", "vote").agg(F.sum("times").alias("n"))


@query("", "SELECT part.p_partkey, p_name FROM part WHERE p_name ILIKE '%s_e%l%'")
def p05_ilike_wildcards(s, d):  # P05
    return load(s, d, "part").where(R.like_text(F.col("p_name"), "s_e%l")).select("p_partkey", "p_name")


@query("", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the%%%')")
def p04_contains(s, d):  # P04, P09
    return load(s, d, "documents").where(R.contains_text(F.col("text"), " The%%% ")).select("doc_id")


@query("meetings", "SELECT meeting_id, meeting_date, body FROM meetings WHERE body = 'city_council' AND meeting_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND NOT title ILIKE '%urgent%' ORDER BY meeting_date DESC, meeting_id DESC LIMIT 50 OFFSET 10")
def l01_meeting_page(s, d):  # P01, P02, P06, L01
    own = R.between_dates(R.where_equal(load(s, d, "meetings"), body="city_council", view_id=None), "meeting_date", "1997-01-01", "1998-12-31")
    return R.page(own.where(~F.col("title").ilike("%urgent%")), [F.col("meeting_date").desc(), F.col("meeting_id").desc()], 50, 10).select("meeting_id", "meeting_date", "body")


@query("meetings", """SELECT meeting_id, CASE WHEN clip_id IS NULL THEN NULL ELSE 'https://video.example.org/MediaPlayer.php?view_id=' || view_id || '&clip_id=' || clip_id || '&entrytime=' || CAST(coalesce(duration_seconds, 0) AS VARCHAR) END AS url FROM meetings""")
def p15_clip_links(s, d):  # P15
    return load(s, d, "meetings").select("meeting_id", X.clip_link(F.col("view_id"), F.col("clip_id"), F.col("duration_seconds")).alias("url"))


@query("items", "SELECT item_id, concat_ws('. ', nullif(title, ''), nullif(outcome, '')) AS text, coalesce(title, '') || ' ' || coalesce(outcome, '') AS search_text FROM items")
def p13_item_text(s, d):  # P13, P14
    return load(s, d, "items").select("item_id", F.concat_ws(". ", F.nullif("title", F.lit("")), F.nullif("outcome", F.lit(""))).alias("text"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("outcome", F.lit(""))).alias("search_text"))


@query("updates meetings", "SELECT entity_id, status_after AS status FROM updates JOIN meetings USING (meeting_id) WHERE status_after IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY meeting_date DESC, update_id DESC) = 1")
def w01_latest_status(s, d):  # W01, W02, E09
    u = load(s, d, "updates").join(load(s, d, "meetings").select("meeting_id", "meeting_date"), "meeting_id")
    return R.last_value_by(u, ["entity_id"], "status_after", ["meeting_date", "update_id"], "status")


@query("updates meetings", "SELECT entity_id, CASE WHEN status_after = 'proposed' THEN 0 WHEN status_after IN ('in_progress', 'deferred') THEN 1 WHEN status_after IN ('approved', 'denied', 'withdrawn', 'completed') THEN 2 END AS stage, min(meeting_date) AS since FROM updates JOIN meetings USING (meeting_id) WHERE status_after IS NOT NULL GROUP BY 1, 2")
def w03_stage_dates(s, d):  # W03
    u = load(s, d, "updates").where("status_after is not null").join(load(s, d, "meetings").select("meeting_id", "meeting_date"), "meeting_id")
    return u.groupBy("entity_id", X.stage_of(F.col("status_after")).alias("stage")).agg(F.min("meeting_date").alias("since"))


@query("items meetings", """WITH x AS (SELECT i.*, m.duration_seconds FROM items i JOIN meetings m USING (meeting_id) WHERE start_seconds < duration_seconds),
    y AS (SELECT meeting_id, item_id, start_seconds, greatest(0, lead(start_seconds, 1, duration_seconds) OVER (PARTITION BY meeting_id ORDER BY start_seconds, item_id) - start_seconds) AS seconds, min(start_seconds) OVER (PARTITION BY meeting_id) AS lead_in, count(*) OVER (PARTITION BY meeting_id) AS n FROM x)
    SELECT meeting_id, item_id, seconds, lead_in FROM y WHERE n >= 2""")
def w04_chapters(s, d):  # W04
    own = load(s, d, "items").join(load(s, d, "meetings").select("meeting_id", "duration_seconds"), "meeting_id")
    return R.chapters(own, "meeting_id", "start_seconds", "duration_seconds", "item_id").select("meeting_id", "item_id", "seconds", "lead_in")


@query("sessions chunks", "SELECT meeting_id, meeting_date FROM sessions WHERE meeting_id IN (SELECT meeting_id FROM chunks) ORDER BY meeting_date DESC, meeting_id DESC LIMIT 12")
def w05_recent(s, d):  # W05
    return M.window_of_meetings(load(s, d, "sessions"), load(s, d, "chunks"), n=12).select("meeting_id", "meeting_date")


@query("items", "SELECT item_id, last_value(outcome IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM items")
def w06_carry_forward(s, d):  # W06
    return R.carry_forward(load(s, d, "items"), ["meeting_id"], ["item_no"], "outcome", "section").select("item_id", "section")


@query("chunks", """WITH RECURSIVE o AS (SELECT meeting_id, CAST(start_seconds AS DOUBLE) AS s, CAST(end_seconds AS DOUBLE) AS e, text, row_number() OVER (PARTITION BY meeting_id ORDER BY turn) AS n FROM chunks),
    f AS (SELECT meeting_id, n, 0 AS part, s, e, text FROM o WHERE n = 1 UNION ALL
          SELECT o.meeting_id, o.n, CASE WHEN length(f.text) >= 700 THEN f.part + 1 ELSE f.part END, CASE WHEN length(f.text) >= 700 THEN o.s ELSE f.s END, o.e, CASE WHEN length(f.text) >= 700 THEN o.text ELSE f.text || ' ' || o.text END
          FROM f JOIN o ON o.meeting_id = f.meeting_id AND o.n = f.n + 1)
    SELECT meeting_id, part, s AS start, round(e, 6) AS "end", text FROM f QUALIFY row_number() OVER (PARTITION BY meeting_id, part ORDER BY n DESC) = 1""")
def w07_segment_merge(s, d):  # W07
    out = R.merge_segments(load(s, d, "chunks"), "meeting_id", "turn", "start_seconds", "end_seconds", "text")
    return out.select("meeting_id", "part", "start", F.round("end", 6).alias("end"), "text")


@query("", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, abs(round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])))), 6)) AS distance
    FROM embeddings, q ORDER BY 2, 1 LIMIT 8""")
def l03_knn(s, d):  # L03, M08, T15
    v = load(s, d, "embeddings")
    return V.nearest(v, v.where("vec_id = 0").first()["embedding"], 8).select("vec_id", F.abs(F.round("distance", 6)).alias("distance"))


@query("chunks sessions", """WITH k AS (SELECT c.chunk_id AS id FROM chunks c JOIN sessions s USING (meeting_id) WHERE contains(lower(c.text), 'the') ORDER BY s.meeting_date DESC, c.chunk_id LIMIT 20),
    q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0),
    near AS (SELECT vec_id AS id, round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), e) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(e, e))), 9) AS distance FROM embeddings, q ORDER BY 2, 1 LIMIT 8),
    v AS (SELECT id FROM near WHERE distance <= 0.55)
    SELECT 'chunk' AS kind, id, 0 AS source_rank FROM k UNION ALL SELECT 'vector', id, 1 FROM v UNION ALL SELECT 'chunk', id, 1 FROM v WHERE id NOT IN (SELECT id FROM k)""")
def u01_hybrid_search(s, d):  # U01, T14, P11
    said = load(s, d, "chunks").join(load(s, d, "sessions").select("meeting_id", "meeting_date"), "meeting_id")
    words = V.keyword(said, F.col("text"), "the", [F.col("meeting_date").desc(), F.col("chunk_id")]).select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    vectors = load(s, d, "embeddings")
    near = V.nearest(vectors, vectors.where("vec_id = 0").first()["embedding"], 8).where("distance <= 0.55")
    both = near.select(F.explode(F.array(F.lit("vector"), F.lit("chunk"))).alias("kind"), F.col("vec_id").alias("id"))
    return V.first_of([words, both], ["kind", "id"])


@query("", """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 5), d AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 'chunk' ELSE 'item' END AS kind, abs(round(1 - list_dot_product(CAST(embedding AS DOUBLE[]), e) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(e, e))), 6)) AS distance FROM embeddings, q),
    k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY kind ORDER BY distance, id) <= 8) SELECT kind, id, distance FROM k ORDER BY distance, kind, id LIMIT 12""")
def l04_rag_merge(s, d):  # L04, T13
    v = load(s, d, "embeddings")
    q = v.where("vec_id = 5").first()["embedding"]
    parts = [V.nearest(v.where(c), q, 8).select(F.lit(k).alias("kind"), F.col("vec_id").alias("id"), F.abs(F.round("distance", 6)).alias("distance")) for k, c in (("chunk", "label < 5"), ("item", "label >= 5"))]
    return V.merge_by_distance(parts, 12)


@query("updates meetings", "SELECT entity_id, count(*) AS n, max(meeting_id) AS last_meeting, max(meeting_date) AS last_date FROM updates JOIN meetings USING (meeting_id) GROUP BY 1 HAVING count(*) >= 3")
def a25_profile_candidates(s, d):  # A25, E10
    u = load(s, d, "updates").join(load(s, d, "meetings").select("meeting_id", "meeting_date"), "meeting_id")
    return u.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("meeting_id").alias("last_meeting"), F.max("meeting_date").alias("last_date")).where("n >= 3")


@query("", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) = 1")
def a24_longest_document(s, d):  # A24
    return load(s, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))


@query("items", "SELECT item_id, meeting_id FROM items QUALIFY row_number() OVER (PARTITION BY meeting_id, label ORDER BY item_no) = 1")
def a23_first_occurrence(s, d):  # A23
    return R.latest_by(load(s, d, "items"), ["meeting_id", "label"], [F.col("item_no")]).select("item_id", "meeting_id")


@query("items", "SELECT meeting_id, label, count(*) AS n FROM items GROUP BY 1, 2 HAVING count(*) > 1")
def t_duplicate_keys(s, d):  # 1.3: keys as data-quality checks
    return R.duplicated_keys(load(s, d, "items"), ["meeting_id", "label"])


@query("items", "SELECT member, n, n / max(n) OVER () AS share FROM (SELECT member, count(*) AS n FROM items GROUP BY 1)")
def w12_share_of_max(s, d):  # W12
    n = load(s, d, "items").groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("_m")))).select("member", "n", (F.col("n") / F.col("_m")).alias("share"))


@query("entities", "SELECT entity_id, name, entity_type FROM entities ORDER BY CASE entity_type WHEN 'project' THEN 0 WHEN 'topic' THEN 1 ELSE 2 END, name, entity_id LIMIT 40")
def l10_reading_order(s, d):  # L02, L10
    rank = F.when(F.col("entity_type") == "project", 0).when(F.col("entity_type") == "topic", 1).otherwise(2)
    return R.page(load(s, d, "entities"), [rank, F.col("name"), F.col("entity_id")], 40)


@query("items", "SELECT meeting_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_no) AS item_ids, count(*) AS n FROM items WHERE motion_result IS NOT NULL GROUP BY 1")
def n04_children(s, d):  # N04, E14
    return load(s, d, "items").where("motion_result is not null").groupBy("meeting_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "item_id"))), lambda x: x["item_id"])).alias("item_ids"), F.count(F.lit(1)).alias("n"))
