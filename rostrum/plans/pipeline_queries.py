"""Queries over idempotent writes, limits, digests and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import upsert as K
from rostrum.plans.registry import joined, registry
from rostrum.sources.tables import load
from rostrum.streaming import streams as T

QUERIES, ORACLES, query = registry()


@query(oracle="""WITH o AS (SELECT c_custkey AS id, c_name AS title, 'fetched' AS status FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, c_name || ' v2' AS title, 'discovered' AS status FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, coalesce(o.status, n.status) AS status FROM o FULL JOIN n ON o.id = n.id""")
def k01_upsert(s, d):  # K01, K07
    c = load(s, d, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k.alias("id"), F.col("c_name").alias("title"), F.lit("fetched").alias("status"))
    new = c.where(k % 2 == 0).select(k.alias("id"), F.concat("c_name", F.lit(" v2")).alias("title"), F.lit("discovered").alias("status"))
    return K.upsert(old, new, ["id"], keep=["status"])


@query(oracle="SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def k02_insert_new(s, d):  # K02
    c = load(s, d, "customer").select(F.col("c_custkey").alias("id"))
    return K.insert_new(c.where("id % 3 <> 0").withColumn("origin", F.lit("old")), c.where("id % 2 = 0").withColumn("origin", F.lit("new")), ["id"])


@query(oracle="SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'old agenda' END ELSE 'new agenda' END AS agenda FROM customer WHERE c_custkey % 2 = 0")
def k03_snapshot(s, d):  # K03, R05
    c, k = load(s, d, "customer"), F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k.alias("id"), F.col("c_name").alias("title"), F.lit("old agenda").alias("agenda"))
    new = c.where(k % 2 == 0).select(k.alias("id"), F.col("c_name").alias("title"), F.when(k % 4 == 0, F.when(k % 8 == 0, "")).otherwise("new agenda").alias("agenda"))
    return K.snapshot(old, new, ["id"], fill=["agenda"])


@query(oracle="SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0 THEN 'new' WHEN c_custkey % 3 <> 0 THEN 'old' WHEN c_custkey % 4 = 0 THEN NULL END AS text FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def k04_partial_merge(s, d):  # K04
    c, k = load(s, d, "customer"), F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k.alias("id"), F.lit("old").alias("text"))
    new = c.where(k % 2 == 0).select(k.alias("id"), F.when(k % 4 == 0, F.when(k % 8 == 0, "")).otherwise("new").alias("text"))
    return K.partial_merge(old, new, ["id"], complete=False)


@query("items", "SELECT item_id, meeting_id, 'old' AS v FROM items WHERE meeting_id % 5 <> 0 UNION ALL SELECT item_id, meeting_id, 'new' FROM items WHERE meeting_id % 5 = 0 AND item_no <= 2")
def k05_replace_groups(s, d):  # K05
    i = load(s, d, "items").select("item_id", "meeting_id", "item_no")
    old = i.select("item_id", "meeting_id", F.lit("old").alias("v"))
    new = i.where("meeting_id % 5 = 0 and item_no <= 2").select("item_id", "meeting_id", F.lit("new").alias("v"))
    return K.replace_groups(old, new, "meeting_id")


@query(oracle="""WITH o AS (SELECT doc_id, left(sha256(text), 16) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, left(sha256(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END), 16) AS h, source FROM documents WHERE doc_id % 7 <> 0)
    SELECT 'page/' || CAST(coalesce(o.doc_id, n.doc_id) AS VARCHAR) AS path, CASE WHEN n.doc_id IS NULL THEN 'deleted' WHEN n.source = 'src3' THEN 'orphaned' WHEN o.doc_id IS NULL THEN 'created' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS outcome FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def k06_hash_sync(s, d):  # K06, E21
    docs = load(s, d, "documents")
    path = F.concat(F.lit("page/"), F.col("doc_id").cast("string")).alias("path")
    old = docs.where("doc_id % 3 <> 0").select(path, F.left(F.sha2("text", 256), F.lit(16)).alias("hash"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    new = docs.where("doc_id % 7 <> 0").select(path, F.col("source").alias("entity"), F.left(F.sha2(text, 256), F.lit(16)).alias("hash"))
    return K.hash_sync(old, new, docs.where("source <> 'src3'").select(F.col("source").alias("entity")))


@query(oracle="SELECT o_orderkey AS event_id, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || CAST(o_orderkey AS VARCHAR) || chr(13) || chr(10) || 'DTSTART:' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || chr(13) || chr(10) || 'DTEND:' || strftime(o_orderdate + INTERVAL 2 HOUR, '%Y%m%dT%H%M%S') || chr(13) || chr(10) || 'SUMMARY:' || replace(o_orderpriority || ', open', ',', '\\,') || chr(13) || chr(10) || 'END:VEVENT' AS entry FROM orders WHERE o_orderkey % 10 <> 0")
def k10_calendar(s, d):  # K10, D03, P07
    o = load(s, d, "orders")
    return K.calendar(o.select(F.col("o_orderkey").alias("event_id"), F.concat("o_orderpriority", F.lit(", open")).alias("title"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("starts_at")))


@query(oracle="SELECT 7 AS run_id, count(*) AS processed, '[\"clip 9: timeout\"]' AS errors FROM orders")
def k11_run_log(s, d):  # K11
    return K.run_log(load(s, d, "orders"), 7, ["clip 9: timeout"])


@query("items", """WITH k AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY meeting_id, label ORDER BY item_no) = 1)
    SELECT meeting_id, 'member ' || CAST(member AS VARCHAR) AS name, string_agg('[' || label || '] ' || title, ' ' ORDER BY item_no) AS update_text, max_by(outcome, item_no) FILTER (outcome IS NOT NULL) AS status_after, min_by(label, item_no) AS first_label FROM k GROUP BY meeting_id, member""")
def e08_apply_extraction(s, d):  # E08, N09, A12, T17
    i = load(s, d, "items")
    entity = F.struct(F.lit("person").alias("entity_type"), F.concat(F.lit("member "), F.col("member").cast("string")).alias("name"), F.lit("mover").alias("role"), F.col("title").alias("update_text"), F.col("outcome").alias("status_after"))
    vote = F.struct(F.col("title").alias("description"), F.col("motion_result"), F.create_map(F.lit("a"), F.lit("yes")).alias("vote_breakdown"))
    item = F.struct("item_no", F.to_json(F.struct("label", "title", "outcome", F.array(vote).alias("votes"), F.array(entity).alias("entities"))).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda r: r["x"])
    raw = i.groupBy("meeting_id").agg(F.concat(F.lit('{"agenda_items": ['), F.array_join(ordered, ", "), F.lit("]}")).alias("json"))
    return K.apply_extractions(raw)["updates"]


@query("hits", """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM hits),
    f AS (SELECT user_id, n, event_id, [ts] AS live, TRUE AS allowed FROM o WHERE n = 1 UNION ALL
    SELECT o.user_id, o.n, o.event_id, CASE WHEN len(list_filter(f.live, lambda t: t >= o.ts - INTERVAL 7 DAY)) < 3 THEN list_append(list_filter(f.live, lambda t: t >= o.ts - INTERVAL 7 DAY), o.ts) ELSE list_filter(f.live, lambda t: t >= o.ts - INTERVAL 7 DAY) END, len(list_filter(f.live, lambda t: t >= o.ts - INTERVAL 7 DAY)) < 3 FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
    SELECT user_id, event_id, allowed FROM f""")
def w13_rate_limit(s, d):  # W13, R03
    return T.rate_limit(load(s, d, "hits"), 3, 7 * 86400)


SUBS = "SELECT 'user' || CAST(c_custkey % 400 AS VARCHAR) || '@example.org' AS email, CAST(1 + c_custkey AS BIGINT) AS entity_id, c_custkey % 5 <> 0 AS confirmed, CAST((c_custkey % 7) * 5000000000 AS BIGINT) AS last_update_id FROM customer"


def subs(s, d):
    k = F.col("c_custkey")
    return load(s, d, "customer").select(F.concat(F.lit("user"), (k % 400).cast("string"), F.lit("@example.org")).alias("email"), (1 + k).alias("entity_id"), (k % 5 != 0).alias("confirmed"), ((k % 7) * 5000000000).alias("last_update_id"))


@query("updates", f"SELECT email, entity_id, string_agg(CAST(update_id AS VARCHAR), ',' ORDER BY update_id) AS update_ids FROM ({SUBS}) AS s JOIN updates USING (entity_id) WHERE confirmed AND update_id > last_update_id GROUP BY 1, 2")
def r02_digest(s, d):  # R01, R02, A33
    return T.digests(subs(s, d), load(s, d, "updates").select("entity_id", "update_id")).withColumn("update_ids", joined(F.col("update_ids")))


@query("updates", f"WITH n AS (SELECT entity_id, max(update_id) AS m FROM updates GROUP BY 1) SELECT email, entity_id, confirmed, CASE WHEN confirmed AND email <> 'user3@example.org' THEN greatest(last_update_id, coalesce(m, last_update_id)) ELSE last_update_id END AS last_update_id FROM ({SUBS}) LEFT JOIN n USING (entity_id)")
def r01_watermark_advance(s, d):  # R01, W09, A26
    own = subs(s, d)
    return T.advanced(own, load(s, d, "updates").select("entity_id", "update_id"), own.where("email <> 'user3@example.org'"))


@query("hits", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM hits GROUP BY 1, 2")
def x01_tumbling(s, d):  # extension
    return T.tumbling(load(s, d, "hits")).select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query("hits", "SELECT date_trunc('day', ts) - INTERVAL 1 DAY * o AS start, count(*) AS n, round(sum(value), 6) AS total FROM hits, (VALUES (0), (1)) AS v(o) GROUP BY 1")
def x02_sliding(s, d):  # extension, R07
    return T.sliding(load(s, d, "hits")).select("start", "n", F.round("total", 6).alias("total"))


@query("hits", "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM hits), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM a) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY user_id, k")
def x03_session(s, d):  # extension
    return T.sessions(load(s, d, "hits")).select("user_id", "start", "n", F.round("total", 6).alias("total"))
