"""Logical tables: projections that give the star schema's tables the shape of civic records.

Each is plain SQL over base tables in braces, so the same text feeds Spark and, in checks, another engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADAPTERS: dict[str, str] = {
    "meetings": """
        SELECT o_orderkey AS meeting_id, CAST(o_orderdate AS DATE) AS meeting_date,
               CASE o_orderstatus WHEN 'F' THEN 'city_council' WHEN 'O' THEN 'planning_commission' ELSE 'school_board' END AS body,
               o_orderpriority AS title, CAST(1 + o_custkey % 3 AS STRING) AS view_id,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS clip_id,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 20000 END AS duration_seconds
        FROM {orders}""",
    "items": """
        SELECT meeting_id, item_no, meeting_id * 1000 + item_no AS item_id, label, title, outcome, motion_result, start_seconds, member
        FROM (SELECT l_orderkey AS meeting_id,
                     ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS item_no,
                     CONCAT(CAST(l_linenumber AS STRING), '.') AS label, CONCAT('Item on part ', CAST(l_partkey AS STRING)) AS title,
                     CASE WHEN l_linestatus = 'F' THEN 'approved as amended' ELSE NULL END AS outcome,
                     CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'R' THEN 'failed' ELSE NULL END AS motion_result,
                     CAST(floor(l_quantity) AS BIGINT) * 100 AS start_seconds, l_suppkey % 20 AS member
              FROM {lineitem}) AS x""",
    "entities": """
        SELECT p_partkey AS entity_id, CONCAT(p_name, ' ', p_brand) AS name,
               CASE p_partkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'project' WHEN 2 THEN 'location' ELSE 'topic' END AS entity_type
        FROM {part}""",
    "updates": """
        SELECT DISTINCT l_orderkey * 1000000 + l_partkey AS update_id, l_partkey AS entity_id, l_orderkey AS meeting_id,
               CASE (l_orderkey + l_partkey) % 6 WHEN 0 THEN 'proposed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'approved' WHEN 3 THEN 'denied' ELSE NULL END AS status_after,
               CONCAT('update ', CAST(l_partkey AS STRING), ' at ', CAST(l_orderkey AS STRING)) AS update_text
        FROM {lineitem}""",
    "groups": """
        SELECT DISTINCT CONCAT(p.p_brand, ' ', p.p_type) AS entity, CASE WHEN p.p_brand LIKE '%2' THEN 'person' ELSE 'topic' END AS entity_type, l.l_orderkey AS meeting_id
        FROM {lineitem} AS l JOIN {part} AS p ON l.l_partkey = p.p_partkey""",
    "sessions": """
        SELECT DISTINCT conv_id AS meeting_id, CASE conv_id % 3 WHEN 0 THEN 'city_council' WHEN 1 THEN 'planning_commission' ELSE 'school_board' END AS body,
               CONCAT('session ', CAST(conv_id AS STRING)) AS title, date_add(DATE '2024-01-01', CAST(conv_id % 200 AS INT)) AS meeting_date
        FROM {conversations}""",
    "chunks": """
        SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS meeting_id, turn, text,
               CASE WHEN turn % 5 = 4 THEN NULL ELSE turn * 60 END AS start_seconds,
               CASE WHEN turn % 5 = 4 THEN NULL ELSE turn * 60 + LENGTH(text) / CAST(15 AS DOUBLE) END AS end_seconds
        FROM {conversations}""",
    "names": """
        SELECT item_id AS entity_id, CASE WHEN item_id % 6 = 5 THEN 'person' ELSE 'topic' END AS entity_type, LOWER(split_part(text, ' ', 2)) AS name, LOWER(split_part(text, ' ', 5)) AS alias
        FROM {benchmark}""",
    "points": """
        SELECT c_custkey AS point_id, CAST((c_custkey * 7919) % 10007 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 10009 AS DOUBLE) AS y,
               CAST(1 + c_custkey % 50 AS DOUBLE) AS pop, c_nationkey AS kind
        FROM {customer}""",
    "nodes": """
        SELECT s_suppkey AS node_id, CAST((s_suppkey * 6151) % 10007 AS DOUBLE) AS x, CAST((s_suppkey * 3571) % 10009 AS DOUBLE) AS y FROM {supplier}""",
    "edges": """
        SELECT n_nationkey AS u, (n_nationkey + 1) % 25 AS v, CAST(1 + (n_nationkey * 7) % 5 AS DOUBLE) AS minutes FROM {nation}
        UNION ALL SELECT n_nationkey AS u, (n_nationkey * 3 + 2) % 25 AS v, CAST(3 + n_nationkey % 4 AS DOUBLE) AS minutes FROM {nation}""",
    "destinations": """
        SELECT n.n_nationkey AS origin, s.s_suppkey AS dest,
               CASE WHEN s.s_acctbal > 0 THEN 1.0 + s.s_suppkey % 5 ELSE 0.0 END AS attractiveness,
               CAST(2 + (n.n_nationkey * 3 + s.s_suppkey * 5) % 40 AS DOUBLE) AS walk_min, CAST(1 + (n.n_nationkey + s.s_suppkey * 2) % 15 AS DOUBLE) AS drive_min,
               CAST(1 + (n.n_nationkey * 2 + s.s_suppkey * 3) % 25 AS DOUBLE) AS bike_min, s.s_nationkey < 12 AS in_city
        FROM {nation} AS n CROSS JOIN {supplier} AS s""",
    "corners": """
        SELECT s_suppkey AS parcel_id, s_nationkey AS site, r.ring, r.n, CAST((s_suppkey * 6151) % 10007 + r.dx * (20 + s_suppkey % 90) AS DOUBLE) AS x,
               CAST((s_suppkey * 3571) % 10009 + r.dy * (20 + s_suppkey % 70) AS DOUBLE) AS y
        FROM {supplier} CROSS JOIN (VALUES (0, 0, 0, 0), (0, 1, 10, 1), (0, 2, 9, 6), (0, 3, 5, 4), (0, 4, 6, 10), (0, 5, 1, 8), (1, 0, 3, 2), (1, 1, 6, 2), (1, 2, 4, 3)) AS r(ring, n, dx, dy)
        WHERE r.ring = 0 OR s_suppkey % 2 = 0""",
    "lots": """
        SELECT c_custkey AS lot_id, c_nationkey AS site, (c_custkey * 7919) % 1000 AS x0, (c_custkey * 104729) % 1000 AS y0, 20 + c_custkey % 60 AS w, 20 + c_custkey % 45 AS h FROM {customer}""",
    "lines": """
        SELECT n_nationkey AS line_id, v.n, CAST((n_nationkey * 3977 + v.n * 1303) % 10007 AS DOUBLE) AS x, CAST((n_nationkey * 2791 + v.n * v.n * 811) % 10009 AS DOUBLE) AS y
        FROM {nation} CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(n) WHERE n_nationkey % 5 <> 0 OR v.n = 0""",
    "corner_nodes": """
        SELECT s_suppkey AS node, -77.3 + (s_suppkey % 10) * 0.001 AS x, 38.85 + floor(s_suppkey / 10) * 0.001 AS y, 1 + s_suppkey % 7 AS pop, s_suppkey % 5 AS shops FROM {supplier}""",
    "streets": """
        WITH n AS (SELECT count(*) AS n FROM {supplier}),
             e AS (SELECT s_suppkey AS u, s_suppkey + 1 AS v, s_suppkey, CONCAT('Row ', CAST(floor(s_suppkey / 10) AS INT), ' Street') AS street FROM {supplier} CROSS JOIN n WHERE s_suppkey % 10 < 9 AND s_suppkey + 1 < n
                   UNION ALL SELECT s_suppkey, s_suppkey + 10, s_suppkey, CONCAT('Col ', s_suppkey % 10, ' Avenue') FROM {supplier} CROSS JOIN n WHERE s_suppkey + 10 < n),
             t AS (SELECT u, v, CASE WHEN s_suppkey % 13 = 12 THEN NULL WHEN s_suppkey % 17 = 16 THEN 'Route 236' ELSE street END AS street, CAST(1 + (s_suppkey * 7) % 5 AS DOUBLE) AS minutes, CAST(80 + (s_suppkey * 7) % 40 AS DOUBLE) AS length FROM e)
        SELECT u, v, street, minutes, length FROM t UNION ALL SELECT v, u, street, minutes, length FROM t""",
    "hits": """
        SELECT event_id, ts, user_id, event_type, value, props FROM {events}""",
}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a logical one."""
    if name not in ADAPTERS:
        return base(spark, sf_dir, name)
    used = set(re.findall(r"\{(\w+)\}", ADAPTERS[name]))
    return spark.sql(ADAPTERS[name], **{t: base(spark, sf_dir, t) for t in used})


def portable(name: str) -> str:
    """The adapter's text for an engine where the base tables are views."""
    text = re.sub(r"\{(\w+)\}", r"\1", ADAPTERS[name]).strip()
    return re.sub(r"date_add\((DATE '[-\d]+'), (CAST\(.*? AS INT\))\)", r"(\1 + \2)", text)


def with_tables(names: str, sql: str) -> str:
    """sql under a WITH clause that defines the named logical tables."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({portable(n)})" for n in names.split()) + (", " if sql.lstrip().lower().startswith("with ") else " ") + re.sub(r"^\s*with\s+(recursive\s+)?", "", sql, flags=re.I)
