"""Books derived from the synthetic tables; each view is SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS = {
    "jobs": """SELECT CAST(o_custkey % 40 AS INT) AS book_id, 'j' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS serial,
       'Task ' || CAST(o_orderkey % 97 AS STRING) AS job,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS due,
       CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'important' ELSE 'normal' END AS priority,
       CASE WHEN o_orderkey % 13 = 0 THEN 'Remark ' || o_orderpriority ELSE '' END AS remarks,
       o_orderkey % 3 = 0 AS weekly_report, o_orderkey % 4 = 0 AS planner, o_orderkey % 5 = 0 AS ra, o_orderkey % 7 = 0 AS ptw,
       CASE WHEN o_orderkey % 7 = 0 THEN 'PERMIT ' || CAST(o_orderkey % 11 AS STRING) ELSE '' END AS ptw_type,
       CASE o_orderkey % 9 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'fortnightly' WHEN 3 THEN 'monthly'
            WHEN 4 THEN 'quarterly' WHEN 5 THEN 'halfyearly' WHEN 6 THEN 'yearly' ELSE '' END AS repeat,
       CAST(o_orderkey % 6 AS INT) AS n_photos, o_orderstatus = 'F' AS done,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 - 7 AS INT) END AS date_completed,
       CAST(o_orderdate AS DATE) + CAST(-10 AS INT) AS created_at
FROM orders""",
    "extras": """SELECT CAST(o_custkey % 40 AS INT) AS book_id, 'x' || CAST(o_orderkey AS STRING) AS id,
       'Extra ' || CAST(o_orderkey % 31 AS STRING) AS job, CAST(o_orderdate AS DATE) AS date,
       o_orderkey % 2 = 0 AS ra, 'PERMIT ' || CAST(o_orderkey % 11 AS STRING) AS ptw_type, '' AS remarks
FROM orders""",
    "photo_refs": """SELECT CAST(o.o_custkey % 40 AS INT) AS book_id, 'j' || CAST(o.o_orderkey AS STRING) AS job_id, n.i AS pos,
       'p:' || CAST(o.o_orderkey AS STRING) || '-' || CAST(n.i AS STRING) AS ref
FROM orders o JOIN (VALUES (0),(1),(2),(3),(4)) AS n(i) ON n.i < o.o_orderkey % 6""",
    "media": """SELECT 'p:' || CAST(o.o_orderkey AS STRING) || '-' || CAST(n.i AS STRING) AS ref,
       CAST(o.o_orderdate AS DATE) AS stored
FROM orders o JOIN (VALUES (0),(1),(2),(3),(4),(5)) AS n(i) ON n.i <= o.o_orderkey % 6""",
    "crew": """SELECT CAST(c_custkey % 40 AS INT) AS book_id, 'c' || CAST(c_custkey AS STRING) AS id, c_name AS name,
       c_mktsegment AS rank, 'Vessel ' || CAST(c_custkey % 40 AS STRING) AS ship,
       CAST('1960-01-01' AS DATE) + CAST(c_custkey * 37 % 14000 AS INT) AS dob
FROM customer""",
    "cargo_readings": """SELECT CAST(user_id % 40 AS INT) AS book_id, CAST(ts AS DATE) AS date, CAST(extract(hour FROM ts) AS INT) AS hour,
       CAST(event_id % 4 + 1 AS INT) AS tank, event_type AS field, value, event_id AS seq
FROM events""",
    "spend": """SELECT user_id AS book_id, 's' || CAST(event_id AS STRING) AS id, CAST(ts AS DATE) AS date, value AS amount,
       'cat' || CAST(event_id % 17 AS STRING) AS cat, event_type AS note
FROM events WHERE event_type IN ('purchase','click')""",
    "loans": """SELECT CAST(c_custkey % 150 AS BIGINT) AS book_id, 'l' || CAST(c_custkey AS STRING) AS id,
       100000.0 + abs(c_acctbal) * 100 AS principal,
       CAST(CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 6 + (c_custkey % 60) / 10.0 END AS DOUBLE) AS rate,
       CAST(12 * (1 + c_custkey % 20) AS INT) AS months, CAST('2024-01-01' AS DATE) AS start,
       CASE WHEN c_custkey % 41 = 0 THEN CAST(100.0 AS DOUBLE) END AS emi
FROM customer""",
    "prepayments": """SELECT CAST(o_custkey % 150 AS BIGINT) AS book_id, 'l' || CAST(o_custkey AS STRING) AS loan_id, 'p' || CAST(o_orderkey AS STRING) AS id,
       CAST(1 + o_orderkey % 36 AS INT) AS month_no, o_totalprice / 80 AS amount
FROM orders""",
    "holdings": """SELECT CAST(p_partkey % 150 AS BIGINT) AS book_id, 'h' || CAST(p_partkey AS STRING) AS id,
       CASE p_partkey % 5 WHEN 0 THEN 'equity' WHEN 1 THEN 'mf' WHEN 2 THEN 'bond' WHEN 3 THEN 'fd' ELSE 'rd' END AS kind,
       CAST(p_size AS DOUBLE) AS units, p_retailprice * 0.9 AS buy, p_retailprice AS price,
       p_retailprice * 100 AS principal, p_retailprice AS monthly, CAST(5 + p_partkey % 4 AS DOUBLE) AS rate,
       CAST(12 + p_partkey % 49 AS INT) AS months, CAST(4 AS INT) AS comp, CAST('2000-01-01' AS DATE) AS start
FROM part""",
    "prices": """SELECT CAST(l_partkey % 150 AS BIGINT) AS book_id, 'h' || CAST(l_partkey AS STRING) AS holding_id, CAST(l_shipdate AS DATE) AS d,
       max(l_extendedprice / l_quantity) AS p, max(l_orderkey) AS upd
FROM lineitem WHERE l_partkey % 5 < 3 GROUP BY 1, 2, 3""",
    "side_a": """SELECT CAST(o_custkey % 40 AS INT) AS book_id, 'jobs' AS list, 'j' || CAST(o_orderkey AS STRING) AS id,
       o_orderkey % 1000 AS upd, CAST(o_orderkey % 2 AS INT) AS ctr, 'dA' AS dev, o_totalprice AS amount
FROM orders WHERE o_orderkey % 3 <> 0""",
    "side_b": """SELECT CAST(o_custkey % 40 AS INT) AS book_id, 'jobs' AS list, 'j' || CAST(o_orderkey AS STRING) AS id,
       (o_orderkey * 7) % 1000 AS upd, CAST(o_orderkey % 5 % 2 AS INT) AS ctr, 'dB' AS dev, o_totalprice + 1 AS amount
FROM orders WHERE o_orderkey % 3 <> 1""",
    "tombs": """SELECT CAST(o_custkey % 40 AS INT) AS book_id, 'j' || CAST(o_orderkey AS STRING) AS id,
       (o_orderkey * 3) % 1000 AS upd, CAST(0 AS INT) AS ctr, 'dB' AS dev
FROM orders WHERE o_orderkey % 10 = 0""",  # the records that were deleted
    "voyages": """SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS departure,
       CAST(CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 100 + o_orderkey % 5000 END AS DOUBLE) AS distance_nm,
       CAST((o_orderkey % 200) / 10.0 AS DOUBLE) AS speed_kn
FROM orders""",
    "positions": """SELECT c_custkey AS id, c_name AS name, CAST((c_custkey * 3701 % 36000) / 100.0 - 180 AS DOUBLE) AS lon,
       CAST((c_custkey * 5303 % 17000) / 100.0 - 85 AS DOUBLE) AS lat
FROM customer""",
    "calls": """SELECT CAST(s_suppkey % 40 AS INT) AS book_id, 'k' || CAST(s_suppkey AS STRING) AS id,
       CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE 'Port ' || CAST(s_nationkey AS STRING) END AS port,
       CASE s_suppkey % 4 WHEN 0 THEN 'arrival' WHEN 1 THEN 'departure' WHEN 2 THEN 'lastmin' ELSE 'takingover' END AS kind,
       CAST('1996-01-01' AS DATE) + CAST(s_suppkey * 17 % 2000 AS INT) AS date,
       CASE WHEN s_suppkey % 4 IN (0, 2) THEN CAST('1996-01-03' AS DATE) + CAST(s_suppkey * 17 % 2000 AS INT) END AS arrival
FROM supplier""",
    "checklist": """SELECT k.kind AS kind, n.i AS seq, 'Item ' || CAST(n.i AS STRING) AS item, n.i = 4 AS ra, n.i = 7 AS ptw
FROM (VALUES ('arrival'),('departure'),('lastmin'),('takingover')) AS k(kind)
CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8)) AS n(i)""",
    "cash_items": """SELECT CAST(s_suppkey % 150 AS BIGINT) AS book_id, 'i' || CAST(s_suppkey AS STRING) AS id, s_name AS name,
       CASE WHEN s_suppkey % 2 = 0 THEN 'income' ELSE 'fixed' END AS list, abs(s_acctbal) AS amount,
       CASE s_suppkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' ELSE 'yearly' END AS cycle,
       CAST('2023-01-01' AS DATE) + CAST(31 * (s_suppkey % 12) AS INT) AS start
FROM supplier""",
    "goal_payments": """SELECT user_id AS book_id, 'g' || CAST(user_id AS STRING) AS goal_id, 'gp' || CAST(event_id AS STRING) AS id,
       CAST(ts AS DATE) AS date, value AS amount
FROM events WHERE event_type = 'signup'""",
    "search_docs": """SELECT doc_id, source AS category, substring(text, 1, 80) AS title, text AS body, doc_id % 10 = 0 AS pinned
FROM documents""",
    "plans": """SELECT CAST(c_custkey % 150 AS BIGINT) AS book_id, CAST((c_custkey - c_custkey % 150) / 150 AS BIGINT) AS id, CASE WHEN c_custkey % 12 IN (3, 6, 9) THEN 0.0 ELSE 1000.0 + c_custkey % 90 END AS monthly,
       CASE WHEN c_custkey % 3 = 0 THEN 50000.0 ELSE 0.0 END AS lump, CAST(4 + c_custkey % 9 AS DOUBLE) AS rate,
       CAST(1 + c_custkey % 5 AS INT) AS years, CAST(c_custkey % 3 * 5 AS DOUBLE) AS step, CAST(12 AS INT) AS comp,
       CAST(200000 AS DOUBLE) AS target
FROM customer""",
    "repeat_days": "SELECT * FROM (VALUES ('daily',1),('weekly',7),('fortnightly',14),('monthly',30),('quarterly',90),('halfyearly',180),('yearly',365)) AS t(code, days)",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in sf_dir."""
    sql = VIEWS[name]
    for t in TABLES:
        if f"FROM {t}" in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def with_views(query: str, *names: str) -> str:
    """The query with these views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + query
