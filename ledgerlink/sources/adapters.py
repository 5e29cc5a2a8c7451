"""The registry-graph model over the star-schema tables.

Each view is one SELECT that both Spark and DuckDB read, so a query and its SQL
twin start from the same rows. WITH lists the views a statement needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerlink.workspace import folder

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS: dict[str, str] = {
    "entities": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS id, 'company' AS entity_type, c_name AS display_name,
               lower(replace(c_name, '#', ' ')) AS normalized_name,
               CASE WHEN c_custkey % 97 = 96 THEN 'C' || CAST(c_custkey - 1 AS STRING) END AS merged_into_id
        FROM customer
        UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'company', s_name, lower(replace(s_name, '#', ' ')), NULL FROM supplier
        UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'address', n_name, lower(n_name), NULL FROM nation
        UNION ALL SELECT 'R' || CAST(r_regionkey AS STRING), 'other', r_name, lower(r_name), NULL FROM region
        UNION ALL SELECT DISTINCT 'U' || CAST(user_id AS STRING), 'person', 'User ' || CAST(user_id AS STRING), 'user ' || CAST(user_id AS STRING), CAST(NULL AS STRING) FROM events""",
    "contracts": """
        SELECT l_suppkey, o_custkey, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey""",
    "relationships": """
        SELECT 'RC' || CAST(c_custkey AS STRING) AS id, 'C' || CAST(c_custkey AS STRING) AS source_id, 'N' || CAST(c_nationkey AS STRING) AS target_id,
               'registered_at' AS relationship_type, f.first_day AS valid_from, CAST(NULL AS DATE) AS valid_to,
               CAST('2002-01-01' AS DATE) AS recorded_on, CAST(NULL AS DATE) AS superseded_on, 'registered' AS confidence, CAST(1.00 AS DECIMAL(3,2)) AS confidence_score
        FROM customer JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY o_custkey) f ON c_custkey = f.o_custkey
        UNION ALL SELECT 'RS' || CAST(s_suppkey AS STRING), 'S' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING), 'registered_at', NULL, NULL,
               CAST('2002-01-01' AS DATE), NULL, 'registered', CAST(1.00 AS DECIMAL(3,2)) FROM supplier
        UNION ALL SELECT 'K' || CAST(l_suppkey AS STRING) || '-' || CAST(o_custkey AS STRING), 'S' || CAST(l_suppkey AS STRING), 'C' || CAST(o_custkey AS STRING), 'contractor_of',
               first_day, CASE WHEN last_day < CAST('2001-01-01' AS DATE) THEN last_day END, CAST('2002-01-01' AS DATE),
               CASE WHEN (l_suppkey * 7 + o_custkey) % 50 = 0 THEN CAST('2003-01-01' AS DATE) END,
               CASE WHEN n >= 3 THEN 'registered' WHEN n = 2 THEN 'high' ELSE 'medium' END,
               CAST(CASE WHEN n >= 3 THEN 1.00 WHEN n = 2 THEN 0.90 ELSE 0.60 END AS DECIMAL(3,2)) FROM contracts
        UNION ALL SELECT 'P' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING), 'N' || CAST(n_nationkey AS STRING), 'parent_of', NULL, NULL,
               CAST('2002-01-01' AS DATE), NULL, 'registered', CAST(1.00 AS DECIMAL(3,2)) FROM nation
        UNION ALL SELECT 'O' || CAST(user_id AS STRING), 'U' || CAST(user_id AS STRING), 'C' || CAST(user_id AS STRING), 'sole_proprietor_of', NULL, NULL,
               CAST('2002-01-01' AS DATE), NULL, 'high', CAST(0.90 AS DECIMAL(3,2)) FROM (SELECT DISTINCT user_id FROM events WHERE user_id > 0) u""",
    "graph_edges": """
        SELECT id, source_id AS from_id, target_id AS to_id, 'out' AS direction, relationship_type, valid_from, valid_to, superseded_on, confidence, confidence_score FROM relationships
        UNION ALL SELECT id, target_id, source_id, 'in', relationship_type, valid_from, valid_to, superseded_on, confidence, confidence_score FROM relationships""",
    "degrees": """
        SELECT from_id AS id, count(*) AS degree FROM graph_edges WHERE superseded_on IS NULL GROUP BY from_id""",
    "companies": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS entity_id, lpad(CAST(c_custkey AS STRING), 10, '0') AS nip,
               CASE WHEN c_custkey % 10 = 0 THEN lpad(CAST(c_custkey AS STRING), 10, '0') END AS krs,
               CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'active' WHEN c_mktsegment = 'FURNITURE' THEN 'suspended' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'deleted' END AS status,
               CAST(c_acctbal AS DECIMAL(18,2)) AS share_capital,
               CASE c_nationkey % 3 WHEN 0 THEN 'mazowieckie' WHEN 1 THEN 'pomorskie' END AS voivodeship,
               CASE WHEN c_custkey % 2 = 0 THEN '62.01.Z' ELSE '46.90.Z' END AS pkd_main
        FROM customer""",
    "identifiers": """
        SELECT entity_id, 'nip' AS scheme, nip AS value FROM companies
        UNION ALL SELECT entity_id, 'krs', krs FROM companies WHERE krs IS NOT NULL""",
    "addresses": """
        SELECT 'A' || CAST(p_partkey AS STRING) AS entity_id, p_type AS city, p_name AS street, p_brand AS building, CAST(NULL AS STRING) AS unit,
               CASE p_size % 3 WHEN 0 THEN 'mazowieckie' WHEN 1 THEN 'pomorskie' END AS voivodeship,
               CASE WHEN p_partkey % 4 <> 0 THEN '00-' || lpad(CAST(p_size AS STRING), 3, '0') END AS postal_code, p_size AS degree
        FROM part""",
    "coordinates": """
        SELECT 'C' || CAST(c_custkey AS STRING) AS entity_id, c_name AS label,
               CASE WHEN c_custkey % 50 <> 49 THEN 49000 + (c_custkey * 7919) % 5500 END AS lat, CASE WHEN c_custkey % 50 <> 49 THEN 14000 + (c_custkey * 104729) % 10000 END AS lon,
               CASE WHEN c_custkey % 97 = 96 THEN 'C' || CAST(c_custkey - 1 AS STRING) END AS merged_into_id, c_custkey % 7 AS degree
        FROM customer""",
    "raw_documents": """
        SELECT doc_id AS id, source, 'D' || CAST(doc_id % 200 AS STRING) AS external_id, text AS payload FROM documents""",
    "provenance": """
        SELECT id AS relationship_id, CAST((ascii(substr(md5(id), 1, 1)) * 256 + ascii(substr(md5(id), 2, 1)) * 16 + ascii(substr(md5(id), 3, 1))) % 200 AS BIGINT) AS document_id FROM relationships WHERE relationship_type <> 'parent_of'""",
    "attribute_log": """
        SELECT event_id, user_id, event_type AS field, CAST(value AS STRING) AS value, ts FROM events""",
    "financials": """
        SELECT o_custkey AS entity_id, CAST(year(o_orderdate) AS INT) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(20,2))) AS DECIMAL(20,2)) AS revenue, max(o_orderkey) AS ordinal
        FROM orders GROUP BY o_custkey, year(o_orderdate)""",
    "tasks": """
        SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS status,
               CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS scheduled_for, CAST(o_orderkey % 6 AS INT) AS attempts, o_custkey % 5 AS source
        FROM orders""",
}


#: Views that many queries share: written once for each data set, then read.
STORED = ("relationships", "entities", "degrees", "provenance")
_stored: dict[tuple[str, str, str], str] = {}


def needed(sql: str, stored: tuple[str, ...] = ()) -> list[str]:
    """The views a statement needs, directly or through others that are not stored, in the order of VIEWS."""
    found: set[str] = set()

    def add(text: str) -> None:
        for v in VIEWS:
            if v not in found and v not in stored and re.search(rf"\b{v}\b", text):
                found.add(v)
                add(VIEWS[v])

    add(sql)
    return [v for v in VIEWS if v in found]


def with_views(sql: str, stored: tuple[str, ...] = ()) -> str:
    """sql, a SELECT or WITH, with the views it needs in front; stored ones are tables."""
    sql, views = sql.strip(), needed(sql, stored)
    if not views:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    return f"WITH {head}{', ' + sql[5:] if sql[:5].upper() == 'WITH ' else ' ' + sql}"


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The DataFrame of sql over the tables in sf_dir; names are bound when it is made."""
    full = with_views(sql, STORED)
    for v in STORED:
        if re.search(rf"\b{v}\b", full):
            _store(spark, sf_dir, v).createOrReplaceTempView(v)
    return _bound(spark, sf_dir, full)


def _bound(spark: SparkSession, sf_dir: str, full: str) -> DataFrame:
    for t in BASE:
        if re.search(rf"\b{t}\b", full):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(full)


def _store(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared view as a table: written at its first use by this application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = folder(spark, name)
        _bound(spark, sf_dir, with_views(f"SELECT * FROM {name}")).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, f"SELECT * FROM {name}")
