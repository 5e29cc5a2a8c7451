"""Backfills and keys, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlink.operators import backfill
from ledgerlink.sources.adapters import frame, view, with_views

#: An entry of every company; others of them have no address for post, no codes, or no number in their id.
ENTRIES = """SELECT CASE WHEN c_custkey % 5 = 0 THEN 'bzp/' ELSE 'ceidg/firma/' END || lpad(CAST(c_custkey AS STRING), 10, '0') AS external_id,
  '{"firma": "x", "adresDzialalnosci": {"kod": "00-95' || CAST(c_custkey % 10 AS STRING) || '"' || CASE c_custkey % 3 WHEN 0 THEN ', "terc": "14' || CAST(c_nationkey AS STRING) || '", "simc": ""' WHEN 1 THEN ', "ulic": "7"' ELSE '' END || '}'
  || CASE c_custkey % 4 WHEN 0 THEN ', "adresKorespondencyjny": {"ulica": "Polna", "budynek": "", "kod": "00-950", "miasto": "Radom"}' WHEN 1 THEN ', "adresKorespondencyjny": {"kod": "00-951"}' WHEN 2 THEN ', "adresKorespondencyjny": null' ELSE '' END || '}' AS payload FROM customer"""
ADDRESSES = "SELECT 'N' || CAST(n_nationkey AS STRING) AS entity_id, CASE WHEN n_nationkey % 2 = 0 THEN 'kept' END AS teryt, 'old' AS simc, CAST(NULL AS STRING) AS ulic FROM nation"
REGISTERED = "SELECT source_id, target_id, relationship_type, superseded_on FROM relationships"
#: Registrations on overlapping pages; of a company two numbers.
REGISTRATIONS = "SELECT 'L' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 2 AS STRING) AS lei, o_orderstatus || CAST(o_orderkey AS STRING) AS status, o_orderkey AS ordinal FROM orders"
LEIS = "SELECT 'C' || CAST(c_custkey AS STRING) AS entity_id, 'lei' AS scheme, 'L' || CAST(c_custkey AS STRING) || '-' || CAST(k AS STRING) AS value FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) x"
#: Partners: a customer's owner in the partnership of its nation.
PARTNERS = """SELECT 'U' || CAST(c_custkey AS STRING) AS source_id, 'P' || CAST(c_nationkey AS STRING) AS target_id, 'partner_in' AS relationship_type, CASE WHEN c_custkey % 9 = 0 THEN CAST('2001-01-01' AS DATE) END AS superseded_on FROM customer
  UNION ALL SELECT 'U' || CAST(c_custkey AS STRING), 'C' || CAST(c_custkey AS STRING), 'sole_proprietor_of', NULL FROM customer WHERE c_custkey % 4 <> 0"""
NAMED = "SELECT 'C' || CAST(c_custkey AS STRING) AS id, c_name AS display_name FROM customer UNION ALL SELECT 'P' || CAST(n_nationkey AS STRING), CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'Spółka cywilna NIP ' || CAST(n_nationkey AS STRING) END FROM nation"
WANTED = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'mazowieckie' WHEN 1 THEN '' END AS voivodeship FROM part"
FOUND = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '1465' WHEN 1 THEN '2201' WHEN 2 THEN '99' END AS teryt, p_size AS lat, p_partkey AS lon FROM part WHERE p_partkey % 5 <> 0"


def coded_addresses(spark, sf_dir):
    return backfill.coded_addresses(frame(spark, sf_dir, ADDRESSES), frame(spark, sf_dir, ENTRIES), view(spark, sf_dir, "identifiers"), frame(spark, sf_dir, REGISTERED))


CODED = f"""WITH s AS (SELECT 'N' || c_nationkey AS id, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '14' || c_nationkey END AS terc, CASE WHEN c_custkey % 3 = 1 THEN '7' END AS ulic FROM customer
  WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 2 AND 'RC' || c_custkey IN (SELECT id FROM relationships WHERE superseded_on IS NULL)),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY c_custkey) = 1)
SELECT a.entity_id, coalesce(a.teryt, f.terc) AS teryt, CASE WHEN f.id IS NULL THEN a.simc END AS simc, f.ulic FROM ({ADDRESSES}) a LEFT JOIN f ON f.id = a.entity_id"""


def correspondence(spark, sf_dir):
    return backfill.correspondence(frame(spark, sf_dir, ENTRIES), view(spark, sf_dir, "identifiers"))


def lei_registrations(spark, sf_dir):
    found = backfill.lei_registrations(frame(spark, sf_dir, REGISTRATIONS), frame(spark, sf_dir, LEIS))
    return found.select("entity_id", F.array_join(F.transform("lei_records", lambda r: F.concat_ws("=", r["lei"], r["status"])), ",").alias("records"))


def partner_names(spark, sf_dir):
    return backfill.partner_names(frame(spark, sf_dir, PARTNERS), frame(spark, sf_dir, NAMED)).select("partnership_id", F.array_join("names", ",").alias("names"))


def accepted_points(spark, sf_dir):
    return backfill.accepted_points(frame(spark, sf_dir, WANTED), frame(spark, sf_dir, FOUND))[0]


def geocoder_counts(spark, sf_dir):
    return backfill.accepted_points(frame(spark, sf_dir, WANTED), frame(spark, sf_dir, FOUND))[1]


JUDGED = f"""SELECT w.id, f.teryt, f.lat, f.lon, f.id IS NOT NULL AS hit, coalesce(w.voivodeship <> '' AND CASE f.teryt WHEN '1465' THEN 'mazowieckie' WHEN '2201' THEN 'pomorskie' END <> w.voivodeship, FALSE) AS other FROM ({WANTED}) w LEFT JOIN ({FOUND}) f ON f.id = w.id"""


def touching(spark, sf_dir):
    ids = frame(spark, sf_dir, "SELECT 'C' || CAST(c_custkey AS STRING) AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'S1'")
    return backfill.touching(view(spark, sf_dir, "relationships"), ids).select("id", "source_id", "target_id")


def keys(spark, sf_dir):
    p = frame(spark, sf_dir, "SELECT p_partkey AS id, ' ' || p_name AS city, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS street, CAST(p_size AS STRING) AS building, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE 'Jan ' END AS first_name FROM part")
    return p.select("id", backfill.geocoder_query(F.col("city"), F.col("street"), F.col("building")).alias("query"), backfill.candidate_key(F.lit("person"), F.col("street"), F.col("building"), F.lit("")).alias("key"), backfill.person_name(F.col("first_name"), F.col("city")).alias("name"))


def payload_digests(spark, sf_dir):
    """Objects that differ in the order of their keys have one digest."""
    rows = frame(spark, sf_dir, """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '{"a": "' || o_orderstatus || '", "b": "1"}' WHEN 1 THEN '{"b":"1", "a":"' || o_orderstatus || '"}' ELSE 'no json' END AS payload FROM orders""")
    return rows.select("id", backfill.content_digest(F.col("payload")).alias("sha256"), backfill.has_key("payload", "b").alias("has_b"))


QUERIES = {
    "coded_addresses": (coded_addresses, CODED),
    "correspondence": (correspondence, "SELECT 'C' || c_custkey AS entity_id, CASE c_custkey % 4 WHEN 0 THEN 'Polna 00-950 Radom' ELSE '00-951' END AS address, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 10 <> 0 ELSE c_custkey % 10 <> 1 END AS differs FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 < 2"),
    "lei_registrations": (lei_registrations, f"""SELECT 'C' || c_custkey AS entity_id, string_agg(lei || '=' || status, ',' ORDER BY lei) AS records FROM (SELECT * FROM ({REGISTRATIONS}) r QUALIFY row_number() OVER (PARTITION BY lei ORDER BY ordinal DESC) = 1) l JOIN customer ON lei IN ('L' || c_custkey || '-0', 'L' || c_custkey || '-1') GROUP BY c_custkey"""),
    "partner_names": (partner_names, "SELECT 'P' || c_nationkey AS partnership_id, string_agg(c_name, ',' ORDER BY c_name) AS names FROM customer WHERE c_nationkey % 3 <> 0 AND c_custkey % 9 <> 0 AND c_custkey % 4 <> 0 GROUP BY c_nationkey"),
    "accepted_points": (accepted_points, f"SELECT id, teryt, lat, lon FROM ({JUDGED}) j WHERE hit AND NOT other"),
    "geocoder_counts": (geocoder_counts, f"SELECT count(*) AS checked, count(*) FILTER (NOT hit) AS not_found, count(*) FILTER (hit AND other) AS rejected, count(*) FILTER (hit AND NOT other) AS accepted FROM ({JUDGED}) j"),
    "touching": (touching, "WITH n AS (SELECT 'C' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'S1') SELECT id, source_id, target_id FROM relationships r WHERE EXISTS (SELECT 1 FROM n WHERE n.id = r.source_id) OR EXISTS (SELECT 1 FROM n WHERE n.id = r.target_id)"),
    "keys": (keys, """SELECT p_partkey AS id, trim(replace(p_name || ', ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END || ' ' || p_size, '  ', ' ')) AS query,
      'person:' || CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) || '|' ELSE '' END || p_size AS key, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Jan ' END || p_name AS name FROM part"""),
    "payload_digests": (payload_digests, """SELECT o_orderkey AS id, sha256(CASE o_orderkey % 3 WHEN 2 THEN 'no json' ELSE '{"a":"' || o_orderstatus || '","b":"1"}' END) AS sha256, o_orderkey % 3 <> 2 AS has_b FROM orders"""),
}
QUERIES = {k: (q, with_views(sql)) for k, (q, sql) in QUERIES.items()}
