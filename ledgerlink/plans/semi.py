"""Attribute, rank and paging queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlink.functions import semi
from ledgerlink.functions import text as T
from ledgerlink.sources.adapters import frame, view, with_views

ATTRIBUTES = "SELECT p_partkey AS k, p_name, p_type, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS size FROM part"


def attribute_merge(spark, sf_dir):
    p = frame(spark, sf_dir, ATTRIBUTES)
    old = F.create_map(F.lit("name"), "p_name", F.lit("type"), "p_type")
    new = F.map_filter(F.create_map(F.lit("type"), "brand", F.lit("size"), "size"), lambda _, v: v.isNotNull())
    m = p.select("k", semi.merged(old, new).alias("m"))
    return m.select("k", *[F.try_element_at("m", F.lit(c)).alias(c) for c in ("name", "type", "size")])


def attribute_allow_list(spark, sf_dir):
    p = frame(spark, sf_dir, ATTRIBUTES)
    m = p.select("k", semi.allowed(F.create_map(F.lit("name"), "p_name", F.lit("type"), "p_type", F.lit("brand"), "brand", F.lit("size"), "size"), ["name", "brand", "size"], 6).alias("m"))
    return m.select("k", F.size("m").cast("long").alias("n"), *[F.try_element_at("m", F.lit(c)).alias(c) for c in ("name", "name_truncated", "type", "brand", "size")])


def price_percentiles(spark, sf_dir):
    o = frame(spark, sf_dir, "SELECT o_orderpriority AS priority, o_totalprice AS price FROM orders")
    return semi.nearest_rank(o, "priority", "price", [50, 95, 99])


def keyset_page(spark, sf_dir):
    return semi.after(frame(spark, sf_dir, "SELECT c_custkey, c_name FROM customer"), "c_custkey", 40, 25)


def parallel_arrays(spark, sf_dir):
    e = view(spark, sf_dir, "entities").filter("entity_type = 'address'").groupBy("entity_type").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return semi.in_parallel(e.withColumn("places", F.sequence(F.lit(1), F.size("ids"))), "ids", "places")


def open_values(spark, sf_dir):
    h = frame(spark, sf_dir, "SELECT user_id, event_type AS value, CASE WHEN event_id % 7 <> 0 THEN 'x' END AS valid_to, event_id FROM events")
    g = h.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value", "valid_to"))).alias("h"))
    return g.select("user_id", T.open_or_last(F.col("h")).alias("value"))


def contains_name(spark, sf_dir):
    e = view(spark, sf_dir, "companies").filter(F.col("pkd_main").ilike("62.01.z") & F.replace("pkd_main", F.lit("."), F.lit("")).startswith("6201"))
    return e.select("entity_id", F.concat_ws(" · ", "status", "voivodeship", "krs").alias("subtitle"))


QUERIES = {
    "attribute_merge": (attribute_merge, f"SELECT k, p_name AS name, coalesce(brand, p_type) AS type, size FROM ({ATTRIBUTES}) a"),
    "attribute_allow_list": (attribute_allow_list, f"SELECT k, CAST(1 + (length(p_name) > 6)::INT + (brand IS NOT NULL)::INT + coalesce(length(brand) > 6, false)::INT + (size <> '')::INT AS BIGINT) AS n, substr(p_name, 1, 6) AS name, CASE WHEN length(p_name) > 6 THEN 'true' END AS name_truncated, NULL::VARCHAR AS type, substr(brand, 1, 6) AS brand, nullif(size, '') AS size FROM ({ATTRIBUTES}) a"),
    "price_percentiles": (price_percentiles, "SELECT priority, " + ", ".join(f"max(price) FILTER (r = greatest(ceil(n * {p} / 100.0), 1)) AS p{p}" for p in (50, 95, 99)) + " FROM (SELECT o_orderpriority AS priority, o_totalprice AS price, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) x GROUP BY priority"),
    "keyset_page": (keyset_page, "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 25"),
    "parallel_arrays": (parallel_arrays, "SELECT entity_type, id AS ids, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS places FROM entities WHERE entity_type = 'address'"),
    "open_values": (open_values, "SELECT user_id, coalesce((array_agg(event_type ORDER BY event_id) FILTER (event_id % 7 = 0))[1], (array_agg(event_type ORDER BY event_id DESC))[1]) AS value FROM events GROUP BY user_id"),
    "subtitles": (contains_name, "SELECT entity_id, concat_ws(' · ', status, voivodeship, krs) AS subtitle FROM companies WHERE pkd_main ILIKE '62.01.z' AND starts_with(replace(pkd_main, '.', ''), '6201')"),
}
QUERIES = {k: (f, with_views(sql)) for k, (f, sql) in QUERIES.items()}
