"""Search and profile queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


from ledgerlink.operators import grid, profile, search
from ledgerlink.plans.graph import tables
from ledgerlink.sources.adapters import frame, view, with_views

#: Part names give the corpus words; ids follow the names so that they are stable.
CORPUS = """SELECT 'Q' || p_name AS id, 'company' AS entity_type, p_name AS display_name, lower(p_name) AS normalized_name, CAST(NULL AS STRING) AS merged_into_id, count(*) AS degree FROM part GROUP BY p_name"""
DETAILS = """SELECT 'Q' || p_name AS entity_id, CASE WHEN min(p_partkey) % 2 = 0 THEN '0000000001' END AS krs, CASE min(p_partkey) % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'deleted' END AS status,
  'mazowieckie' AS voivodeship, '62.01.Z' AS pkd_main, lpad(CAST(min(p_partkey) AS STRING), 10, '0') AS nip, CASE WHEN min(p_partkey) % 4 <> 0 THEN min(p_type) END AS city,
  CASE WHEN min(p_partkey) % 5 <> 0 THEN date_add(CAST('2001-01-01' AS DATE), CAST(min(p_size) AS INT)) END AS registered_on FROM part GROUP BY p_name"""


def corpus(spark, sf_dir):
    return frame(spark, sf_dir, CORPUS), frame(spark, sf_dir, DETAILS)


def relevance_sql(query: str) -> str:
    return f"""(0.40::DOUBLE * least({len(query)}::DOUBLE / greatest(length(normalized_name), 1), 1.0::DOUBLE) + 0.35::DOUBLE * (CASE WHEN krs IS NOT NULL THEN 1 ELSE 0 END)
      + 0.15::DOUBLE * (CASE WHEN status = 'active' THEN 1.0::DOUBLE WHEN status IS NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) + 0.10::DOUBLE * (least(degree, 20) / 20.0::DOUBLE))"""


CONDITIONS = {
    "exact": lambda q: f"normalized_name = '{q}'",
    "word_prefix": lambda q: f"starts_with(normalized_name, '{q} ')",
    "words": lambda q: " AND ".join(f"list_contains(string_split(normalized_name, ' '), '{w}')" for w in q.split(" ")),
    "prefix": lambda q: f"starts_with(normalized_name, '{q}')",
}


def stage_sql(stage: str, query: str, limit: int) -> str:
    base, span = search.BANDS[stage]
    return f"""SELECT id, entity_type, display_name, degree, round({base}::DOUBLE + {relevance_sql(query)} * {span}::DOUBLE, 6) AS score
      FROM (SELECT * FROM ({CORPUS}) c WHERE {CONDITIONS[stage](query)} ORDER BY degree DESC, id LIMIT 300) e LEFT JOIN ({DETAILS}) d ON d.entity_id = e.id
      ORDER BY score DESC, length(normalized_name), degree DESC, id LIMIT {limit}"""


def stage_query(stage: str, query: str, limit: int = 20):
    def run(spark, sf_dir):
        entities, companies = corpus(spark, sf_dir)
        return search.named(entities, companies, query, stage, limit)

    return run, stage_sql(stage, query, limit)


FUZZY_QUERY = "smal rng"
TRIGRAMS = "list_distinct(flatten(list_transform(string_split({x}, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIMILARITY = f"(len(list_intersect({TRIGRAMS.format(x='normalized_name')}, {TRIGRAMS.format(x=repr(FUZZY_QUERY))}))::DOUBLE / len(list_distinct(list_concat({TRIGRAMS.format(x='normalized_name')}, {TRIGRAMS.format(x=repr(FUZZY_QUERY))}))))"


def search_trigram(spark, sf_dir):
    entities, companies = corpus(spark, sf_dir)
    return search.fuzzy(entities, companies, FUZZY_QUERY, 20, 0.2)


def search_identifier(spark, sf_dir):
    _, entities = tables(spark, sf_dir)
    return search.identified(entities, view(spark, sf_dir, "identifiers"), "0000000010")


def search_staged(spark, sf_dir):
    entities, companies = corpus(spark, sf_dir)
    nobody = spark.createDataFrame([], "entity_id string, last_name string")
    return search.search(entities, companies, view(spark, sf_dir, "identifiers"), nobody, "small ring", "small ring", 10, 2).select("rank", "id", "score", "stage")


STAGED = " UNION ALL ".join(f"SELECT *, {i} AS stage FROM ({stage_sql(s, 'small ring', 13)}) s{i}" for i, s in enumerate(search.BANDS, 1))
STAGED = f"""WITH hits AS ({STAGED}), one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY stage, score DESC) = 1),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY stage, score DESC, length(display_name), degree DESC, id) AS INTEGER) AS rank FROM one)
SELECT rank, id, score, stage FROM ranked WHERE rank BETWEEN 3 AND 12"""


def pool_sql(query: str, order: str, first: int, last: int, number: str | None = None) -> str:
    """A page from the pool: stages while the ones before found under 200, an id in its first one, then sorted."""
    found = f"SELECT id, entity_type, display_name, degree, 1.0::DOUBLE AS score, length(display_name) AS size, 0 AS stage FROM ({CORPUS}) e JOIN (SELECT DISTINCT 'Q' || p_name AS hit FROM part WHERE lpad(CAST(p_partkey AS STRING), 10, '0') = '{number}') i ON i.hit = e.id"
    stages = [f"SELECT *, length(lower(display_name)) AS size, {i} AS stage FROM ({stage_sql(s, query, 200)}) s{i}" for i, s in enumerate(search.BANDS, 1)]
    return f"""WITH hits AS ({" UNION ALL ".join([found] * (number is not None) + stages)}),
one AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY score DESC, size, degree DESC, id) AS place FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY stage) = 1),
pool AS (SELECT * FROM one o WHERE (SELECT count(*) FROM one p WHERE p.stage < o.stage) < 200),
told AS (SELECT p.*, d.nip, d.krs, d.status, d.city, d.registered_on FROM pool p LEFT JOIN ({DETAILS}) d ON d.entity_id = p.id),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY {order}{", " if order else ""}stage, place) AS INTEGER) AS rank FROM told)
SELECT rank, id, score, stage, nip, krs, status, city, registered_on, (SELECT count(*) FROM ranked) > {last} AS has_more FROM ranked WHERE rank BETWEEN {first} AND {last}"""


def page_query(query: str, sort: str, order: str, limit: int = 10, offset: int = 5, raw: str | None = None):
    """A sorted page of enriched hits, and its SQL; raw: a query with an identifier in it."""

    def run(spark, sf_dir):
        entities, companies = corpus(spark, sf_dir)
        nobody = spark.createDataFrame([], "entity_id string, last_name string")
        numbers = frame(spark, sf_dir, "SELECT 'Q' || p_name AS entity_id, lpad(CAST(p_partkey AS STRING), 10, '0') AS value FROM part")
        found = search.search(entities, companies, numbers, nobody, raw or query, query, limit, offset, sort=sort)
        return found.select("rank", "id", "score", "stage", "nip", "krs", "status", "city", "registered_on", "has_more")

    return run, pool_sql(query, order, offset + 1, offset + limit, search.identifier_of(raw) if raw else None)


PAGES = {
    "search_page_name": page_query("s", "name", "lower(display_name)"),
    "search_page_degree": page_query("s", "degree", "degree DESC, lower(display_name)"),
    "search_page_registered": page_query("s", "registered", "registered_on DESC NULLS LAST"),
    "search_page_city": page_query("s", "city", "trim(coalesce(city, '')) = '', lower(city)"),
    "search_page_status": page_query("s", "status", "trim(coalesce(status, '')) = '', status"),
    "search_number_and_name": page_query("small ring", "relevance", "", 10, 0, "small ring 000-000-00-07"),
}


def search_surname(spark, sf_dir):
    entities = view(spark, sf_dir, "entities").join(view(spark, sf_dir, "degrees"), "id", "left")
    people = entities.filter("entity_type = 'person'").select(F.col("id").alias("entity_id"), F.upper(F.substring_index("display_name", " ", -1)).alias("last_name"))
    return search.by_surname(entities, people, "user 100")


def search_sorted(spark, sf_dir):
    entities, companies = corpus(spark, sf_dir)
    return search.resorted(search.named(entities, companies, "s", "prefix", 200), "name", 10, 5).select("id", "display_name", "degree", "score")


def co_located(spark, sf_dir):
    _, entities = tables(spark, sf_dir)
    return profile.co_located(view(spark, sf_dir, "relationships"), entities, view(spark, sf_dir, "companies"), "C1")


CO_LOCATED = """WITH adr AS (SELECT target_id FROM relationships WHERE source_id = 'C1' AND relationship_type = 'registered_at' AND superseded_on IS NULL ORDER BY (valid_to IS NULL) DESC, valid_from DESC NULLS LAST, id LIMIT 1)
SELECT e.id, e.entity_type, e.display_name, coalesce(d.degree, 0) AS degree, c.nip, c.krs, c.status, r.valid_from, r.valid_to
FROM adr JOIN relationships r ON r.target_id = adr.target_id AND r.relationship_type = 'registered_at' AND r.superseded_on IS NULL
JOIN entities e ON e.id = r.source_id AND e.merged_into_id IS NULL LEFT JOIN degrees d ON d.id = e.id LEFT JOIN companies c ON c.entity_id = e.id WHERE e.id <> 'C1'"""


def co_located_count(spark, sf_dir):
    _, entities = tables(spark, sf_dir)
    return profile.co_located(view(spark, sf_dir, "relationships"), entities, view(spark, sf_dir, "companies"), "N3", True).agg(F.count("*").alias("n"))


def current_addresses(spark, sf_dir):
    return profile.current_address(view(spark, sf_dir, "relationships"))


def entity_profile(spark, sf_dir):
    _, entities = tables(spark, sf_dir)
    return profile.profile(entities, view(spark, sf_dir, "companies"), view(spark, sf_dir, "identifiers"), "C10")


#: Details of people and places, by entity.
PEOPLE = "SELECT DISTINCT 'U' || CAST(user_id AS STRING) AS entity_id, 'User' AS first_names, CAST(user_id AS STRING) AS last_name FROM events"
PLACES = "SELECT 'N' || CAST(n_nationkey AS STRING) AS entity_id, n_name AS city, CAST(n_regionkey AS STRING) AS voivodeship FROM nation"


def entity_profiles(spark, sf_dir):
    """Companies, people and addresses alike, with the details of their kind."""
    _, entities = tables(spark, sf_dir)
    found = profile.profiles(entities, view(spark, sf_dir, "identifiers"), company=view(spark, sf_dir, "companies"), person=frame(spark, sf_dir, PEOPLE), address=frame(spark, sf_dir, PLACES))
    told = F.array_join(F.transform("identifiers", lambda i: F.concat_ws(":", i["scheme"], i["value"])), ",")
    return found.select("id", "entity_type", "display_name", "degree", "company.nip", "company.krs", "company.status", "person.first_names", "person.last_name", F.col("address.city").alias("city"), F.col("address.voivodeship").alias("region"), told.alias("identifiers"))


PROFILES = f"""WITH p AS ({PEOPLE}), a AS ({PLACES}), i AS (SELECT entity_id, string_agg(scheme || ':' || value, ',' ORDER BY scheme, value) AS identifiers FROM identifiers GROUP BY 1)
SELECT e.id, entity_type, display_name, coalesce(d.degree, 0) AS degree, c.nip, c.krs, c.status, p.first_names, p.last_name, a.city, a.voivodeship AS region, i.identifiers
FROM entities e LEFT JOIN degrees d ON d.id = e.id LEFT JOIN companies c ON c.entity_id = e.id LEFT JOIN p ON p.entity_id = e.id LEFT JOIN a ON a.entity_id = e.id LEFT JOIN i ON i.entity_id = e.id"""


def relationships_page(spark, sf_dir):
    edges, entities = tables(spark, sf_dir)
    return profile.relationships_page(edges, entities, view(spark, sf_dir, "provenance"), view(spark, sf_dir, "raw_documents"), "C1", "2001-06-30", limit=20, offset=5)


PAGE = """WITH p AS (SELECT g.*, n.entity_type AS other_type, n.display_name AS other_name FROM graph_edges g JOIN entities n ON n.id = g.to_id AND n.merged_into_id IS NULL
  WHERE from_id = 'C1' AND superseded_on IS NULL ORDER BY (valid_to IS NULL) DESC, valid_from DESC NULLS LAST, g.id LIMIT 20 OFFSET 5),
t AS (SELECT relationship_id, string_agg(source || '/' || external_id, ',' ORDER BY source || '/' || external_id) AS provenance FROM provenance v JOIN raw_documents d ON d.id = v.document_id GROUP BY 1)
SELECT p.id, direction, relationship_type, valid_from, valid_to, confidence, to_id AS other_id, other_type, other_name, provenance FROM p LEFT JOIN t ON t.relationship_id = p.id"""


def relationship_count(spark, sf_dir):
    edges, entities = tables(spark, sf_dir)
    live = edges.filter("superseded_on is null").join(entities.filter("merged_into_id is null").select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return live.groupBy("from_id").agg(F.count("*").alias("n"))


def changes_of(spark, sf_dir):
    from ledgerlink.operators.changes import attribute_changes

    log = view(spark, sf_dir, "attribute_log").select(F.concat(F.lit("C"), "user_id").alias("entity_id"), "field", "value", "ts", F.col("event_id").alias("ordinal"))
    found = attribute_changes(log)
    return found.select("entity_id", F.to_date("ts").alias("on"), "field", "old_value", "new_value")


def change_timeline(spark, sf_dir):
    return profile.timeline(changes_of(spark, sf_dir), view(spark, sf_dir, "relationships"), view(spark, sf_dir, "entities"), "C7")


TIMELINE = """WITH l AS (SELECT 'C' || CAST(user_id AS VARCHAR) AS entity_id, field, value, ts, event_id, lag(value) OVER w AS old, row_number() OVER w AS n FROM attribute_log WINDOW w AS (PARTITION BY user_id, field ORDER BY ts, event_id))
SELECT CAST(ts AS DATE) AS "on", field AS kind, old, value AS new, NULL::VARCHAR AS other FROM l WHERE entity_id = 'C7' AND n > 1 AND old IS DISTINCT FROM value
UNION ALL SELECT recorded_on, 'relationship_added', NULL, relationship_type, e.display_name FROM relationships r JOIN entities e ON e.id = CASE WHEN source_id = 'C7' THEN target_id ELSE source_id END WHERE source_id = 'C7' OR target_id = 'C7'
UNION ALL SELECT superseded_on, 'relationship_closed', relationship_type, NULL, e.display_name FROM relationships r JOIN entities e ON e.id = CASE WHEN source_id = 'C7' THEN target_id ELSE source_id END WHERE (source_id = 'C7' OR target_id = 'C7') AND superseded_on IS NOT NULL"""


def financials(spark, sf_dir):
    return view(spark, sf_dir, "financials").select("entity_id", "period", "revenue")


def dataset_fingerprint(spark, sf_dir):
    return profile.fingerprint(view(spark, sf_dir, "entities"), view(spark, sf_dir, "relationships"))


def source_inventory(spark, sf_dir):
    return profile.source_inventory(view(spark, sf_dir, "raw_documents"), view(spark, sf_dir, "provenance"), view(spark, sf_dir, "relationships"))


INVENTORY = """WITH s AS (SELECT source, count(*) AS documents, count(DISTINCT external_id) AS records, max(id) AS latest FROM raw_documents GROUP BY source),
x AS (SELECT source, count(DISTINCT v.relationship_id) AS edges FROM provenance v JOIN relationships r ON r.id = v.relationship_id AND r.superseded_on IS NULL JOIN raw_documents d ON d.id = v.document_id GROUP BY source)
SELECT s.*, coalesce(edges, 0) AS edges FROM s LEFT JOIN x USING (source)"""

BOX = (50000, 15000, 54000, 22000)


def map_base_cells(spark, sf_dir):
    return grid.base_cells(view(spark, sf_dir, "coordinates"))


CELLS = "SELECT CAST(floor(lat / 5) AS BIGINT) AS lat_idx, CAST(floor(lon / 5) AS BIGINT) AS lon_idx, count(*) AS addresses, CAST(sum(degree) AS BIGINT) AS entities, CAST(sum(lat) AS BIGINT) AS lat_sum, CAST(sum(lon) AS BIGINT) AS lon_sum FROM coordinates WHERE merged_into_id IS NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2"


def map_clusters(spark, sf_dir):
    return grid.clusters(map_base_cells(spark, sf_dir), 6, BOX)


def map_cluster_page(spark, sf_dir):
    return grid.cluster_page(map_base_cells(spark, sf_dir), 6, BOX, 5)


CLUSTERS = f"""WITH cells AS ({CELLS}) SELECT CAST(floor(lat_idx / 50) AS BIGINT) AS lat_idx, CAST(floor(lon_idx / 50) AS BIGINT) AS lon_idx, CAST(sum(addresses) AS BIGINT) AS addresses, CAST(sum(entities) AS BIGINT) AS entities,
  round(CAST(sum(lat_sum) AS DOUBLE) / CAST(sum(addresses) AS DOUBLE), 6) AS lat, round(CAST(sum(lon_sum) AS DOUBLE) / CAST(sum(addresses) AS DOUBLE), 6) AS lon
  FROM cells WHERE lat_idx BETWEEN {BOX[0] // 5} AND {BOX[2] // 5} AND lon_idx BETWEEN {BOX[1] // 5} AND {BOX[3] // 5} GROUP BY 1, 2 ORDER BY addresses DESC, lat_idx, lon_idx LIMIT 2000"""


def map_points(spark, sf_dir):
    points = view(spark, sf_dir, "coordinates")
    return grid.at_zoom(points, grid.base_cells(points), 15, (52000, 18000, 52400, 19000))


def map_fallback(spark, sf_dir):
    points = view(spark, sf_dir, "coordinates")
    return grid.at_zoom(points, grid.base_cells(points), 15, (52000, 18000, 54000, 22000), 3)


def map_at_point(spark, sf_dir):
    points = view(spark, sf_dir, "coordinates").filter("lat = 49000 + 7919 % 5500 and lon = 14000 + 104729 % 10000")
    e = view(spark, sf_dir, "entities")
    return points.join(e, points["entity_id"] == e["id"]).select("id", "display_name", "lat", "lon")


def map_coverage(spark, sf_dir):
    return grid.coverage(view(spark, sf_dir, "coordinates"))


QUERIES = {
    **PAGES,
    "entity_profiles": (entity_profiles, with_views(PROFILES)),
    "search_identifier": (search_identifier, with_views("SELECT e.id, entity_type, display_name, coalesce(d.degree, 0) AS degree, CAST(1.0 AS DOUBLE) AS score FROM (SELECT DISTINCT entity_id FROM identifiers WHERE value = '0000000010') i JOIN entities e ON e.id = i.entity_id AND e.merged_into_id IS NULL LEFT JOIN degrees d ON d.id = e.id")),
    "search_exact": stage_query("exact", "small ring"),
    "search_word_prefix": stage_query("word_prefix", "small"),
    "search_words": stage_query("words", "ring small"),
    "search_prefix": stage_query("prefix", "sma"),
    "search_surname": (search_surname, with_views("SELECT e.id, entity_type, display_name, d.degree, CAST(0.35 AS DOUBLE) AS score FROM entities e LEFT JOIN degrees d ON d.id = e.id WHERE entity_type = 'person' AND display_name = 'User 100' AND merged_into_id IS NULL")),
    "search_trigram": (search_trigram, f"SELECT id, entity_type, display_name, degree, round(0.30::DOUBLE + {SIMILARITY} * 0.09::DOUBLE, 6) AS score FROM ({CORPUS}) c WHERE {SIMILARITY} >= 0.2 ORDER BY score DESC, degree DESC, id LIMIT 20"),
    "search_staged": (search_staged, STAGED),
    "search_sorted": (search_sorted, f"SELECT id, display_name, degree, score FROM ({stage_sql('prefix', 's', 200)}) s ORDER BY display_name, id LIMIT 10 OFFSET 5"),
    "co_located": (co_located, with_views(CO_LOCATED)),
    "co_located_count": (co_located_count, with_views("SELECT count(*) AS n FROM relationships r JOIN entities e ON e.id = r.source_id AND e.merged_into_id IS NULL WHERE target_id = 'N3' AND relationship_type = 'registered_at' AND superseded_on IS NULL")),
    "current_addresses": (current_addresses, with_views("SELECT source_id AS entity_id, target_id AS address_id FROM relationships WHERE superseded_on IS NULL AND relationship_type = 'registered_at' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY (valid_to IS NULL) DESC, valid_from DESC NULLS LAST, id) = 1")),
    "entity_profile": (entity_profile, with_views("SELECT e.*, d.degree, c.* EXCLUDE (entity_id), 'krs:' || c.krs || ',nip:' || c.nip AS identifiers FROM entities e JOIN degrees d ON d.id = e.id JOIN companies c ON c.entity_id = e.id WHERE e.id = 'C10'").replace("e.*, d.degree", "e.id, e.entity_type, e.display_name, e.normalized_name, e.merged_into_id, d.degree")),
    "relationships_page": (relationships_page, with_views(PAGE)),
    "relationship_count": (relationship_count, with_views("SELECT from_id, count(*) AS n FROM graph_edges g JOIN entities e ON e.id = g.to_id AND e.merged_into_id IS NULL WHERE superseded_on IS NULL GROUP BY from_id")),
    "attribute_changes": (changes_of, with_views("""SELECT 'C' || CAST(user_id AS VARCHAR) AS entity_id, CAST(ts AS DATE) AS "on", field, old AS old_value, value AS new_value FROM (SELECT *, lag(value) OVER w AS old, row_number() OVER w AS n FROM attribute_log WINDOW w AS (PARTITION BY user_id, field ORDER BY ts, event_id)) l WHERE n > 1 AND old IS DISTINCT FROM value""")),
    "change_timeline": (change_timeline, with_views(TIMELINE)),
    "financials": (financials, with_views("SELECT entity_id, period, revenue FROM financials")),
    "dataset_fingerprint": (dataset_fingerprint, with_views("SELECT count(*) AS entities, count(*) FILTER (entity_type = 'company') AS companies, count(*) FILTER (entity_type = 'person') AS people, count(*) FILTER (entity_type = 'address') AS addresses, (SELECT count(*) FROM relationships WHERE superseded_on IS NULL) AS live_edges FROM entities WHERE merged_into_id IS NULL")),
    "source_inventory": (source_inventory, with_views(INVENTORY)),
    "map_base_cells": (map_base_cells, with_views(CELLS)),
    "map_clusters": (map_clusters, with_views(CLUSTERS)),
    "map_cluster_page": (map_cluster_page, with_views(CLUSTERS.replace("LIMIT 2000", "LIMIT 5").replace("SELECT CAST(floor(lat_idx / 50)", "SELECT *, count(*) OVER () >= 5 AS truncated FROM (SELECT CAST(floor(lat_idx / 50)", 1) + ") c")),
    "map_detail_points": (map_points, with_views("SELECT lat, lon, count(*) AS addresses, CAST(sum(degree) AS BIGINT) AS entities, min(label) AS label FROM coordinates WHERE merged_into_id IS NULL AND lat BETWEEN 52000 AND 52400 AND lon BETWEEN 18000 AND 19000 GROUP BY lat, lon")),
    "map_fallback": (map_fallback, with_views(f"WITH cells AS ({CELLS}) SELECT lat_idx, lon_idx, addresses, entities, round(lat_sum::DOUBLE / addresses, 6) AS lat, round(lon_sum::DOUBLE / addresses, 6) AS lon FROM cells WHERE lat_idx BETWEEN 10400 AND 10800 AND lon_idx BETWEEN 3600 AND 4400 ORDER BY addresses DESC, lat_idx, lon_idx LIMIT 3")),
    "map_at_point": (map_at_point, with_views("SELECT id, display_name, lat, lon FROM coordinates c JOIN entities e ON e.id = c.entity_id WHERE lat = 49000 + 7919 % 5500 AND lon = 14000 + 104729 % 10000")),
    "map_coverage": (map_coverage, with_views("SELECT count(*) AS all_points, count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS placed FROM coordinates")),
}
