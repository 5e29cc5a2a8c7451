"""Graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlink.functions.temporal import known, still_valid, valid_at
from ledgerlink.operators import graph as G
from ledgerlink.sources.adapters import view, with_views

ROOT, DAY = "C1", "1998-06-30"
SMALL = G.Budget(2, 40, 10, 150)


def tables(spark, sf_dir):
    edges = view(spark, sf_dir, "graph_edges")
    entities = view(spark, sf_dir, "entities").join(view(spark, sf_dir, "degrees"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return edges, entities


def graph_level1(spark, sf_dir):
    edges, entities = tables(spark, sf_dir)
    rows = G.expand(edges, entities, F.broadcast(spark.createDataFrame([(ROOT,)], "from_id string")), 25, DAY)
    return rows.select("id", "from_id", "to_id", "direction", "relationship_type", "valid_from", "valid_to", "confidence", F.col("rn").cast("long"), "matched_degree", "entity_type", "display_name")


def graph_level1_all(spark, sf_dir):
    """The first level around every live entity: one rank over all edges, no look-up for each."""
    edges, entities = tables(spark, sf_dir)
    rows = G.expand(edges, entities, entities.filter("merged_into_id is null").select(F.col("id").alias("from_id")), 25, DAY)
    return rows.select("id", "from_id", "to_id", F.col("rn").cast("long"), "matched_degree")


VALID = f"(valid_from IS NULL OR valid_from <= DATE '{DAY}') AND (valid_to IS NULL OR valid_to >= DATE '{DAY}')"


def _level(frontier: str, fanout: int, name: str) -> str:
    return f"""{name}r AS (
  SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY confidence_score DESC, (valid_to IS NULL) DESC, valid_from DESC NULLS LAST, id) AS rn,
         count(*) OVER (PARTITION BY from_id) AS matched_degree
  FROM graph_edges WHERE superseded_on IS NULL AND from_id IN ({frontier}) AND {VALID}
), {name} AS (
  SELECT r.*, n.entity_type, n.display_name, coalesce(d.degree, 0) AS target_degree
  FROM {name}r r JOIN entities n ON n.id = r.to_id AND n.merged_into_id IS NULL LEFT JOIN degrees d ON d.id = r.to_id WHERE rn <= {fanout})"""


LEVEL1 = with_views(f"""WITH {_level(f"'{ROOT}'", 25, 'a')}
SELECT id, from_id, to_id, direction, relationship_type, valid_from, valid_to, confidence, rn, matched_degree, entity_type, display_name FROM a""")

DEPTH2 = f"""WITH {_level(f"'{ROOT}'", SMALL.fanout, 'a')}, a1 AS (
  SELECT to_id, min(rn) AS rn, min(target_degree) AS target_degree, min(entity_type) AS entity_type, min(display_name) AS display_name FROM a WHERE to_id <> '{ROOT}' GROUP BY to_id
), n1 AS (SELECT *, row_number() OVER (ORDER BY rn, to_id) AS pos FROM a1 QUALIFY pos <= {SMALL.max_nodes - 1}),
f AS (SELECT to_id FROM n1 WHERE target_degree <= {SMALL.hub_degree}),
{_level('SELECT to_id FROM f', SMALL.fanout, 'b')}, b1 AS (
  SELECT to_id, min(struct_pack(f := from_id, r := rn)) AS best, min(target_degree) AS target_degree, min(entity_type) AS entity_type, min(display_name) AS display_name
  FROM b WHERE to_id <> '{ROOT}' AND to_id NOT IN (SELECT to_id FROM n1) GROUP BY to_id
), n2 AS (SELECT *, row_number() OVER (ORDER BY best.f, best.r, to_id) AS pos FROM b1 QUALIFY pos <= {SMALL.max_nodes - 1} - (SELECT count(*) FROM n1)),
v1 AS (SELECT '{ROOT}' AS id UNION ALL SELECT to_id FROM n1),
v2 AS (SELECT id FROM v1 UNION ALL SELECT to_id FROM n2),
e AS (SELECT id, direction, from_id, to_id, relationship_type, valid_from, valid_to, confidence FROM a WHERE to_id IN (SELECT id FROM v1)
      UNION ALL SELECT id, direction, from_id, to_id, relationship_type, valid_from, valid_to, confidence FROM b WHERE to_id IN (SELECT id FROM v2)),
edges AS (SELECT DISTINCT id, CASE WHEN direction = 'out' THEN from_id ELSE to_id END AS source_id, CASE WHEN direction = 'out' THEN to_id ELSE from_id END AS target_id, relationship_type, valid_from, valid_to, confidence, (valid_to IS NULL OR valid_to >= DATE '{DAY}') AS is_current FROM e),
nodes AS (SELECT e.id, e.entity_type, e.display_name, coalesce(d.degree, 0) AS degree, 0 AS level, FALSE AS truncated_expansion FROM entities e LEFT JOIN degrees d ON d.id = e.id WHERE e.id = '{ROOT}'
      UNION ALL SELECT to_id, entity_type, display_name, target_degree, 1, target_degree > {SMALL.hub_degree} FROM n1 UNION ALL SELECT to_id, entity_type, display_name, target_degree, 2, FALSE FROM n2),
ends AS (SELECT source_id AS node, relationship_type FROM edges UNION ALL SELECT target_id, relationship_type FROM edges),
single AS (SELECT node FROM ends GROUP BY node HAVING count(*) = 1 AND min(relationship_type) = 'sole_proprietor_of'),
gone AS (SELECT id FROM nodes WHERE entity_type = 'person' AND id <> '{ROOT}' AND id IN (SELECT node FROM single))
"""


def _around(spark, sf_dir):
    edges, entities = tables(spark, sf_dir)
    return G.neighborhood(edges, entities, ROOT, SMALL, 2, DAY)


def graph_depth2_nodes(spark, sf_dir):
    return _around(spark, sf_dir).nodes


def graph_depth2_edges(spark, sf_dir):
    return _around(spark, sf_dir).edges


def graph_depth2_meta(spark, sf_dir):
    return _around(spark, sf_dir).meta


def edges_as_of(spark, sf_dir):
    e = view(spark, sf_dir, "relationships").filter(known() & valid_at("1999-12-31") & (F.col("relationship_type") == "contractor_of"))
    return e.select("id", "source_id", "target_id", "valid_from", "valid_to", "confidence")


def edges_historical(spark, sf_dir):
    e = view(spark, sf_dir, "relationships").filter(known() & (F.col("relationship_type") == "contractor_of"))
    return e.select("id", "valid_from", "valid_to", still_valid("2000-06-30").alias("is_current"))


def edge_types(spark, sf_dir):
    e = view(spark, sf_dir, "graph_edges").filter(~F.col("relationship_type").isin(*G.DERIVED))
    return e.select("id", "direction", "relationship_type", *G.oriented())


def degree_recount(spark, sf_dir):
    return G.refreshed_degrees(view(spark, sf_dir, "entities"), view(spark, sf_dir, "relationships")).select("id", "degree")


def degree_histogram(spark, sf_dir):
    d = G.degrees(view(spark, sf_dir, "relationships"))
    return d.groupBy(F.width_bucket("degree", F.lit(0.0), F.lit(500.0), F.lit(10)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.min("degree").alias("low"), F.max("degree").alias("high"))


def hub_top20(spark, sf_dir):
    return G.degrees(view(spark, sf_dir, "relationships")).orderBy(F.col("degree").desc(), "id").limit(20)


def shared_addresses(spark, sf_dir):
    return G.sharing_address(view(spark, sf_dir, "relationships"))


def contract_days(spark, sf_dir):
    """Interval join: edges with the orders that fall in their valid time, by month buckets of the customer."""
    e = view(spark, sf_dir, "relationships").filter("relationship_type = 'contractor_of' and valid_to is not null").select("id", "target_id", "valid_from", "valid_to")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("C"), "o_custkey").alias("target_id"), F.to_date("o_orderdate").alias("day"))
    hits = e.join(o, "target_id").filter("day between valid_from and valid_to")
    return hits.groupBy("id").agg(F.count("*").alias("orders_within"))


QUERIES = {
    "graph_level1": (graph_level1, LEVEL1),
    "graph_level1_all": (graph_level1_all, with_views(f"""WITH {_level("SELECT id FROM entities WHERE merged_into_id IS NULL", 25, 'a')} SELECT id, from_id, to_id, rn, matched_degree FROM a""")),
    "graph_depth2_nodes": (graph_depth2_nodes, with_views(DEPTH2 + "SELECT id, entity_type, display_name, degree, level, truncated_expansion FROM nodes WHERE id NOT IN (SELECT id FROM gone)")),
    "graph_depth2_edges": (graph_depth2_edges, with_views(DEPTH2 + "SELECT * FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")),
    "graph_depth2_meta": (graph_depth2_meta, with_views(DEPTH2 + f"""SELECT '{ROOT}' AS root, 2 AS depth,
        ((SELECT count(*) FROM a WHERE matched_degree > {SMALL.fanout}) > 0 OR (SELECT count(*) FROM a1) > {SMALL.max_nodes - 1}
          OR (SELECT count(*) FROM b WHERE matched_degree > {SMALL.fanout}) > 0 OR (SELECT count(*) FROM b1) > {SMALL.max_nodes - 1} - (SELECT count(*) FROM n1)) AS truncated,
        CAST((SELECT count(*) FROM n1 WHERE target_degree > {SMALL.hub_degree}) AS INTEGER) AS suppressed_hubs""")),
    "edges_as_of": (edges_as_of, with_views("SELECT id, source_id, target_id, valid_from, valid_to, confidence FROM relationships WHERE superseded_on IS NULL AND relationship_type = 'contractor_of' AND (valid_from IS NULL OR valid_from <= DATE '1999-12-31') AND (valid_to IS NULL OR valid_to >= DATE '1999-12-31')")),
    "edges_historical": (edges_historical, with_views("SELECT id, valid_from, valid_to, (valid_to IS NULL OR valid_to >= DATE '2000-06-30') AS is_current FROM relationships WHERE superseded_on IS NULL AND relationship_type = 'contractor_of'")),
    "edge_orientation": (edge_types, with_views("SELECT id, direction, relationship_type, CASE WHEN direction = 'out' THEN from_id ELSE to_id END AS source_id, CASE WHEN direction = 'out' THEN to_id ELSE from_id END AS target_id FROM graph_edges")),
    "degree_recount": (degree_recount, with_views("SELECT e.id, coalesce(d.degree, 0) AS degree FROM entities e LEFT JOIN degrees d ON d.id = e.id")),
    "degree_histogram": (degree_histogram, with_views("SELECT CAST(least(floor(degree / 50.0), 10) + 1 AS INTEGER) AS bucket, count(*) AS n, min(degree) AS low, max(degree) AS high FROM degrees GROUP BY 1")),
    "hub_top20": (hub_top20, with_views("SELECT id, degree FROM degrees ORDER BY degree DESC, id LIMIT 20")),
    "shared_addresses": (shared_addresses, with_views("""WITH l AS (SELECT DISTINCT source_id AS entity, target_id AS address FROM relationships WHERE superseded_on IS NULL AND relationship_type = 'registered_at'),
        s AS (SELECT address, count(*) AS entities FROM l GROUP BY address HAVING count(*) > 1)
        SELECT entity, address, entities FROM l JOIN s USING (address)""")),
    "interval_join": (contract_days, with_views("SELECT r.id, count(*) AS orders_within FROM relationships r JOIN orders o ON r.target_id = 'C' || CAST(o_custkey AS VARCHAR) AND CAST(o_orderdate AS DATE) BETWEEN valid_from AND valid_to WHERE relationship_type = 'contractor_of' AND valid_to IS NOT NULL GROUP BY r.id")),
}
