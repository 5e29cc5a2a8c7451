"""What is asked about one entity, or about the data as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.functions.temporal import known, still_valid



def current_address(relationships: DataFrame, entity: str | None = None) -> DataFrame:
    """entity_id, address_id: open registration first, then the latest start; ties by edge id."""
    live = relationships.filter(known() & (F.col("relationship_type") == "registered_at"))
    live = live if entity is None else live.filter(F.col("source_id") == entity)
    order = [F.col("valid_to").isNull().desc(), F.col("valid_from").desc_nulls_last(), F.col("id")]
    best = live.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy(*order))).filter("n = 1")
    return best.select(F.col("source_id").alias("entity_id"), F.col("target_id").alias("address_id"))


def co_located(relationships: DataFrame, entities: DataFrame, companies: DataFrame, entity: str, is_address: bool = False) -> DataFrame:
    """Who else is registered where the entity is, or at the address itself."""
    spark = relationships.sparkSession
    here = spark.createDataFrame([(entity,)], "address_id string") if is_address else current_address(relationships, entity).select("address_id")
    live = relationships.filter(known() & (F.col("relationship_type") == "registered_at") & (F.col("source_id") != entity))
    # One row at most.
    at = live.join(F.broadcast(here), live["target_id"] == here["address_id"])
    out = at.join(entities.filter("merged_into_id is null").withColumnRenamed("id", "eid"), F.col("source_id") == F.col("eid"))
    out = out.join(companies, F.col("eid") == companies["entity_id"], "left")
    return out.select(F.col("eid").alias("id"), "entity_type", "display_name", "degree", "nip", "krs", "status", "valid_from", "valid_to")


def profile(entities: DataFrame, companies: DataFrame, identifiers: DataFrame, entity: str) -> DataFrame:
    """One row: the entity, its company columns and its identifiers as 'scheme:value' in order."""
    mine = identifiers.filter(F.col("entity_id") == entity).groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "scheme", "value"))), ",").alias("identifiers"))
    one = entities.filter(F.col("id") == entity).join(companies, F.col("id") == companies["entity_id"], "left").drop("entity_id")
    return one.join(mine, F.col("id") == mine["entity_id"], "left").drop("entity_id")


def profiles(entities: DataFrame, identifiers: DataFrame, **details: DataFrame) -> DataFrame:
    """One row an entity: its columns, struct columns of its kind's details, and identifiers in order.

    details: a table each by entity_id, such as company, person and address; the
    struct is null where a table does not have the entity. identifiers is an
    array of (scheme, value), null without any.
    """
    out = entities
    for name, table in details.items():
        packed = table.select(F.col("entity_id").alias("_of"), F.struct(*[F.col(c) for c in table.columns if c != "entity_id"]).alias(name))
        out = out.join(packed, F.col("id") == F.col("_of"), "left").drop("_of")
    own = identifiers.groupBy(F.col("entity_id").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("scheme", "value"))).alias("identifiers"))
    return out.join(own, F.col("id") == F.col("_of"), "left").drop("_of")


def relationships_page(edges: DataFrame, entities: DataFrame, provenance: DataFrame, documents: DataFrame, entity: str, today: str, historical: bool = True, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of an entity's relationships with their sources, open ones first, then by start."""
    mine = edges.filter((F.col("from_id") == entity) & known() & still_valid(today, historical))
    mine = mine.join(entities.filter("merged_into_id is null").select(F.col("id").alias("to_id"), F.col("entity_type").alias("other_type"), F.col("display_name").alias("other_name")), "to_id")
    order = [F.col("valid_to").isNull().desc(), F.col("valid_from").desc_nulls_last(), F.col("id")]
    page = mine.orderBy(*order).offset(offset).limit(limit)
    # A page has `limit` rows at most.
    wanted = provenance.join(F.broadcast(page.select(F.col("id").alias("relationship_id"))), "relationship_id", "left_semi")
    sources = wanted.join(documents.select(F.col("id").alias("document_id"), "source", "external_id"), "document_id")
    told = sources.groupBy("relationship_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("/", "source", "external_id"))), ",").alias("provenance"))
    return page.join(told, page["id"] == told["relationship_id"], "left").select("id", "direction", "relationship_type", "valid_from", "valid_to", "confidence", F.col("to_id").alias("other_id"), "other_type", "other_name", "provenance")


def timeline(changes: DataFrame, relationships: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Attribute changes, and edges that came and went, as one axis: on, kind, old, new, other."""
    mine = relationships.filter((F.col("source_id") == entity) | (F.col("target_id") == entity))
    other = F.when(F.col("source_id") == entity, F.col("target_id")).otherwise(F.col("source_id"))
    named = mine.withColumn("other_id", other).join(entities.select(F.col("id").alias("other_id"), F.col("display_name").alias("other")), "other_id")
    none = F.lit(None).cast("string")
    came = named.select(F.col("recorded_on").alias("on"), F.lit("relationship_added").alias("kind"), none.alias("old"), F.col("relationship_type").alias("new"), "other")
    went = named.filter(~known()).select(F.col("superseded_on").alias("on"), F.lit("relationship_closed").alias("kind"), F.col("relationship_type").alias("old"), none.alias("new"), "other")
    own = changes.filter(F.col("entity_id") == entity).select("on", F.col("field").alias("kind"), F.col("old_value").alias("old"), F.col("new_value").alias("new"), none.alias("other"))
    return own.unionByName(came).unionByName(went)


def fingerprint(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row of counts that tells data sets apart."""
    kinds = entities.filter("merged_into_id is null").agg(F.count("*").alias("entities"), *[F.count_if(F.col("entity_type") == k).alias(v) for k, v in (("company", "companies"), ("person", "people"), ("address", "addresses"))])
    return kinds.crossJoin(F.broadcast(relationships.agg(F.count_if(known()).alias("live_edges"))))


def source_inventory(documents: DataFrame, provenance: DataFrame, relationships: DataFrame) -> DataFrame:
    """Per source: documents, distinct records, edges it vouches for (an edge counts once a source)."""
    by_source = documents.groupBy("source").agg(F.count("*").alias("documents"), F.count_distinct("external_id").alias("records"), F.max("id").alias("latest"))
    live = relationships.filter(known()).select(F.col("id").alias("relationship_id"))
    edges = provenance.join(live, "relationship_id", "left_semi").join(documents.select(F.col("id").alias("document_id"), "source"), "document_id")
    edges = edges.select("source", "relationship_id").distinct().groupBy("source").agg(F.count("*").alias("edges"))
    return by_source.join(edges, "source", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
