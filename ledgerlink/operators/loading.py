"""Write operators as functions from tables to their next versions. Nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_documents(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The documents to add: content unseen for their (source, external_id), each once, the first by id."""
    keyed = incoming.withColumn("sha256", F.sha2(F.col("payload"), 256))
    key = ["source", "external_id", "sha256"]
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).filter("n = 1").drop("n")
    return first.join(stored.select(*key), key, "left_anti")


def insert_new(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """stored and those rows of incoming whose key is new; of equal keys within incoming the first by order."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_n = 1").drop("_n")
    return stored.unionByName(first.join(stored.select(*key), key, "left_anti"))


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """stored with incoming rows in place of those with their keys; the last by order wins."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col(order).desc())
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def fill_from(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """stored with columns taken from incoming where it has a value."""
    new = incoming.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = stored.join(new, stored[key] == new["_key"], "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])


def keep_last(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    last = Window.partitionBy(*key).orderBy(F.col(ordinal).desc())
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


EDGE_KEY = ["source_id", "target_id", "relationship_type", "valid_from"]


def bitemporal_upsert(stored: DataFrame, incoming: DataFrame, on: str) -> DataFrame:
    """stored with incoming facts: same key and end is no news; another end closes the old row and adds one.

    A null start is a key of its own. Of incoming rows of one key an open one
    counts, else the one that ends last. Returns all rows with action: kept,
    closed or added.
    """
    live, past = stored.filter("superseded_on is null"), stored.filter("superseded_on is not null")
    best = Window.partitionBy(*EDGE_KEY).orderBy(F.col("valid_to").desc_nulls_first(), *(["id"] if "id" in incoming.columns else []))
    new = incoming.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    match = [live[c].eqNullSafe(new[c]) for c in EDGE_KEY]
    joined = live.alias("o").join(new.select(*EDGE_KEY, F.col("valid_to").alias("new_to"), F.lit(True).alias("hit")).alias("n"), [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in EDGE_KEY], "left")
    changed = F.col("hit").isNotNull() & ~F.col("valid_to").eqNullSafe(F.col("new_to"))
    rows = [F.col(f"o.{c}") for c in stored.columns if c != "superseded_on"]
    old = joined.select(*rows, F.when(changed, F.lit(on).cast("date")).otherwise(F.col("superseded_on")).alias("superseded_on"), F.when(changed, "closed").otherwise("kept").alias("action"))
    same = [*match, new["valid_to"].eqNullSafe(live["valid_to"])]
    added = new.join(live, same, "left_anti").withColumn("recorded_on", F.lit(on).cast("date")).withColumn("superseded_on", F.lit(None).cast("date")).withColumn("action", F.lit("added"))
    return past.withColumn("action", F.lit("kept")).unionByName(old).unionByName(added.select(*stored.columns, "action"))


def close_missing(stored: DataFrame, roots: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    """Live open edges into roots (id) that are not in seen (id) get an end and are superseded."""
    gone = stored.filter("superseded_on is null and valid_to is null").join(roots.select(F.col("id").alias("target_id")), "target_id", "left_semi").join(seen.select("id"), "id", "left_anti")
    marked = stored.join(gone.select("id", F.lit(True).alias("gone")), "id", "left")
    day = F.lit(on).cast("date")
    ended = {c: F.when(F.col("gone"), day).otherwise(F.col(c)) for c in ("valid_to", "superseded_on")}
    return marked.select(*[ended[c].alias(c) if c in ended else F.col(c) for c in stored.columns])


def address_groups(addresses: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Groups of rows of one place: city, street, building, unit, n, regions, survivor, members.

    The survivor has the highest degree, then a postcode, then the smallest id.
    """
    rows = addresses.filter("city is not null and street <> '' and building is not null")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    order = F.struct((-F.col("degree")).alias("d"), F.col("postal_code").isNull().alias("p"), F.col("entity_id").alias("id"))
    groups = rows.groupBy(*[low(c).alias(c) for c in ("city", "street", "building", "unit")]).agg(F.count("*").alias("n"), F.count_distinct("voivodeship").alias("regions"), F.sort_array(F.collect_list(order)).alias("members"))
    groups = groups.filter("n > 1").withColumn("members", F.transform("members", lambda m: m["id"]))
    return groups.withColumn("survivor", F.element_at("members", 1))


def merge_map(groups: DataFrame) -> DataFrame:
    """merged_id, survivor_id for groups within one region."""
    pairs = groups.filter("regions <= 1").select(F.col("survivor").alias("survivor_id"), F.explode(F.slice("members", 2, F.size("members"))).alias("merged_id"))
    return pairs.select("merged_id", "survivor_id")


def move_edges(relationships: DataFrame, mapping: DataFrame, on: str) -> DataFrame:
    """relationships with live edges of merged entities moved to survivors: old ones closed, new ones added.

    An edge between two merged ones is only closed, and so is one whose new form
    is there already. action: kept, closed or added.
    """
    live = relationships.filter("superseded_on is null")
    to = lambda side: mapping.select(F.col("merged_id").alias(f"{side}_id"), F.col("survivor_id").alias(f"{side}_to"))
    both = relationships.join(to("source"), "source_id", "left").join(to("target"), "target_id", "left")
    hit = F.col("superseded_on").isNull() & (F.col("source_to").isNotNull() | F.col("target_to").isNotNull())
    day = F.lit(on).cast("date")
    old = both.select(*[F.when(hit, day).otherwise(F.col(c)).alias(c) if c == "superseded_on" else F.col(c) for c in relationships.columns], F.when(hit, "closed").otherwise("kept").alias("action"))
    moved = both.filter(hit & ~(F.col("source_to").isNotNull() & F.col("target_to").isNotNull()))
    made = {"source_id": F.coalesce("source_to", "source_id"), "target_id": F.coalesce("target_to", "target_id"), "id": F.concat(F.col("id"), F.lit("'")), "recorded_on": day}
    new = moved.select(*[made[c].alias(c) if c in made else F.col(c) for c in relationships.columns]).filter("source_id <> target_id")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*EDGE_KEY).orderBy("id"))).filter("_n = 1").drop("_n")
    fresh = new.join(live, [new[c].eqNullSafe(live[c]) for c in EDGE_KEY], "left_anti")
    return old.unionByName(fresh.withColumn("action", F.lit("added")))


def copied_provenance(provenance: DataFrame, moved: DataFrame) -> DataFrame:
    """provenance with that of edges added by move_edges, taken from the edges they replace."""
    new = moved.filter("action = 'added'").select(F.col("id").alias("new_id"), F.regexp_replace("id", "'$", "").alias("relationship_id"))
    copies = provenance.join(new, "relationship_id").select(F.col("new_id").alias("relationship_id"), *[c for c in provenance.columns if c != "relationship_id"])
    return provenance.unionByName(copies)


def merge_log(mapping: DataFrame, reason: str) -> DataFrame:
    return mapping.select("survivor_id", "merged_id", F.lit(1.0).cast("decimal(4,3)").alias("score"), F.lit(reason).alias("reason"), F.lit("auto").alias("decided_by"))


def geocoded(addresses: DataFrame, points: DataFrame) -> DataFrame:
    """addresses (entity_id, match_key, voivodeship) with the point of their key: in their region, or of an unambiguous key.

    points: id, match_key, voivodeship, lat, lon. Two equi-joins, not one with OR.
    """
    first = Window.partitionBy("match_key", "voivodeship").orderBy("id")
    one = points.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "id")
    single = one.groupBy("match_key").agg(F.count("*").alias("n")).filter("n = 1").select("match_key")
    known = addresses.filter("voivodeship is not null").join(one, ["match_key", "voivodeship"])
    sure = one.join(single, "match_key", "left_semi").drop("voivodeship")
    unknown = addresses.filter("voivodeship is null").join(sure, "match_key")
    columns = ["entity_id", "match_key", "lat", "lon"]
    return known.select(columns).unionByName(unknown.select(columns))
