"""What landed documents still say of entities that are stored already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions import text as T
from ledgerlink.functions.temporal import known

#: The trader's number in the external id of an entry.
ENTRY_ID = "^ceidg/firma/(.+)"


def has_key(payload: str | Column, key: str) -> Column:
    """Whether a JSON object has a key, a null value included."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def entries(documents: DataFrame) -> DataFrame:
    """Documents (external_id, payload) of traders' entries, with their number; others are left out."""
    number = F.nullif(F.regexp_extract("external_id", ENTRY_ID, 1), F.lit(""))
    return documents.withColumn("nip", number).filter("nip is not null")


def _field(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def coded_addresses(addresses: DataFrame, documents: DataFrame, identifiers: DataFrame, relationships: DataFrame) -> DataFrame:
    """addresses (entity_id, teryt, simc, ulic) with the official codes of the traders registered there.

    A municipality code that is there stays; the two others are the entry's.
    Where traders of one address disagree the smallest number counts.
    """
    empty = lambda p: F.nullif(_field(f"adresDzialalnosci.{p}"), F.lit(""))
    codes = entries(documents).filter(F.coalesce(*[_field(f"adresDzialalnosci.{p}") for p in ("terc", "simc", "ulic")]).isNotNull())
    codes = codes.select("nip", *[empty(p).alias(p) for p in ("terc", "simc", "ulic")])
    holders = identifiers.filter("scheme = 'nip'").select(F.col("value").alias("nip"), F.col("entity_id").alias("source_id"))
    at = relationships.filter(known() & (F.col("relationship_type") == "registered_at")).select("source_id", "target_id")
    said = codes.join(holders, "nip").join(at, "source_id").groupBy("target_id").agg(F.min_by(F.struct("terc", "simc", "ulic"), F.struct("nip", "terc", "simc", "ulic")).alias("s"))
    joined = addresses.join(said, F.col("entity_id") == F.col("target_id"), "left")
    new = F.col("s").isNotNull()
    return joined.select("entity_id", F.coalesce("teryt", "s.terc").alias("teryt"), F.when(new, F.col("s.simc")).otherwise(F.col("simc")).alias("simc"), F.when(new, F.col("s.ulic")).otherwise(F.col("ulic")).alias("ulic"))


def correspondence(documents: DataFrame, identifiers: DataFrame) -> DataFrame:
    """entity_id, address, differs: where a trader's post goes, and whether under another code than the business's.

    It is an attribute, not an edge: nobody is registered there.
    """
    part = lambda p: F.nullif(_field(f"adresKorespondencyjny.{p}"), F.lit(""))
    rows = entries(documents).filter(has_key("payload", "adresKorespondencyjny"))
    differs = ~_field("adresKorespondencyjny.kod").eqNullSafe(_field("adresDzialalnosci.kod"))
    rows = rows.select("nip", F.concat_ws(" ", part("ulica"), part("budynek"), part("kod"), part("miasto")).alias("address"), differs.alias("differs")).filter("address <> ''")
    holders = identifiers.filter("scheme = 'nip'").select(F.col("value").alias("nip"), "entity_id")
    return rows.join(holders, "nip").groupBy("entity_id").agg(F.min(F.struct("address", "differs")).alias("a")).select("entity_id", "a.*")


def lei_registrations(records: DataFrame, identifiers: DataFrame) -> DataFrame:
    """entity_id, lei_records: the registrations of all of an entity's numbers, in order of the number.

    records: lei, status and an ordinal of the page they are on; pages overlap,
    and the last one counts.
    """
    last = records.filter("lei is not null").groupBy("lei").agg(F.max_by("status", "ordinal").alias("status"))
    holders = identifiers.filter("scheme = 'lei'").select(F.col("value").alias("lei"), "entity_id")
    return last.join(holders, "lei").groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("lei", "status"))).alias("lei_records"))


def partner_names(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """partnership_id, names: what the partners' own businesses are called, for partnerships named by number only."""
    live = relationships.filter(known())
    partners = live.filter("relationship_type = 'partner_in'").select("source_id", F.col("target_id").alias("partnership_id"))
    business = live.filter("relationship_type = 'sole_proprietor_of'").select("source_id", F.col("target_id").alias("business_id"))
    unnamed = entities.filter(F.col("display_name").startswith("Spółka cywilna NIP")).select(F.col("id").alias("partnership_id"))
    named = partners.join(unnamed, "partnership_id").join(business, "source_id").join(entities.select(F.col("id").alias("business_id"), "display_name"), "business_id")
    return named.groupBy("partnership_id").agg(F.sort_array(F.collect_list("display_name")).alias("names"))


def accepted_points(wanted: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, counts) of geocoder answers: one in another region than the address's known one is of another place.

    wanted: id, voivodeship; found: id, teryt, lat, lon; an id without an answer
    is not found. counts: checked, not_found, rejected, accepted.
    """
    joined = wanted.select("id", "voivodeship").join(found.withColumn("hit", F.lit(True)), "id", "left")
    other = F.coalesce((F.col("voivodeship") != "") & (T.region_of(F.col("teryt")) != F.col("voivodeship")), F.lit(False))
    hit = F.coalesce("hit", F.lit(False))
    counts = joined.agg(F.count("*").alias("checked"), F.count_if(~hit).alias("not_found"), F.count_if(hit & other).alias("rejected"), F.count_if(hit & ~other).alias("accepted"))
    return joined.filter(hit & ~other).select("id", "teryt", "lat", "lon"), counts


def touching(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships of which either end is in ids (id): two lookups, no disjunctive join."""
    near = ids.select("id").distinct()
    one = relationships.join(near, relationships["source_id"] == near["id"], "left_semi")
    rest = relationships.join(near, relationships["source_id"] == near["id"], "left_anti")
    return one.unionByName(rest.join(near, rest["target_id"] == near["id"], "left_semi"))


def geocoder_query(city: Column, street: Column, building: Column) -> Column:
    """'City, Street 1'; the comma after the city is what the service goes by."""
    line = F.concat(F.trim(city), F.lit(", "), F.trim(F.coalesce(street, F.lit(""))), F.lit(" "), F.trim(building))
    return F.trim(F.replace(line, F.lit("  "), F.lit(" ")))


def candidate_key(kind: Column, *parts: Column) -> Column:
    """'kind:part|part' of folded parts; empty and null ones are left out."""
    return F.concat(kind, F.lit(":"), F.concat_ws("|", *[F.when(p != "", T.fold(p)) for p in parts]))


def person_name(first: Column, last: Column) -> Column:
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" ", empty(first), empty(last))


def content_digest(payload: Column) -> Column:
    """SHA-256 of a JSON object written canonically: keys in order, no spaces; other texts as they are."""
    flat = F.from_json(payload, "map<string,string>")
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(flat))))
    return F.sha2(F.coalesce(ordered, payload), 256)
