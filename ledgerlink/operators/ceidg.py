"""Bulk load of the register of sole traders (CEIDG): landed rows to companies, owners, addresses and edges.

A row is anchored by its tax number alone; names never join anything. A load is
a function of the landed rows and of what is known already, so a second load of
the same rows adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions import text as T

# Columns of a landed row, and what they are called here.
COLUMNS = {
    "phone": "Telefon", "email": "Email", "www": "AdresWWW", "postal_code": "KodPocztowy", "county": "Powiat", "commune": "Gmina", "city": "Miejscowosc", "street": "Ulica", "building": "NrBudynku", "unit": "NrLokalu",
    "pkd_main": "GlownyKodPkd", "pkd_other": "PozostaleKodyPkd", "status_raw": "StatusDzialalnosci", "started_on": "DataRozpoczeciaDzialalnosci", "ended_on": "DataZakonczeniaDzialalnosci",
    "suspended_on": "DataZawieszeniaDzialalnosci", "resumed_on": "DataWznowieniaDzialalnosci", "last_name": "Nazwisko", "first_name": "Imie",
}
OWNER = "ceidg-owner:"


def prepare(rows: DataFrame, region: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a valid tax number, trimmed, with names, keys and the address as it is written.

    rows: any of the landed columns, as strings; absent ones are empty, and those
    in keep stay as they are. A row without a company name is named by its
    owner, else by its number.
    """
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) if c in rows.columns else F.lit("")
    name, full = text("NazwaPodmiotu"), F.concat_ws(" ", F.nullif(text("Imie"), F.lit("")), F.nullif(text("Nazwisko"), F.lit("")))
    nip = T.digits(text("Nip"))
    company = F.when(name.isin("", "-"), F.coalesce(F.nullif(full, F.lit("")), F.concat(F.lit("JDG "), nip))).otherwise(name)
    out = rows.filter(T.is_nip(nip)).select(*keep, nip.alias("nip"), T.digits(text("Regon")).alias("regon"), company.alias("name"), full.alias("owner"), *[text(c).alias(k) for k, c in COLUMNS.items()], F.lit(region).alias("voivodeship"))
    address = T.address_line(F.col("street"), F.col("building"), F.col("unit"), F.col("postal_code"), F.col("city"))
    out = out.withColumn("status", F.coalesce(T.status_code(F.col("status_raw")), F.lit(""))).withColumn("address", address)
    return out.withColumn("normalized_name", T.company_name(F.col("name"))).withColumn("address_key", T.natural_key(F.col("address")))


def staged(prepared: DataFrame, order: str, identifiers: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row a tax number, the last by `order`, with company_id, owner_id and address_id: known ones, else new.

    identifiers: entity_id, scheme, value; addresses: entity_id, normalized. New
    ids follow from the number and the address, so that every run gives the same.
    """
    last = prepared.groupBy("nip").agg(F.max_by(F.struct(*[c for c in prepared.columns if c not in ("nip", order)]), order).alias("r")).select("nip", "r.*")
    known = identifiers.filter("scheme = 'nip'").groupBy(F.col("value").alias("nip")).agg(F.min("entity_id").alias("company_known"))
    owners = identifiers.filter((F.col("scheme") == "internal") & F.col("value").startswith(OWNER)).groupBy(F.substring("value", len(OWNER) + 1, 20).alias("nip")).agg(F.min("entity_id").alias("owner_known"))
    places = addresses.groupBy(F.col("normalized").alias("address_key")).agg(F.min("entity_id").alias("address_known"))
    rows = last.join(known, "nip", "left").join(owners, "nip", "left").join(places, "address_key", "left")
    new = lambda prefix, key: F.concat(F.lit(prefix), key)
    rows = rows.withColumn("company_id", F.coalesce("company_known", new("ceidg:", "nip"))).withColumn("owner_id", F.when(F.col("last_name") != "", F.coalesce("owner_known", new(OWNER, "nip"))))
    return rows.withColumn("address_id", F.when(F.col("address_key") != "", F.coalesce("address_known", new("address:", F.substring(F.sha2(F.col("address_key"), 256), 1, 32)))))


def new_entities(rows: DataFrame) -> DataFrame:
    """id, entity_type, display_name, normalized_name, blocking_key of what is not known yet."""
    block = lambda c: F.substring(F.replace(F.col(c), F.lit(" "), F.lit("")), 1, 12)
    companies = rows.filter("company_known is null").select(F.col("company_id").alias("id"), F.lit("company").alias("entity_type"), F.col("name").alias("display_name"), "normalized_name", block("normalized_name").alias("blocking_key"))
    owner = F.trim(F.concat_ws(" ", "first_name", "last_name"))
    people = rows.filter("owner_id is not null and owner_known is null").select(F.col("owner_id").alias("id"), F.lit("person").alias("entity_type"), owner.alias("display_name"), T.fold(F.col("owner")).alias("normalized_name"), F.concat(F.lower("first_name"), F.lit("|"), F.lower("last_name")).alias("blocking_key"))
    # Traders of one address share it; its writing is the first of theirs.
    fresh = rows.filter("address_id is not null and address_known is null").groupBy(F.col("address_id").alias("id")).agg(F.min("address").alias("display_name"))
    addresses = fresh.select("id", F.lit("address").alias("entity_type"), "display_name", T.fold(F.col("display_name")).alias("normalized_name"), F.lit(None).cast("string").alias("blocking_key"))
    return companies.unionByName(people).unionByName(addresses)


def new_identifiers(rows: DataFrame) -> DataFrame:
    """entity_id, scheme, value that are not known yet: tax numbers, and owners by their trader's."""
    companies = rows.filter("company_known is null").select(F.col("company_id").alias("entity_id"), F.lit("nip").alias("scheme"), F.col("nip").alias("value"))
    owners = rows.filter("owner_id is not null and owner_known is null").select(F.col("owner_id").alias("entity_id"), F.lit("internal").alias("scheme"), F.concat(F.lit(OWNER), "nip").alias("value"))
    return companies.unionByName(owners)


def company_rows(rows: DataFrame) -> DataFrame:
    """The company columns of each trader; empty texts are null, dates that are none as well."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(F.col("company_id").alias("entity_id"), "nip", text("regon").alias("regon"), text("status").alias("status"), T.iso_date(F.col("started_on")).alias("registered_on"), T.iso_date(F.col("ended_on")).alias("deregistered_on"), *[text(c).alias(c) for c in ("pkd_main", "pkd_other", "city", "county", "commune", "voivodeship", "status_raw", "phone", "email", "www", "suspended_on", "resumed_on")])


def edges(rows: DataFrame) -> DataFrame:
    """source_id, target_id, relationship_type, role, valid_from, valid_to, locator: owners of companies, companies at addresses.

    The locator is the row of the report that says so: no edge is without.
    """
    begin, end = T.iso_date(F.col("started_on")), T.iso_date(F.col("ended_on"))
    locator = F.concat(F.lit("nip:"), "nip")
    owned = rows.filter("owner_id <> company_id").select(F.col("owner_id").alias("source_id"), F.col("company_id").alias("target_id"), F.lit("sole_proprietor_of").alias("relationship_type"), F.lit("WŁAŚCICIEL").alias("role"), begin.alias("valid_from"), end.alias("valid_to"), locator.alias("locator"))
    seated = rows.filter("address_id <> company_id").select(F.col("company_id").alias("source_id"), F.col("address_id").alias("target_id"), F.lit("registered_at").alias("relationship_type"), F.lit(None).cast("string").alias("role"), begin.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), locator.alias("locator"))
    return owned.unionByName(seated)


def backfilled_addresses(addresses: DataFrame, rows: DataFrame) -> DataFrame:
    """addresses (entity_id, normalized, building, unit, voivodeship) completed by the load's rows.

    Where rows disagree the trader of the smallest number counts. A region that
    the report gives replaces another; a building is filled only where there is
    none, and the unit with it.
    """
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    said = rows.filter("address_key <> ''").groupBy(F.col("address_key").alias("key")).agg(F.min(F.struct("nip", text("building").alias("building"), text("unit").alias("unit"), text("voivodeship").alias("voivodeship"))).alias("s"))
    joined = addresses.join(said, F.col("normalized") == F.col("key"), "left")
    fill = F.col("building").isNull() & F.col("s.building").isNotNull()
    return joined.select("entity_id", "normalized", F.coalesce("building", "s.building").alias("building"), F.when(fill, F.col("s.unit")).otherwise(F.col("unit")).alias("unit"), F.coalesce("s.voivodeship", "voivodeship").alias("voivodeship"))


def missing_provenance(rows: DataFrame, relationships: DataFrame, provenance: DataFrame) -> DataFrame:
    """relationship_id, locator for edges of the load that are stored without any source."""
    said = edges(rows).select("source_id", "target_id", "relationship_type", "locator")
    bare = relationships.join(provenance, relationships["id"] == provenance["relationship_id"], "left_anti")
    return bare.join(said, ["source_id", "target_id", "relationship_type"]).groupBy(F.col("id").alias("relationship_id")).agg(F.min("locator").alias("locator"))


#: What a trader's landed entry says of civil partnerships.
ENTRY = "spolki array<struct<nip string, regon string>>"


def partnerships(entries: DataFrame, traders: DataFrame, identifiers: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, edges): partnerships that entries name by tax number, and edges from their partners.

    entries: nip, payload (JSON) of traders; traders: nip, owner_id, status_raw,
    of whom those in a civil partnership are looked at. Partnerships with a known
    number are linked to, others made: entity_id, display_name, regon. Edges that
    are current already are not made again.
    """
    said = entries.select("nip", F.explode(F.from_json("payload", ENTRY)["spolki"]).alias("s"))
    said = said.select("nip", F.trim(F.coalesce("s.nip", F.lit(""))).alias("number"), F.trim(F.coalesce("s.regon", F.lit(""))).alias("regon")).filter("number <> ''")
    owners = traders.filter(F.lower("status_raw").contains("cywiln") & F.col("owner_id").isNotNull()).select("nip", "owner_id")
    known = identifiers.filter("scheme = 'nip'").groupBy(F.col("value").alias("number")).agg(F.min("entity_id").alias("known"))
    rows = said.join(owners, "nip").join(known, "number", "left").withColumn("entity_id", F.coalesce("known", F.concat(F.lit("ceidg:"), "number")))
    made = rows.filter("known is null").groupBy("entity_id", "number").agg(F.max(F.nullif(F.col("regon"), F.lit(""))).alias("regon"))
    companies = made.select("entity_id", F.concat(F.lit("Spółka cywilna NIP "), "number").alias("display_name"), F.col("number").alias("nip"), "regon", F.lit("spółka cywilna").alias("legal_form"))
    links = rows.select(F.col("owner_id").alias("source_id"), F.col("entity_id").alias("target_id"), F.concat(F.lit("ceidg/firma/"), "nip").alias("document")).groupBy("source_id", "target_id").agg(F.min("document").alias("document"))
    current = relationships.filter("relationship_type = 'partner_in' and superseded_on is null").select("source_id", "target_id")
    return companies, links.join(current, ["source_id", "target_id"], "left_anti").select("source_id", "target_id", F.lit("partner_in").alias("relationship_type"), F.lit("registered").alias("confidence"), "document", F.lit("spolki").alias("locator"))
