"""Readers and mappers of landed registry files. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlink.functions import text as T

NOTICES = "items array<struct<noticeNumber string, noticeType string, noticeTypeTed string, publicationDate string, orderObject string, cpvCode string, orderType string, clientType string, tenderId string, procedureResult string, submittingOffersDate string, pdfUrl string, isTenderAmountBelowEU string, organizationName string, organizationNationalId string, organizationCity string, organizationProvince string, contractors array<struct<contractorName string, contractorNationalId string, contractorCity string, contractorProvince string, contractorCountry string>>>>"
LEI_PAGE = "data array<struct<id string, attributes struct<lei string, registration struct<status string>, entity struct<legalName struct<name string>, registeredAs string, status string, legalForm struct<id string>, jurisdiction string, legalAddress struct<addressLines array<string>, addressNumber string, addressNumberWithinBuilding string, city string, postalCode string, country string>>>>>"
WHITELIST = "result struct<entries array<struct<subjects array<struct<nip string, regon string, krs string, name string, statusVat string, workingAddress string, residenceAddress string>>>>>"
EXTRACT = "odpis struct<naglowekP struct<numerKRS string, wpis array<struct<numerWpisu string, dataWpisu string>>>, dane struct<dzial1 struct<danePodmiotu struct<nazwa array<struct<nazwa string, nrWpisuWprow string, nrWpisuWykr string>>>>>>"

# Notice fields that go to an edge's attributes.
CARRIED = {
    "notice_number": "noticeNumber", "notice_type": "noticeType", "notice_type_ted": "noticeTypeTed", "cpv": "cpvCode", "order_type": "orderType", "client_type": "clientType",
    "tender_id": "tenderId", "procedure_result": "procedureResult", "offers_deadline": "submittingOffersDate", "pdf_url": "pdfUrl", "buyer_province": "organizationProvince", "below_eu_threshold": "isTenderAmountBelowEU",
}
PARENTS = ("IS_DIRECTLY_CONSOLIDATED_BY", "IS_ULTIMATELY_CONSOLIDATED_BY", "IS_SUBFUND_OF")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_semicolon_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """';'-separated, all strings, with a header and perhaps a byte order mark."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("sep", ";").option("header", True).option("enforceSchema", True).csv(path)


def read_zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the CSV files in zip archives, as map<string,string> by header; an archive is a task's unit."""
    import csv
    import io
    import zipfile

    @F.udf("array<map<string,string>>")
    def rows(content):
        out = []
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(z.namelist()):
                out += list(csv.DictReader(io.TextIOWrapper(z.open(name), "utf-8-sig")))
        return out

    return spark.read.format("binaryFile").load(path).select(F.explode(rows("content")).alias("row"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Address points of GML files: id, city, street, building, easting, northing, with references resolved.

    Points without a number, coordinates or a locality are left out.
    """
    def part(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)

    places = part("AD_Miejscowosc", "`_id` string, nazwa string").select(F.col("_id").alias("place"), F.col("nazwa").alias("city"))
    streets = part("AD_UlicaPlac", "`_id` string, nazwa string").select(F.col("_id").alias("way"), F.col("nazwa").alias("street"))
    points = part("AD_PunktAdresowy", "`_id` string, numerPorzadkowy string, pos string, miejscowosc struct<`_href` string>, ulica struct<`_href` string>")
    ref = lambda c: F.regexp_replace(F.col(c), "^#", "")
    at = F.split(F.trim("pos"), r"\s+")
    rows = points.select(F.col("_id").alias("id"), F.col("numerPorzadkowy").alias("building"), F.get(at, F.lit(0)).try_cast("double").alias("easting"), F.get(at, F.lit(1)).try_cast("double").alias("northing"), ref("miejscowosc._href").alias("place"), ref("ulica._href").alias("way"))
    rows = rows.join(places, "place").join(streets, "way", "left")
    return rows.filter("building is not null and easting is not null and northing is not null and city is not null").select("id", "city", "street", "building", "easting", "northing")


def wgs84(easting, northing):
    """struct(lat, lon), rounded to 6 places, of a point in the national transverse Mercator grid (EPSG:2180).

    The inverse series on the GRS80 ellipsoid, as column arithmetic.
    """
    import math

    a, f = 6378137.0, 1 / 298.257222101
    k0, lon0, x0, y0 = 0.9993, math.radians(19), 500000.0, -5300000.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (northing - y0) / (k0 * radius), (easting - x0) / (k0 * radius)
    for j, b in enumerate(beta, 1):
        xi, eta = xi - F.lit(b) * F.sin(2 * j * (northing - y0) / (k0 * radius)) * F.cosh(2 * j * (easting - x0) / (k0 * radius)), eta - F.lit(b) * F.cos(2 * j * (northing - y0) / (k0 * radius)) * F.sinh(2 * j * (easting - x0) / (k0 * radius))
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    lon = F.lit(lon0) + F.atan2(F.sinh(eta), F.cos(xi))
    return F.struct(F.round(F.degrees(lat), 6).alias("lat"), F.round(F.degrees(lon), 6).alias("lon"))


def notices(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of notice pages: contractor -> buyer, at the day of publication.

    Both need a name and a valid tax number; an entity comes once.
    """
    n = pages.select(F.explode("items").alias("n")).select("n.*")
    name, nip = T.notice_name(F.col("organizationName")), T.digits(F.col("organizationNationalId"))
    n = n.withColumn("buyer", name).withColumn("buyer_nip", nip).filter((F.col("buyer") != "") & T.is_nip(F.col("buyer_nip")))
    day = F.to_date(F.try_to_timestamp(F.col("publicationDate")))
    carried = F.map_filter(F.create_map(*[x for k, c in CARRIED.items() for x in (F.lit(k), F.nullif(F.col(c), F.lit("")))]), lambda _, v: v.isNotNull())
    what = F.trim(F.coalesce("orderObject", F.lit("")))
    order = F.when(F.length(what) > 500, F.create_map(F.lit("order_object"), F.substring(what, 1, 500), F.lit("order_object_truncated"), F.lit("true"))).when(what != "", F.create_map(F.lit("order_object"), what)).otherwise(F.create_map().cast("map<string,string>"))
    rows = n.select("buyer", "buyer_nip", "noticeType", "noticeNumber", "organizationCity", day.alias("published"), F.map_concat(carried, order).alias("attributes"), F.explode_outer("contractors").alias("c"))
    rows = rows.withColumn("supplier", T.notice_name(F.col("c.contractorName"))).withColumn("supplier_nip", T.digits(F.col("c.contractorNationalId")))
    fine = rows.filter((F.col("supplier") != "") & T.is_nip(F.col("supplier_nip")) & (F.col("supplier_nip") != F.col("buyer_nip")))
    edges = fine.select(F.concat(F.lit("nip:"), "supplier_nip").alias("source_key"), F.concat(F.lit("nip:"), "buyer_nip").alias("target_key"), F.lit("contractor_of").alias("relationship_type"), F.col("noticeType").alias("role"), F.col("published").alias("valid_from"), F.col("published").alias("valid_to"), F.concat(F.lit("bzp/"), "noticeNumber").alias("locator"), "attributes")
    entity = lambda df, name, nip, city: df.select(F.concat(F.lit("nip:"), nip).alias("local_key"), F.col(name).alias("display_name"), T.company_name(F.col(name)).alias("normalized_name"), F.col(city).alias("city"))
    both = entity(rows, "buyer", "buyer_nip", "organizationCity").unionByName(entity(fine.withColumn("city", F.col("c.contractorCity")), "supplier", "supplier_nip", "city"))
    return both.groupBy("local_key").agg(F.min(F.struct("display_name", "normalized_name", "city")).alias("e")).select("local_key", "e.*"), edges


def lei_records(pages: DataFrame) -> DataFrame:
    """lei, name, normalized_name, scheme and value of the national number, legal_form, status and address."""
    r = pages.select(F.explode("data").alias("d")).select(F.coalesce("d.attributes.lei", "d.id").alias("lei"), "d.attributes.entity.*", F.col("d.attributes.registration.status").alias("registration"))
    line, city = F.get(F.col("legalAddress.addressLines"), F.lit(0)), F.col("legalAddress.city")
    street = T.street_of(line, city, F.col("legalAddress.addressNumber"))
    address = T.address_line(street, F.col("legalAddress.addressNumber"), F.col("legalAddress.addressNumberWithinBuilding"), F.col("legalAddress.postalCode"), city)
    return r.filter("lei is not null and legalName.name is not null").select("lei", F.col("legalName.name").alias("name"), T.company_name(F.col("legalName.name")).alias("normalized_name"), T.identifier_scheme(F.col("registeredAs")).alias("scheme"), T.digits(F.col("registeredAs")).alias("value"), F.col("legalForm.id").alias("legal_form"), "status", "registration", address.alias("address"))


def lei_relationships(rows: DataFrame) -> DataFrame:
    """parent_of edges of relationship rows (row map<string,string>): the parent is the row's end node.

    The relationship's own period counts, in whichever slot it is; without it the edge is open.
    """
    v = lambda k: F.trim(F.coalesce(F.try_element_at("row", F.lit(k)), F.lit("")))
    kind, child, parent = v("Relationship.RelationshipType"), v("Relationship.StartNode.NodeID"), v("Relationship.EndNode.NodeID")
    slots = F.array(*[F.struct(v(f"Relationship.Period.{i}.periodType").alias("t"), v(f"Relationship.Period.{i}.startDate").alias("a"), v(f"Relationship.Period.{i}.endDate").alias("b")) for i in range(1, 6)])
    period = F.get(F.filter(slots, lambda s: s["t"] == "RELATIONSHIP_PERIOD"), F.lit(0))
    ok = kind.isin(*PARENTS) & (child != "") & (parent != "") & (child != parent) & v("Relationship.RelationshipStatus").isin("ACTIVE", "")
    day = lambda c: F.to_date(F.try_to_timestamp(c))
    return rows.filter(ok).select(F.concat(F.lit("lei:"), parent).alias("source_key"), F.concat(F.lit("lei:"), child).alias("target_key"), F.lit("parent_of").alias("relationship_type"), kind.alias("role"), day(period["a"]).alias("valid_from"), day(period["b"]).alias("valid_to"), F.concat_ws("/", F.lit("rr"), child, kind).alias("locator"))


def bridges(pages: DataFrame) -> DataFrame:
    """nip, scheme, value: what a whitelist answer says of other numbers of a taxpayer."""
    s = pages.select(F.explode("result.entries").alias("e")).select(F.explode("e.subjects").alias("s")).select("s.*").filter(T.is_nip(F.col("nip")))
    pairs = F.array(F.struct(F.lit("krs").alias("scheme"), F.when(T.is_krs(F.col("krs")), T.digits(F.col("krs"))).alias("value")), F.struct(F.lit("regon").alias("scheme"), F.when(T.is_regon(F.col("regon")), T.digits(F.col("regon"))).alias("value")))
    return s.select("nip", F.explode(pairs).alias("p")).select("nip", "p.*").filter("value is not null")


def extract_names(extracts: DataFrame) -> DataFrame:
    """krs, name, valid_from, valid_to: the versions of a company's name, entry numbers resolved to dates."""
    e = extracts.select(F.col("odpis.naglowekP.numerKRS").alias("krs"), F.col("odpis.naglowekP.wpis").alias("entries"), F.explode("odpis.dane.dzial1.danePodmiotu.nazwa").alias("v"))
    dates = F.map_from_entries(F.transform("entries", lambda x: F.struct(x["numerWpisu"], x["dataWpisu"])))
    day = lambda c: T.any_date(F.try_element_at(dates, c))
    return e.select("krs", F.col("v.nazwa").alias("name"), day(F.col("v.nrWpisuWprow")).alias("valid_from"), day(F.col("v.nrWpisuWykr")).alias("valid_to"))


def financial_rows(sheet: DataFrame) -> DataFrame:
    """Rows of a landed tax sheet (name, nip, period_from, period_to as serial days, amounts as text) that can be used."""
    amounts = ["revenue", "costs", "income", "loss", "tax_base", "tax_due"]
    rows = sheet.select("name", T.digits(F.col("nip")).alias("nip"), *[T.excel_date(F.col(c).try_cast("int")).alias(c) for c in ("period_from", "period_to")], *[T.amount(F.col(c)).alias(c) for c in amounts])
    return rows.filter(T.is_nip(F.col("nip")) & (F.trim("name") != "") & (F.col("period_to") >= F.col("period_from")))


def newest_reports(catalogue: DataFrame) -> DataFrame:
    """Of each region's reports the newest. catalogue: name, id, created_at."""
    own = Window.partitionBy("name").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return catalogue.withColumn("n", F.row_number().over(own)).filter("n = 1").drop("n")


def resolved_edges(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (doc_id, source_key, target_key, ...) with ids of the document's own entities (doc_id, local_key, id).

    Unresolved ends and self loops drop out.
    """
    end = lambda side: entities.select("doc_id", F.col("local_key").alias(f"{side}_key"), F.col("id").alias(f"{side}_id"))
    return documents.join(end("source"), ["doc_id", "source_key"]).join(end("target"), ["doc_id", "target_key"]).filter("source_id <> target_id")


def fetch_costs(profiles: DataFrame) -> DataFrame:
    """Sources by the hours a full fetch takes: requests over the lower of rate and concurrency / latency."""
    speed = F.least(F.col("rate_per_second"), F.col("concurrency") / F.col("latency_seconds"))
    hours = F.round(F.ceil(F.col("records") / F.col("page_size")) / speed / 3600, 4)
    return profiles.withColumn("hours", hours).orderBy("hours", "name")
