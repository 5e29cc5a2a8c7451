"""Court-register extracts (KRS) as landed JSON texts: company, seats, corporate partners, takeovers.

A full extract wraps each field in a list of versions, a current one does not;
both are read alike. Versions name the entries that began and ended them, and
the header dates the entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions import text as T

#: Entries that began and ended a version.
SPAN = "nrWpisuWprow string, nrWpisuWykr string"


def versions(raw: Column, fields: str) -> Column:
    """raw, JSON text of a list of objects or of one, as an array of structs; empty for anything else."""
    return F.coalesce(F.filter(F.from_json(raw, f"array<struct<{fields}>>"), lambda v: v.isNotNull()), F.array().cast(f"array<struct<{fields}>>"))


def first(raw: Column, fields: str) -> Column:
    return F.get(versions(raw, fields), F.lit(0))


def current(found: Column, field: str) -> Column:
    """A field of the version that no entry ended, else of the last one."""
    still = F.filter(found, lambda v: F.coalesce(v["nrWpisuWykr"], F.lit("")).isin("", "0"))
    return F.when(F.size(still) > 0, F.get(still, F.lit(0))[field]).otherwise(F.try_element_at(found, F.lit(-1))[field])


def scalar(raw: Column) -> Column:
    """raw if it is plain text and not JSON of a list or object."""
    return F.when(~raw.rlike(r"^\s*[\[{]"), raw)


def _read(documents: DataFrame) -> DataFrame:
    at = lambda path: F.get_json_object("payload", path)
    header = first(F.coalesce(at("$.odpis.naglowekP"), at("$.odpis.naglowekA")), "numerKRS string, wpis string")
    one = first(at("$.odpis.dane.dzial1"), "danePodmiotu string, siedzibaIAdres string, kapital string, wspolnicySpzoo string")
    rows = documents.select("doc_id", header.alias("header"), one.alias("one"), at("$.odpis.dane.dzial2.reprezentacja").alias("two"), at("$.odpis.dane.dzial6.polaczeniePodzialPrzeksztalcenie").alias("six"))
    rows = rows.withColumn("subject", first(F.col("one.danePodmiotu"), "nazwa string, identyfikatory string, formaPrawna string"))
    dated = F.transform(versions(F.col("header.wpis"), "numerWpisu string, dataWpisu string"), lambda e: F.struct(e["numerWpisu"].try_cast("int").alias("no"), T.any_date(F.substring(F.trim(e["dataWpisu"]), 1, 10)).alias("day")))
    dated = F.sort_array(F.filter(dated, lambda e: e["no"].isNotNull() & e["day"].isNotNull()))
    # Of an entry that is dated twice the later date counts.
    rows = rows.withColumn("dated", dated)
    rows = rows.withColumn("names", versions(F.col("subject.nazwa"), f"nazwa string, {SPAN}"))
    rows = rows.withColumn("name", F.coalesce(F.nullif(current(F.col("names"), "nazwa"), F.lit("")), scalar(F.col("subject.nazwa")))).filter("name != ''")
    rows = rows.withColumn("krs", F.nullif(F.col("header.numerKRS"), F.lit("")))
    return rows.withColumn("key", F.concat(F.lit("company:"), F.coalesce("krs", T.company_name(F.col("name")))))


def _day(entry: Column) -> Column:
    return F.try_element_at(F.filter("dated", lambda e: e["no"] == entry.try_cast("int")), F.lit(-1))["day"]


def _history(found: Column, field: str) -> Column:
    kept = F.filter(found, lambda v: v[field].isNotNull())
    return F.transform(kept, lambda v: F.struct(v[field].alias("value"), _day(v["nrWpisuWprow"]).alias("from"), _day(v["nrWpisuWykr"]).alias("to")))


def _entity(rows: DataFrame, kind: str, key, name, normalized, krs=None, nip=None, regon=None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return rows.select("doc_id", key.alias("local_key"), F.lit(kind).alias("entity_type"), name.alias("display_name"), normalized.alias("normalized_name"), text(krs).alias("krs"), text(nip).alias("nip"), text(regon).alias("regon"))


def _edge(rows: DataFrame, source, target, kind: str, role, begin, end, locator) -> DataFrame:
    return rows.select("doc_id", source.alias("source_key"), target.alias("target_key"), F.lit(kind).alias("relationship_type"), role.alias("role"), begin.alias("valid_from"), end.alias("valid_to"), locator.alias("locator"))


def company_details(documents: DataFrame) -> DataFrame:
    """doc_id, local_key, legal_form, registered_on, name_history, capital_history, board_size of extracts that name a company."""
    rows = _read(documents)
    form = F.get(versions(F.col("subject.formaPrawna"), "formaPrawna string"), F.lit(0))["formaPrawna"]
    capital = versions(first(F.col("one.kapital"), "wysokoscKapitaluZakladowego string")["wysokoscKapitaluZakladowego"], f"wartosc string, {SPAN}")
    board = F.size(versions(first(F.col("two"), "sklad string")["sklad"], "nrWpisuWprow string"))
    return rows.select("doc_id", F.col("key").alias("local_key"), F.coalesce(form, scalar(F.col("subject.formaPrawna"))).alias("legal_form"), F.get("dated", F.lit(0))["day"].alias("registered_on"), _history(F.col("names"), "nazwa").alias("name_history"), _history(capital, "wartosc").alias("capital_history"), board.alias("board_size"))


def facts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of documents (doc_id, payload).

    Entities: doc_id, local_key, entity_type, display_name, normalized_name, krs,
    nip, regon. Edges: doc_id, source_key, target_key, relationship_type, role,
    valid_from, valid_to, locator. Each seat an entry gives is an address and an
    edge with its period; partners that are companies hold shares; taken-over
    companies are succeeded, if a register number says which they are. A
    document without a company has no facts.
    """
    rows = _read(documents)
    ids = first(F.col("subject.identyfikatory"), "nip string, regon string")
    empty = lambda c: F.nullif(c, F.lit(""))
    company = _entity(rows, "company", F.col("key"), F.col("name"), T.company_name(F.col("name")), F.col("krs"), empty(ids["nip"]), empty(ids["regon"]))

    seats = versions(first(F.col("one.siedzibaIAdres"), "adres string")["adres"], f"ulica string, nrDomu string, nrLokalu string, kodPocztowy string, miejscowosc string, kraj string, {SPAN}")
    seats = rows.select("doc_id", "key", "dated", F.posexplode(seats).alias("no", "v"))
    parts = [empty(F.col(f"v.{c}")) for c in ("ulica", "nrDomu", "nrLokalu", "kodPocztowy", "miejscowosc")]
    seats = seats.withColumn("display", F.concat_ws(", ", *parts)).filter("display != ''").withColumn("place", T.natural_key(F.col("display")))
    at = F.concat(F.lit("address:"), "place")
    locator = lambda path: F.concat(F.lit(path), F.col("no").cast("string"))
    begin, end, none = _day(F.col("v.nrWpisuWprow")), _day(F.col("v.nrWpisuWykr")), F.lit(None)
    addresses = _entity(seats, "address", at, F.col("display"), F.col("place"))
    seated = _edge(seats, F.col("key"), at, "registered_at", none.cast("string"), begin, end, locator("/odpis/dane/dzial1/siedzibaIAdres/adres/"))

    partners = versions(F.col("one.wspolnicySpzoo"), f"nazwa string, nazwaPodmiotu string, numerKRS string, identyfikator struct<numerKRS string>, {SPAN}")
    partners = rows.select("doc_id", "key", "dated", F.posexplode(partners).alias("no", "v"))
    partners = partners.withColumn("name", F.coalesce(empty(scalar(F.col("v.nazwa"))), scalar(F.col("v.nazwaPodmiotu")))).filter("name != ''")
    partners = partners.withColumn("krs", F.coalesce(empty(F.col("v.numerKRS")), empty(F.col("v.identyfikator.numerKRS"))))
    partners = partners.withColumn("other", F.concat(F.lit("company:"), F.coalesce("krs", T.company_name(F.col("name")))))
    holders = _entity(partners, "company", F.col("other"), F.col("name"), T.company_name(F.col("name")), F.col("krs"))
    shares = _edge(partners, F.col("other"), F.col("key"), "shareholder_of", F.lit("WSPÓLNIK"), begin, end, locator("/odpis/dane/dzial1/wspolnicySpzoo/"))

    merged = rows.select("doc_id", "key", "dated", F.posexplode(versions(F.col("six"), "okreslenieOkolicznosci string, podmiotyPrzejmowane string")).alias("item", "m"))
    taken = versions(F.col("m.podmiotyPrzejmowane"), "nazwa string, krs string, krajNazwaRejestru string, numerWRejestrzeAlboEwidencji string, identyfikator string")
    taken = merged.select("doc_id", "key", "dated", "item", "m", F.posexplode(taken).alias("no", "v"))
    of = lambda c, field: current(versions(F.col(f"v.{c}"), f"{field} string, {SPAN}"), field)
    name = F.trim(F.btrim(F.trim(F.substring_index(of("nazwa", "nazwa"), ",", 1)), F.lit("-")))
    in_krs = F.upper(of("krajNazwaRejestru", "krajNazwaRejestru")).contains("KRAJOWY REJESTR")
    number = F.when(in_krs, empty(of("numerWRejestrzeAlboEwidencji", "numerWRejestrzeAlboEwidencji")))
    taken = taken.withColumn("name", name).withColumn("krs", F.coalesce(empty(of("krs", "krs")), number)).withColumn("regon", empty(of("identyfikator", "regon")))
    taken = taken.filter((of("nazwa", "nazwa") != "") & F.coalesce("krs", "regon").isNotNull())
    taken = taken.withColumn("other", F.coalesce(F.concat(F.lit("company:"), "krs"), F.concat(F.lit("company:regon:"), "regon")))
    role = current(versions(F.col("m.okreslenieOkolicznosci"), f"okreslenieOkolicznosci string, {SPAN}"), "okreslenieOkolicznosci")
    since = _day(first(F.col("v.nazwa"), f"nazwa string, {SPAN}")["nrWpisuWprow"])
    path = F.concat(F.lit("/odpis/dane/dzial6/polaczeniePodzialPrzeksztalcenie/"), F.col("item").cast("string"), F.lit("/podmiotyPrzejmowane/"), F.col("no").cast("string"))
    lost = _entity(taken, "company", F.col("other"), F.col("name"), T.company_name(F.col("name")), F.col("krs"), None, F.col("regon"))
    succeeded = _edge(taken, F.col("key"), F.col("other"), "successor_of", role, since, none.cast("date"), path)
    return company.unionByName(addresses).unionByName(holders).unionByName(lost), seated.unionByName(shares).unionByName(succeeded)
