"""Queries that load landed registry documents and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.operators import ceidg
from ledgerlink.sources import extracts
from ledgerlink.sources.adapters import frame, view, with_views

#: Nine digits of a customer, and the tax number they begin: the tenth is their weighted sum modulo 11, where that is a digit.
NINE = "lpad(CAST((c_custkey * 7919) % 1000000000 AS STRING), 9, '1')"
CHECK = "(" + " + ".join(f"CAST(substr(nine, {i}, 1) AS INT) * {w}" for i, w in enumerate((6, 5, 7, 2, 3, 4, 5, 6, 7), 1)) + ") % 11"
TRADERS = f"""SELECT *, nine || CAST({CHECK} % 10 AS STRING) AS number, {CHECK} < 10 AS fine FROM (SELECT c.*, {NINE} AS nine FROM customer c) x"""
#: A row of the report for each customer; a second, later one for every ninth.
REPORT = f"""SELECT c_custkey * 2 + again AS line, substr(number, 1, 3) || '-' || substr(number, 4) AS Nip, CASE WHEN c_custkey % 3 = 0 THEN ' 123-456-785 ' END AS Regon,
  CASE c_custkey % 4 WHEN 0 THEN '-' WHEN 1 THEN 'Zakład ' || c_name || ' S.C.' WHEN 2 THEN '' ELSE c_name END AS NazwaPodmiotu,
  CASE WHEN c_custkey % 5 <> 0 THEN 'Jan' ELSE '' END AS Imie, CASE WHEN c_custkey % 5 <> 0 THEN upper(replace(c_name, '#', ' ')) END AS Nazwisko,
  'Polna' AS Ulica, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_nationkey AS STRING) END AS NrBudynku, CASE WHEN c_custkey % 6 = 1 THEN '2' END AS NrLokalu, CASE WHEN c_custkey % 7 <> 0 THEN '00-950' END AS KodPocztowy,
  CASE WHEN c_custkey % 11 <> 0 THEN 'Nowe Miasto' ELSE NULL END AS Miejscowosc, CASE c_custkey % 3 WHEN 0 THEN 'Aktywny' WHEN 1 THEN 'Wykreślony' ELSE 'Działalność jest prowadzona wyłącznie w formie spółki cywilnej' END AS StatusDzialalnosci,
  CASE WHEN again = 0 THEN '2001-02-03' ELSE '2004-05-06' END AS DataRozpoczeciaDzialalnosci, CASE WHEN c_custkey % 8 = 0 THEN '2010-12-31' END AS DataZakonczeniaDzialalnosci, 'X' AS GlownyKodPkd
  FROM ({TRADERS}) t CROSS JOIN (SELECT 0 AS again UNION ALL SELECT 1) a WHERE again = 0 OR c_custkey % 9 = 0"""
#: Known already: numbers of every fourth trader, owners of every eighth, one address.
KNOWN = f"""SELECT 'C' || CAST(c_custkey AS STRING) AS entity_id, 'nip' AS scheme, number AS value FROM ({TRADERS}) t WHERE fine AND c_custkey % 4 = 0
  UNION ALL SELECT 'U' || CAST(c_custkey AS STRING), 'internal', 'ceidg-owner:' || number FROM ({TRADERS}) t WHERE fine AND c_custkey % 8 = 0"""
PLACES = "SELECT 'A1' AS entity_id, 'polna3' || '00950nowemiasto' AS normalized, CAST(NULL AS STRING) AS building, CAST(NULL AS STRING) AS unit, 'stare' AS voivodeship"

#: The same rows worked out directly: one a number, the last line.
STAGED = f"""SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 'C' || CAST(c_custkey AS VARCHAR) END AS company_known, CASE WHEN c_custkey % 8 = 0 THEN 'U' || CAST(c_custkey AS VARCHAR) END AS owner_known,
  coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'C' || CAST(c_custkey AS VARCHAR) END, 'ceidg:' || number) AS company_id,
  CASE WHEN c_custkey % 5 <> 0 THEN coalesce(CASE WHEN c_custkey % 8 = 0 THEN 'U' || CAST(c_custkey AS VARCHAR) END, 'ceidg-owner:' || number) END AS owner_id,
  regexp_replace(lower(address), '[^a-z0-9]', '', 'g') AS address_key FROM (SELECT *, {{name}} AS name, {{address}} AS address, CASE WHEN c_custkey % 9 = 0 THEN DATE '2004-05-06' ELSE DATE '2001-02-03' END AS begin FROM ({TRADERS}) t WHERE fine) s"""
OWNER = "CASE WHEN c_custkey % 5 <> 0 THEN 'Jan ' || upper(replace(c_name, '#', ' ')) ELSE '' END"
STAGED = STAGED.format(
    name=f"CASE c_custkey % 4 WHEN 1 THEN 'Zakład ' || c_name || ' S.C.' WHEN 3 THEN c_name ELSE coalesce(nullif({OWNER}, ''), 'JDG ' || number) END",
    address="""concat_ws(', ', CASE WHEN c_custkey % 6 = 0 THEN 'Polna' ELSE 'Polna ' || CAST(c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 6 = 1 THEN '/2' ELSE '' END END,
      nullif(concat_ws(' ', CASE WHEN c_custkey % 7 <> 0 THEN '00-950' END, CASE WHEN c_custkey % 11 <> 0 THEN 'Nowe Miasto' END), ''))""",
)
ADDRESS_ID = "CASE WHEN address_key = 'polna300950nowemiasto' THEN 'A1' ELSE 'address:' || substr(sha256(address_key), 1, 32) END"
PLAIN = "trim(regexp_replace(replace(lower({x}), 'ł', 'l'), '[^a-z0-9]+', ' ', 'g'))"


def _staged(spark, sf_dir) -> DataFrame:
    prepared = ceidg.prepare(frame(spark, sf_dir, REPORT), "mazowieckie", ("line",))
    return ceidg.staged(prepared, "line", frame(spark, sf_dir, KNOWN), frame(spark, sf_dir, PLACES))


def ceidg_staged(spark, sf_dir):
    return _staged(spark, sf_dir).select("nip", "name", "owner", "regon", "status", "address", "address_key", "company_id", "owner_id", "address_id", "started_on")


def ceidg_entities(spark, sf_dir):
    return ceidg.new_entities(_staged(spark, sf_dir)).select("id", "entity_type", "display_name", "blocking_key")


def ceidg_identifiers(spark, sf_dir):
    return ceidg.new_identifiers(_staged(spark, sf_dir))


def ceidg_companies(spark, sf_dir):
    return ceidg.company_rows(_staged(spark, sf_dir)).select("entity_id", "nip", "regon", "status", "registered_on", "deregistered_on", "city", "voivodeship", "pkd_main")


def ceidg_edges(spark, sf_dir):
    return ceidg.edges(_staged(spark, sf_dir))


def ceidg_backfill(spark, sf_dir):
    return ceidg.backfilled_addresses(frame(spark, sf_dir, PLACES), _staged(spark, sf_dir))


EDGES = f"""SELECT owner_id AS source_id, company_id AS target_id, 'sole_proprietor_of' AS relationship_type, 'WŁAŚCICIEL' AS role, begin AS valid_from, CASE WHEN c_custkey % 8 = 0 THEN DATE '2010-12-31' END AS valid_to, 'nip:' || number AS locator FROM ({STAGED}) s WHERE owner_id IS NOT NULL
  UNION ALL SELECT company_id, {ADDRESS_ID}, 'registered_at', NULL, begin, NULL, 'nip:' || number FROM ({STAGED}) s"""


def ceidg_provenance(spark, sf_dir):
    """Of the stored edges every third has no source yet; the load's rows say where they come from."""
    rows = _staged(spark, sf_dir)
    stored = ceidg.edges(rows).select(F.concat("locator", F.lit("/"), "relationship_type").alias("id"), "source_id", "target_id", "relationship_type")
    known = stored.filter("pmod(crc32(id), 3) <> 0").select(F.col("id").alias("relationship_id"))
    return ceidg.missing_provenance(rows, stored, known)


#: Entries of the traders in civil partnerships: one has a number that is known, one is new.
ENTRIES = f"""SELECT number AS nip, '{{"firma": "x", "spolki": [{{"nip": "' || CASE WHEN c_custkey % 2 = 0 THEN '0000000010' ELSE '55' || lpad(CAST(c_nationkey AS STRING), 8, '0') END || '", "regon": " ' || CAST(c_nationkey AS STRING) || '"}}, {{"nip": " ", "regon": "1"}}, {{"regon": "2"}}]}}' AS payload
  FROM ({TRADERS}) t WHERE fine UNION ALL SELECT 'none', NULL UNION ALL SELECT 'none', '{{}}'"""
PARTNERED = "SELECT 'ceidg-owner:' || number AS source_id, 'ceidg:55' || lpad(CAST(c_nationkey AS STRING), 8, '0') AS target_id, 'partner_in' AS relationship_type, CAST(NULL AS DATE) AS superseded_on FROM (" + TRADERS + ") t WHERE c_custkey % 7 = 0"


def _partnerships(spark, sf_dir):
    return ceidg.partnerships(frame(spark, sf_dir, ENTRIES), _staged(spark, sf_dir), view(spark, sf_dir, "identifiers"), frame(spark, sf_dir, PARTNERED))


def partnership_companies(spark, sf_dir):
    return _partnerships(spark, sf_dir)[0]


def partnership_edges(spark, sf_dir):
    return _partnerships(spark, sf_dir)[1]


PARTNERS = f"SELECT * FROM ({STAGED}) s WHERE c_custkey % 3 = 2 AND owner_id IS NOT NULL"

# Extracts of companies: odd ones are full, with versions and entries; even ones are current, without lists.
EXTRACTS = """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 1 THEN
  '{"odpis": {"naglowekP": {"numerKRS": "' || lpad(CAST(c_custkey AS STRING), 10, '0') || '", "wpis": [{"numerWpisu": "1", "dataWpisu": "01.02.2001"}, {"numerWpisu": 2, "dataWpisu": "2010-06-15"}, {"numerWpisu": null, "dataWpisu": "x"}]}, "dane": {"dzial1": {'
  || '"danePodmiotu": [{"nazwa": [{"nazwa": "Old ' || c_name || ' S.A.", "nrWpisuWprow": "1", "nrWpisuWykr": "2"}, {"nazwa": "' || c_name || ' S.A.", "nrWpisuWprow": "2"}], "identyfikatory": [{"nip": "' || CAST(c_custkey AS STRING) || '", "regon": ""}], "formaPrawna": [{"formaPrawna": "SPÓŁKA AKCYJNA"}]}], '
  || '"siedzibaIAdres": {"adres": [{"ulica": "Polna", "nrDomu": "' || CAST(c_nationkey AS STRING) || '", "miejscowosc": "Radom", "nrWpisuWprow": "1", "nrWpisuWykr": "2"}, {"nrDomu": "7", "miejscowosc": "Lublin", "nrWpisuWprow": "2"}, {"ulica": ""}]}, '
  || '"kapital": {"wysokoscKapitaluZakladowego": [{"wartosc": "100,00", "nrWpisuWprow": "1"}]}, "wspolnicySpzoo": [{"nazwa": "Partner ' || CAST(c_nationkey AS STRING) || ' Sp. z o.o.", "identyfikator": {"numerKRS": "77"}, "nrWpisuWprow": "2"}, {"nazwaPodmiotu": "' || c_mktsegment || '"}, {"nazwa": ""}]}, '
  || '"dzial2": {"reprezentacja": {"sklad": [{"x": 1}, {"x": 2}]}}, "dzial6": {"polaczeniePodzialPrzeksztalcenie": [{"okreslenieOkolicznosci": [{"okreslenieOkolicznosci": "PRZEJĘCIE"}], "podmiotyPrzejmowane": [{"nazwa": [{"nazwa": "- Taken, SPÓŁKA -", "nrWpisuWprow": "2"}], "krajNazwaRejestru": [{"krajNazwaRejestru": "POLSKA, KRAJOWY REJESTR SĄDOWY"}], "numerWRejestrzeAlboEwidencji": [{"numerWRejestrzeAlboEwidencji": "88"}]}, {"nazwa": [{"nazwa": "Older"}], "identyfikator": [{"regon": "99"}]}, {"nazwa": [{"nazwa": "Nobody"}]}]}]}}}}'
  WHEN c_custkey % 10 = 0 THEN '{"odpis": {"naglowekA": {"numerKRS": "1"}}}'
  ELSE '{"odpis": {"naglowekA": {"numerKRS": "' || lpad(CAST(c_custkey AS STRING), 10, '0') || '"}, "dane": {"dzial1": {"danePodmiotu": {"nazwa": "' || c_name || '", "formaPrawna": "INNA", "identyfikatory": {"regon": "5"}}, "siedzibaIAdres": {"adres": {"miejscowosc": "Gniezno"}}}}}}' END AS payload FROM customer
  UNION ALL SELECT -1, 'no json' UNION ALL SELECT -2, NULL"""
KEYED = "SELECT *, 'company:' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key FROM customer"


def krs_details(spark, sf_dir):
    d = extracts.company_details(frame(spark, sf_dir, EXTRACTS))
    shown = lambda c: F.array_join(F.transform(c, lambda h: F.concat_ws("|", h["value"], F.coalesce(h["from"].cast("string"), F.lit("-")), F.coalesce(h["to"].cast("string"), F.lit("-")))), ";")
    return d.select("doc_id", "local_key", "legal_form", "registered_on", shown("name_history").alias("names"), shown("capital_history").alias("capital"), "board_size")


def krs_entities(spark, sf_dir):
    return extracts.facts(frame(spark, sf_dir, EXTRACTS))[0].drop("normalized_name")


def krs_edges(spark, sf_dir):
    return extracts.facts(frame(spark, sf_dir, EXTRACTS))[1]


KRS_ENTITIES = f"""SELECT c_custkey AS doc_id, key AS local_key, 'company' AS entity_type, CASE WHEN c_custkey % 2 = 1 THEN c_name || ' S.A.' ELSE c_name END AS display_name, substr(key, 9) AS krs, CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey AS VARCHAR) END AS nip, CASE WHEN c_custkey % 2 = 0 THEN '5' END AS regon FROM ({KEYED}) k WHERE c_custkey % 10 <> 0
  UNION ALL SELECT c_custkey, 'address:gniezno', 'address', 'Gniezno', NULL, NULL, NULL FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 10 <> 0
  UNION ALL SELECT c_custkey, 'address:polna' || c_nationkey || 'radom', 'address', 'Polna, ' || c_nationkey || ', Radom', NULL, NULL, NULL FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, 'address:7lublin', 'address', '7, Lublin', NULL, NULL, NULL FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, 'company:77', 'company', 'Partner ' || c_nationkey || ' Sp. z o.o.', '77', NULL, NULL FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, 'company:' || lower(c_mktsegment), 'company', c_mktsegment, NULL, NULL, NULL FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, 'company:88', 'company', 'Taken', '88', NULL, NULL FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, 'company:regon:99', 'company', 'Older', NULL, NULL, '99' FROM customer WHERE c_custkey % 2 = 1"""
KRS_EDGES = f"""WITH k AS ({KEYED}), odd AS (SELECT * FROM k WHERE c_custkey % 2 = 1)
SELECT c_custkey AS doc_id, key AS source_key, 'address:gniezno' AS target_key, 'registered_at' AS relationship_type, NULL AS role, NULL::DATE AS valid_from, NULL::DATE AS valid_to, '/odpis/dane/dzial1/siedzibaIAdres/adres/0' AS locator FROM k WHERE c_custkey % 2 = 0 AND c_custkey % 10 <> 0
  UNION ALL SELECT c_custkey, key, 'address:polna' || c_nationkey || 'radom', 'registered_at', NULL, DATE '2001-02-01', DATE '2010-06-15', '/odpis/dane/dzial1/siedzibaIAdres/adres/0' FROM odd
  UNION ALL SELECT c_custkey, key, 'address:7lublin', 'registered_at', NULL, DATE '2010-06-15', NULL, '/odpis/dane/dzial1/siedzibaIAdres/adres/1' FROM odd
  UNION ALL SELECT c_custkey, 'company:77', key, 'shareholder_of', 'WSPÓLNIK', DATE '2010-06-15', NULL, '/odpis/dane/dzial1/wspolnicySpzoo/0' FROM odd
  UNION ALL SELECT c_custkey, 'company:' || lower(c_mktsegment), key, 'shareholder_of', 'WSPÓLNIK', NULL, NULL, '/odpis/dane/dzial1/wspolnicySpzoo/1' FROM odd
  UNION ALL SELECT c_custkey, key, 'company:88', 'successor_of', 'PRZEJĘCIE', DATE '2010-06-15', NULL, '/odpis/dane/dzial6/polaczeniePodzialPrzeksztalcenie/0/podmiotyPrzejmowane/0' FROM odd
  UNION ALL SELECT c_custkey, key, 'company:regon:99', 'successor_of', 'PRZEJĘCIE', NULL, NULL, '/odpis/dane/dzial6/polaczeniePodzialPrzeksztalcenie/0/podmiotyPrzejmowane/1' FROM odd"""

QUERIES = {
    "ceidg_staged": (ceidg_staged, f"""SELECT number AS nip, name, {OWNER} AS owner, CASE WHEN c_custkey % 3 = 0 THEN '123456785' ELSE '' END AS regon, CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'deleted' ELSE 'partnership_only' END AS status,
      address, address_key, company_id, owner_id, {ADDRESS_ID} AS address_id, CAST(begin AS VARCHAR) AS started_on FROM ({STAGED}) s"""),
    "ceidg_entities": (ceidg_entities, f"""SELECT company_id AS id, 'company' AS entity_type, name AS display_name, substr(replace({PLAIN.format(x="regexp_replace(name, ' S.C.$', '')")}, ' ', ''), 1, 12) AS blocking_key FROM ({STAGED}) s WHERE company_known IS NULL
      UNION ALL SELECT owner_id, 'person', {OWNER}, 'jan|' || lower(replace(c_name, '#', ' ')) FROM ({STAGED}) s WHERE owner_id IS NOT NULL AND owner_known IS NULL
      UNION ALL SELECT * FROM (SELECT {ADDRESS_ID} AS id, 'address', min(address), NULL FROM ({STAGED}) s GROUP BY 1) a WHERE id <> 'A1'"""),
    "ceidg_identifiers": (ceidg_identifiers, f"""SELECT company_id AS entity_id, 'nip' AS scheme, number AS value FROM ({STAGED}) s WHERE company_known IS NULL UNION ALL SELECT owner_id, 'internal', 'ceidg-owner:' || number FROM ({STAGED}) s WHERE owner_id IS NOT NULL AND owner_known IS NULL"""),
    "ceidg_companies": (ceidg_companies, f"""SELECT company_id AS entity_id, number AS nip, CASE WHEN c_custkey % 3 = 0 THEN '123456785' END AS regon, CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'deleted' ELSE 'partnership_only' END AS status, begin AS registered_on,
      CASE WHEN c_custkey % 8 = 0 THEN DATE '2010-12-31' END AS deregistered_on, CASE WHEN c_custkey % 11 <> 0 THEN 'Nowe Miasto' END AS city, 'mazowieckie' AS voivodeship, 'X' AS pkd_main FROM ({STAGED}) s"""),
    "ceidg_edges": (ceidg_edges, EDGES),
    "ceidg_backfill": (ceidg_backfill, f"""SELECT 'A1' AS entity_id, 'polna300950nowemiasto' AS normalized, CASE WHEN n > 0 THEN '3' END AS building, NULL AS unit, CASE WHEN n > 0 THEN 'mazowieckie' ELSE 'stare' END AS voivodeship FROM (SELECT count(*) AS n FROM ({STAGED}) s WHERE address_key = 'polna300950nowemiasto') c"""),
    "ceidg_provenance": (ceidg_provenance, None),
    "partnership_companies": (partnership_companies, f"""SELECT DISTINCT 'ceidg:' || n AS entity_id, 'Spółka cywilna NIP ' || n AS display_name, n AS nip, regon, 'spółka cywilna' AS legal_form FROM (SELECT '55' || lpad(CAST(c_nationkey AS VARCHAR), 8, '0') AS n, CAST(c_nationkey AS VARCHAR) AS regon FROM ({PARTNERS}) p WHERE c_custkey % 2 = 1) x"""),
    "partnership_edges": (partnership_edges, f"""SELECT owner_id AS source_id, CASE WHEN c_custkey % 2 = 0 THEN 'C10' ELSE 'ceidg:55' || lpad(CAST(c_nationkey AS VARCHAR), 8, '0') END AS target_id, 'partner_in' AS relationship_type, 'registered' AS confidence, 'ceidg/firma/' || number AS document, 'spolki' AS locator
      FROM ({PARTNERS}) p WHERE c_custkey % 2 = 0 OR c_custkey % 7 <> 0"""),
    "krs_details": (krs_details, f"""SELECT c_custkey AS doc_id, key AS local_key, 'SPÓŁKA AKCYJNA' AS legal_form, DATE '2001-02-01' AS registered_on, 'Old ' || c_name || ' S.A.|2001-02-01|2010-06-15;' || c_name || ' S.A.|2010-06-15|-' AS names, '100,00|2001-02-01|-' AS capital, 2 AS board_size FROM ({KEYED}) k WHERE c_custkey % 2 = 1
      UNION ALL SELECT c_custkey, key, 'INNA', NULL, '', '', 0 FROM ({KEYED}) k WHERE c_custkey % 2 = 0 AND c_custkey % 10 <> 0"""),
    "krs_entities": (krs_entities, KRS_ENTITIES),
    "krs_edges": (krs_edges, KRS_EDGES),
}
QUERIES = {k: (q, sql and with_views(sql)) for k, (q, sql) in QUERIES.items()}
