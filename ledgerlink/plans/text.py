"""Scalar-function queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlink.functions import text as T
from ledgerlink.sources.adapters import frame, view, with_views

NAMES = """SELECT s_suppkey AS k, CASE s_suppkey % 8 WHEN 0 THEN 'Łódzka Fabryka ' || s_name || ' Sp. z o.o.' WHEN 1 THEN 'ZAKŁAD ' || s_name || ' S.A.' WHEN 2 THEN s_name || ' spółka jawna'
  WHEN 3 THEN '"' || s_name || '" Sp. k. w likwidacji' WHEN 4 THEN 'Straße ' || s_name || ' s.c.' WHEN 5 THEN 'Żółw SPÓŁKA Z OGRANICZONĄ ODPOWIEDZIALNOŚCIĄ' WHEN 6 THEN s_name || ' P.S.A. Zóra ﬁrma Ạn' ELSE s_name END AS name FROM supplier"""
DOC_WORDS = "SELECT doc_id AS k, text AS name FROM documents"
CODES = "SELECT c_custkey AS k, lpad(CAST((c_custkey * 7919137) % 10000000000 AS STRING), 10, '0') AS ten, lpad(CAST((c_custkey * 104729) % 1000000000 AS STRING), 9, '0') AS nine, lpad(CAST((c_custkey * 104729) % 1000000000 AS STRING), 9, '0') || lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS fourteen FROM customer"
PLACES = """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_type || ' ' || p_name || ' ' || CAST(p_size AS STRING) WHEN 1 THEN 'ul. ' || p_name || ' ' || CAST(p_size AS STRING) WHEN 2 THEN 'Aleja ' || p_name ELSE p_name END AS line,
  p_type AS city, p_name AS street, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS STRING) END AS building, CASE WHEN p_partkey % 3 = 0 THEN '2' END AS unit, CASE WHEN p_partkey % 7 <> 0 THEN '00-950' END AS postal FROM part"""


def sql_fold(x: str) -> str:
    for two, plain in T.LIGATURES:
        x = f"replace({x}, '{two}', '{plain}')"
    return f"trim(regexp_replace(regexp_replace(lower(translate({x}, '{T.LETTERS}', '{T.BASES}')), '\\p{{M}}+', '', 'g'), '[^0-9a-z]+', ' ', 'g'))"


def sql_company(x: str) -> str:
    """Legal forms as whole words: words are set apart by two spaces, so each phrase has ends of its own."""
    out = f"' ' || replace({sql_fold(x)}, ' ', '  ') || ' '"
    for phrase in sorted(T.LEGAL_FORMS, key=len, reverse=True):
        out = f"replace({out}, ' {phrase.replace(' ', '  ')} ', '   ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def sql_weighted(x: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"CAST(substr({x}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights)) + ")"


NIP = f"({sql_weighted('ten', (6, 5, 7, 2, 3, 4, 5, 6, 7))} % 11 = CAST(substr(ten, 10, 1) AS INT) AND ten <> '0000000000')"
NINE = lambda x: f"({sql_weighted(x, (8, 9, 2, 3, 4, 5, 6, 7))} % 11 % 10 = CAST(substr({x}, 9, 1) AS INT))"
FOURTEEN = f"({NINE('fourteen')} AND {sql_weighted('fourteen', (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8))} % 11 % 10 = CAST(substr(fourteen, 14, 1) AS INT))"


def normalize_names(spark, sf_dir):
    return frame(spark, sf_dir, NAMES).select("k", T.fold(F.col("name")).alias("folded"), T.company_name(F.col("name")).alias("normalized"))


def fold_documents(spark, sf_dir):
    return frame(spark, sf_dir, DOC_WORDS).select("k", T.fold(F.col("name")).alias("folded"))


def blocking_keys(spark, sf_dir):
    names = frame(spark, sf_dir, NAMES)
    parts = T.person_parts(F.lit("Kowalski, Jan Andrzej"))
    return names.select("k", T.company_block(F.col("name")).alias("company_key"), T.person_block(parts["first"], parts["last"], (F.col("k") % 3 * 1000).cast("int")).alias("person_key"))


def nip_checksum(spark, sf_dir):
    return frame(spark, sf_dir, CODES).select("k", T.is_nip(F.col("ten")).alias("valid"))


def regon_checksum(spark, sf_dir):
    return frame(spark, sf_dir, CODES).select("k", T.is_regon(F.col("nine")).alias("nine"), T.is_regon(F.col("fourteen")).alias("fourteen"))


def id_classifier(spark, sf_dir):
    c = frame(spark, sf_dir, CODES)
    return c.select("k", T.identifier_scheme(F.col("ten")).alias("ten"), T.identifier_scheme(F.col("nine")).alias("nine"), T.is_krs(F.col("ten")).alias("krs_shape"))


def address_format(spark, sf_dir):
    c = frame(spark, sf_dir, PLACES)
    return c.select("k", T.address_line(*[F.col(x) for x in ("street", "building", "unit", "postal", "city")]).alias("address"))


ADDRESS = """concat_ws(', ', nullif(trim(CASE WHEN coalesce(building, '') <> '' THEN trim(street || ' ' || building) || coalesce('/' || unit, '') WHEN unit IS NOT NULL THEN trim(street || ' ' || unit) ELSE street END), ''),
  nullif(concat_ws(' ', postal, city), ''))"""


def address_keys(spark, sf_dir):
    c = frame(spark, sf_dir, PLACES)
    return c.select("k", T.natural_key(F.col("line")).alias("natural"), T.point_key(F.col("city"), F.concat(F.lit("ul. "), "street"), F.coalesce("building", F.lit(""))).alias("point"))


def street_extract(spark, sf_dir):
    return frame(spark, sf_dir, PLACES).select("k", T.street_of(F.col("line"), F.col("city"), F.col("building")).alias("street"))


KIND = r"^(?i)(ul\.|ul\b|al\.|al\b|aleja|aleje|pl\.|plac|os\.|osiedle|rondo|skwer)\s*"
STREET = f"""WITH p AS ({PLACES}), a AS (SELECT *, CASE WHEN starts_with({sql_fold('line')}, {sql_fold('city')}) THEN trim(substr(line, length(city) + 1), ' ,') ELSE line END AS rest FROM p),
b AS (SELECT *, trim(regexp_replace(rest, '{KIND.replace("^(?i)", "(?i)^")}', '')) AS bare FROM a),
c AS (SELECT *, CASE WHEN building IS NOT NULL AND ends_with(lower(bare), lower(building)) THEN trim(substr(bare, 1, length(bare) - length(building)), ' ,/') ELSE bare END AS s FROM b)
SELECT k, CASE WHEN s = '' THEN line ELSE s END AS street FROM c"""


def person_names(spark, sf_dir):
    c = frame(spark, sf_dir, "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'NOWAK,  ' || c_name || ' MARIA' WHEN 1 THEN ' Jan  Maria ' || c_name ELSE c_name END AS name FROM customer")
    return c.select("k", T.person_parts(F.col("name")).alias("p")).select("k", F.col("p.first").alias("first_names"), F.col("p.last").alias("last_name"))


PERSONS = """WITH c AS (SELECT c_custkey AS k, trim(regexp_replace(CASE c_custkey % 3 WHEN 0 THEN 'NOWAK,  ' || c_name || ' MARIA' WHEN 1 THEN ' Jan  Maria ' || c_name ELSE c_name END, '\\s+', ' ', 'g')) AS n FROM customer)
SELECT k, CASE WHEN contains(n, ',') THEN trim(substr(n, instr(n, ',') + 1)) ELSE trim(left(n, length(n) - length(string_split(n, ' ')[-1]))) END AS first_names,
  CASE WHEN contains(n, ',') THEN trim(string_split(n, ',')[1]) ELSE string_split(n, ' ')[-1] END AS last_name FROM c"""

STATUS_TEXT = "SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'Aktywny' WHEN 1 THEN 'Wykreślony z rejestru' WHEN 2 THEN 'Działalność zawieszona' WHEN 3 THEN ' ' WHEN 4 THEN 'Prowadzona wyłącznie w formie spółki' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 4 = 0 THEN '1 234,5' || CAST(o_orderkey % 10 AS STRING) WHEN o_orderkey % 4 = 1 THEN 'brak' ELSE CAST(o_orderkey AS STRING) END AS a, CASE WHEN o_orderkey % 3 = 0 THEN '2020-02-0' || CAST(1 + o_orderkey % 9 AS STRING) || 'T10:00' WHEN o_orderkey % 3 = 1 THEN '0' || CAST(1 + o_orderkey % 9 AS STRING) || '.12.2019' ELSE 'x' END AS d, CAST(o_orderkey % 40 AS STRING) AS t FROM orders"


def registry_values(spark, sf_dir):
    r = frame(spark, sf_dir, STATUS_TEXT)
    return r.select("k", T.status_code(F.col("s")).alias("status"), T.amount(F.col("a")).alias("amount"), T.iso_date(F.col("d")).alias("iso"), T.any_date(F.col("d")).alias("day"), T.region_of(F.concat(F.lpad("t", 2, "0"), F.lit("12023"))).alias("region"), T.excel_date(F.col("k") % 40000 + 30000).alias("serial"))


VALUES = f"""WITH r AS ({STATUS_TEXT}) SELECT k, CASE WHEN trim(s) = '' THEN NULL WHEN lower(s) LIKE '%aktywn%' THEN 'active' WHEN lower(s) LIKE '%wykreślon%' THEN 'deleted' WHEN lower(s) LIKE '%zawieszon%' THEN 'suspended' WHEN lower(s) LIKE '%wyłącznie w formie spółki%' THEN 'partnership_only' ELSE 'unknown' END AS status,
  try_cast(replace(replace(a, ' ', ''), ',', '.') AS DECIMAL(20,2)) AS amount, try_cast(substr(d, 1, 10) AS DATE) AS iso, coalesce(CAST(try_strptime(d, '%d.%m.%Y') AS DATE), try_cast(substr(d, 1, 10) AS DATE)) AS day,
  CASE lpad(t, 2, '0') {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.REGIONS.items())} END AS region, DATE '1899-12-30' + CAST(k % 40000 + 30000 AS INT) AS serial FROM r"""


def notice_names(spark, sf_dir):
    p = frame(spark, sf_dir, "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN p_name || ', ul. Polna 3, Lublin' WHEN 1 THEN p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ', oddział' ELSE p_name || ', filia' END AS raw FROM part")
    return p.select("k", T.notice_name(F.col("raw")).alias("name"))


NOTICE = """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN p_name || ', ul. Polna 3, Lublin' WHEN 1 THEN p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type || ' ' || p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ', oddział' ELSE p_name || ', filia' END AS raw FROM part),
n AS (SELECT k, regexp_replace(raw, '(?i),\\s*(ul\\.|al\\.|pl\\.|os\\.|\\d{2}-\\d{3}).*$', '') AS name FROM p) SELECT k, trim(CASE WHEN length(name) > 80 THEN string_split(name, ',')[1] ELSE name END) AS name FROM n"""


def partnership_names(spark, sf_dir):
    s = frame(spark, sf_dir, "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Jan Nowak wspólnik spółki cywilnej ' || s_name || ' S.C.' WHEN 1 THEN 'Spółka cywilna - \"' || s_name || '\"' ELSE s_name END AS entry FROM supplier")
    return s.select("k", T.partnership_name(F.col("entry")).alias("name"), T.plural(F.col("k"), "firma", "firmy", "firm").alias("noun"))


PARTNERS = "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 < 2 THEN s_name END AS name, CASE WHEN s_suppkey = 1 THEN 'firma' WHEN s_suppkey % 10 BETWEEN 2 AND 4 AND s_suppkey % 100 NOT BETWEEN 12 AND 14 THEN 'firmy' ELSE 'firm' END AS noun FROM supplier"


def sequence_ratio(spark, sf_dir):
    n = frame(spark, sf_dir, "SELECT DISTINCT p_name AS a, p_type AS b FROM part")
    return n.select("a", "b", F.round(T.sequence_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def hashed_numbers(spark, sf_dir):
    return view(spark, sf_dir, "companies").select("entity_id", T.peppered_hash(F.concat(F.lit("1"), "nip"), "pepper").alias("hash"))


QUERIES = {
    "normalize_names": (normalize_names, f"SELECT k, {sql_fold('name')} AS folded, {sql_company('name')} AS normalized FROM ({NAMES}) n"),
    "fold_documents": (fold_documents, f"SELECT k, {sql_fold('name')} AS folded FROM ({DOC_WORDS}) n"),
    "blocking_keys": (blocking_keys, f"SELECT k, substr(replace({sql_company('name')}, ' ', ''), 1, 12) AS company_key, 'jan|kowalski' || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '|1000' ELSE '|2000' END AS person_key FROM ({NAMES}) n"),
    "nip_checksum": (nip_checksum, f"SELECT k, {NIP} AS valid FROM ({CODES}) c"),
    "regon_checksum": (regon_checksum, f"SELECT k, {NINE('nine')} AS nine, {FOURTEEN} AS fourteen FROM ({CODES}) c"),
    "id_classifier": (id_classifier, f"SELECT k, CASE WHEN starts_with(ten, '0') THEN 'krs' WHEN {NIP} THEN 'nip' END AS ten, CASE WHEN {NINE('nine')} THEN 'regon' END AS nine, true AS krs_shape FROM ({CODES}) c"),
    "address_format": (address_format, f"SELECT k, {ADDRESS} AS address FROM ({PLACES}) p"),
    "address_keys": (address_keys, f"SELECT k, replace({sql_fold('line')}, ' ', '') AS \"natural\", {sql_fold('city')} || '|' || {sql_fold('street')} || '|' || {sql_fold(chr(39) * 2 + ' || coalesce(building, ' + chr(39) * 2 + ')')} AS point FROM ({PLACES}) p"),
    "street_extract": (street_extract, STREET),
    "person_names": (person_names, PERSONS),
    "registry_values": (registry_values, VALUES),
    "notice_names": (notice_names, NOTICE),
    "partnership_names": (partnership_names, PARTNERS),
    "sequence_ratio": (sequence_ratio, None),
    "hashed_numbers": (hashed_numbers, None),
}
QUERIES = {k: (f, with_views(sql) if sql else None) for k, (f, sql) in QUERIES.items()}
