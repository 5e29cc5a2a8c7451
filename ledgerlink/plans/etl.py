"""Loading, merging, resolution, quality, queue and streaming queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlink.functions import text as T
from ledgerlink.operators import changes, loading, quality, resolve
from ledgerlink.plans.graph import tables
from ledgerlink.sources import registry as landed
from ledgerlink.sources.adapters import frame, view, with_views
from ledgerlink.streaming import windows

NOW = "1998-06-30 00:00:00"


def doc_content_dedup(spark, sf_dir):
    docs = view(spark, sf_dir, "raw_documents")
    stored = docs.filter("id < 300").withColumn("sha256", F.sha2("payload", 256))
    return loading.new_documents(docs.filter("id >= 300"), stored).select("id", "source", "external_id", "sha256")


CONTENT = """WITH d AS (SELECT *, sha256(payload) AS sha256 FROM raw_documents), n AS (SELECT * FROM d WHERE id >= 300 QUALIFY row_number() OVER (PARTITION BY source, external_id, sha256 ORDER BY id) = 1)
SELECT id, source, external_id, sha256 FROM n WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id < 300 AND d.source = n.source AND d.external_id = n.external_id AND d.sha256 = n.sha256)"""


def dedupe_last(spark, sf_dir):
    return loading.keep_last(frame(spark, sf_dir, "SELECT event_id, user_id, event_type, value FROM events"), ["user_id", "event_type"], "event_id")


def upsert_financials(spark, sf_dir):
    f = view(spark, sf_dir, "financials")
    new = f.filter("period >= 1998").withColumn("revenue", (F.col("revenue") * 2).cast("decimal(20,2)"))
    return loading.upsert(f.filter("period <= 1998"), new, ["entity_id", "period"], "ordinal").select("entity_id", "period", "revenue")


def insert_new(spark, sf_dir):
    rows = frame(spark, sf_dir, "SELECT event_id, user_id, event_type FROM events")
    return loading.insert_new(rows.filter("event_id < 100").dropDuplicates(["user_id", "event_type"]).filter("user_id < 0"), rows, ["user_id", "event_type"], "event_id")


def update_keep_old(spark, sf_dir):
    c = view(spark, sf_dir, "companies")
    new = c.filter("share_capital > 0").select("entity_id", F.when(F.col("share_capital") > 5000, F.lit("verified")).alias("status"))
    return loading.fill_from(c.select("entity_id", "nip", "status"), new, "entity_id", ["status"])


def _second_snapshot(live):
    return live.filter("relationship_type = 'contractor_of' and confidence = 'registered'").withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.lit("2001-06-30").cast("date")).otherwise(F.col("valid_to"))).withColumn("id", F.concat(F.lit("n"), "id"))


def bitemporal_upsert(spark, sf_dir):
    r = view(spark, sf_dir, "relationships")
    out = loading.bitemporal_upsert(r, _second_snapshot(r), "2004-01-01")
    return out.select("id", "source_id", "target_id", "valid_from", "valid_to", "recorded_on", "superseded_on", "action")


BITEMPORAL = """WITH n AS (SELECT * REPLACE ('n' || id AS id, coalesce(valid_to, DATE '2001-06-30') AS valid_to) FROM relationships WHERE relationship_type = 'contractor_of' AND confidence = 'registered'),
j AS (SELECT o.*, n.id AS nid, n.valid_to AS nto FROM relationships o LEFT JOIN n ON o.superseded_on IS NULL AND o.source_id = n.source_id AND o.target_id = n.target_id AND o.relationship_type = n.relationship_type AND o.valid_from IS NOT DISTINCT FROM n.valid_from)
SELECT id, source_id, target_id, valid_from, valid_to, recorded_on, CASE WHEN nid IS NOT NULL AND valid_to IS DISTINCT FROM nto THEN DATE '2004-01-01' ELSE superseded_on END AS superseded_on,
  CASE WHEN nid IS NOT NULL AND valid_to IS DISTINCT FROM nto THEN 'closed' ELSE 'kept' END AS action FROM j
UNION ALL SELECT id, source_id, target_id, valid_from, valid_to, DATE '2004-01-01', NULL, 'added' FROM n WHERE NOT EXISTS (SELECT 1 FROM relationships o WHERE o.superseded_on IS NULL AND o.source_id = n.source_id AND o.target_id = n.target_id AND o.relationship_type = n.relationship_type AND o.valid_from IS NOT DISTINCT FROM n.valid_from AND o.valid_to IS NOT DISTINCT FROM n.valid_to)"""


def close_missing(spark, sf_dir):
    r = view(spark, sf_dir, "relationships")
    roots = frame(spark, sf_dir, "SELECT 'C' || CAST(c_custkey AS STRING) AS id FROM customer")
    out = loading.close_missing(r, roots, r.filter("confidence <> 'medium'").select("id"), "2004-01-01")
    return out.select("id", "valid_to", "superseded_on")


CLOSE = """WITH g AS (SELECT id FROM relationships WHERE superseded_on IS NULL AND valid_to IS NULL AND confidence = 'medium' AND target_id IN (SELECT 'C' || CAST(c_custkey AS VARCHAR) FROM customer))
SELECT r.id, CASE WHEN g.id IS NOT NULL THEN DATE '2004-01-01' ELSE valid_to END AS valid_to, CASE WHEN g.id IS NOT NULL THEN DATE '2004-01-01' ELSE superseded_on END AS superseded_on FROM relationships r LEFT JOIN g ON g.id = r.id"""


def merge_groups(spark, sf_dir):
    g = loading.address_groups(view(spark, sf_dir, "addresses"))
    return g.select("city", "street", "building", "n", "regions", "survivor", F.array_join("members", ",").alias("members"))


GROUPS = """SELECT lower(city) AS city, lower(street) AS street, lower(building) AS building, count(*) AS n, count(DISTINCT voivodeship) AS regions, (array_agg(entity_id ORDER BY degree DESC, (postal_code IS NULL), entity_id))[1] AS survivor,
  string_agg(entity_id, ',' ORDER BY degree DESC, (postal_code IS NULL), entity_id) AS members FROM addresses WHERE city IS NOT NULL AND street <> '' AND building IS NOT NULL GROUP BY lower(city), lower(street), lower(building), lower(coalesce(unit, '')) HAVING count(*) > 1"""
#: Edges of customers to addresses of parts, so that merges have something to move.
PART_EDGES = """SELECT 'E' || CAST(c_custkey AS STRING) AS id, 'C' || CAST(c_custkey AS STRING) AS source_id, 'A' || CAST(1 + c_custkey % (SELECT count(*) FROM part) AS STRING) AS target_id, 'registered_at' AS relationship_type,
  CAST(NULL AS DATE) AS valid_from, CAST(NULL AS DATE) AS valid_to, CAST('2002-01-01' AS DATE) AS recorded_on, CAST(NULL AS DATE) AS superseded_on FROM customer"""


def _mapping(spark, sf_dir):
    return loading.merge_map(loading.address_groups(view(spark, sf_dir, "addresses")))


def merge_log(spark, sf_dir):
    return loading.merge_log(_mapping(spark, sf_dir), "same place")


MAPPING = f"SELECT unnest(string_split(members, ',')[2:]) AS merged_id, survivor AS survivor_id FROM ({GROUPS}) g WHERE regions <= 1"


def merge_moved_edges(spark, sf_dir):
    out = loading.move_edges(frame(spark, sf_dir, PART_EDGES), _mapping(spark, sf_dir), "2004-01-01")
    return out.select("id", "source_id", "target_id", "recorded_on", "superseded_on", "action")


MOVED = f"""WITH m AS ({MAPPING}), e AS ({PART_EDGES}) SELECT e.id, source_id, target_id, recorded_on, CASE WHEN m.merged_id IS NOT NULL THEN DATE '2004-01-01' END AS superseded_on, CASE WHEN m.merged_id IS NOT NULL THEN 'closed' ELSE 'kept' END AS action FROM e LEFT JOIN m ON m.merged_id = e.target_id
UNION ALL SELECT e.id || '''', source_id, survivor_id, DATE '2004-01-01', NULL, 'added' FROM e JOIN m ON m.merged_id = e.target_id"""


#: A record for each company with all its identifiers; of some the NIP is unknown, of some another company's.
RECORDS = """SELECT CAST(value AS BIGINT) AS record_id, scheme, CASE WHEN scheme = 'nip' AND CAST(value AS BIGINT) % 7 = 3 THEN '9' || substr(value, 2)
  WHEN scheme = 'nip' AND CAST(value AS BIGINT) % 7 = 5 THEN lpad(CAST(CAST(value AS BIGINT) + 1 AS STRING), 10, '0') ELSE value END AS value FROM identifiers"""


def resolve_by_identifier(spark, sf_dir):
    return resolve.by_identifier(frame(spark, sf_dir, RECORDS), view(spark, sf_dir, "identifiers"))


RESOLVED = f"""WITH r AS ({RECORDS})
SELECT record_id, i.entity_id, i.scheme FROM r JOIN identifiers i ON i.scheme = r.scheme AND i.value = r.value QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY CASE i.scheme WHEN 'krs' THEN 1 ELSE 2 END, i.entity_id) = 1"""


def resolve_or_create(spark, sf_dir):
    r = frame(spark, sf_dir, "SELECT p_partkey AS record_id, 'nip' AS scheme, lpad(CAST(p_partkey * 3 AS STRING), 10, '0') AS value, lower(p_name || p_brand) AS natural_key FROM part")
    natural = r.filter("record_id % 2 = 0").groupBy("natural_key").agg(F.min(F.concat(F.lit("A"), "record_id")).alias("entity_id"))
    return resolve.resolve_or_create(r, view(spark, sf_dir, "identifiers"), natural)


CREATED = """WITH r AS (SELECT p_partkey AS record_id, lpad(CAST(p_partkey * 3 AS VARCHAR), 10, '0') AS value, lower(p_name || p_brand) AS natural_key FROM part),
n AS (SELECT natural_key, min('A' || record_id) AS b FROM r WHERE record_id % 2 = 0 GROUP BY 1)
SELECT record_id, coalesce(i.entity_id, n.b, 'new-' || substr(sha256(natural_key), 1, 16)) AS entity_id, CASE WHEN i.entity_id IS NOT NULL THEN 'identifier' WHEN n.b IS NOT NULL THEN 'natural_key' ELSE 'created' END AS how
FROM r LEFT JOIN identifiers i ON i.scheme = 'nip' AND i.value = r.value LEFT JOIN n USING (natural_key)"""


def attach_identifiers(spark, sf_dir):
    ids = view(spark, sf_dir, "identifiers")
    return resolve.attach(ids.filter("scheme = 'nip'"), ids.withColumn("entity_id", F.concat(F.lit("X"), "entity_id")))


def pair_scores(spark, sf_dir):
    p = frame(spark, sf_dir, "SELECT p_partkey AS id, p_name || p_brand AS blocking_key, p_size AS year, p_type AS place FROM part")
    pairs = resolve.candidates(p)
    a, b = (p.select(F.col("id").alias(x), F.col("year").alias(f"y{x}"), F.col("place").alias(f"p{x}")) for x in "ab")
    j = pairs.join(a, "a").join(b, "b")
    score = resolve.person_score(F.lit(0.5) + (F.col("a") + F.col("b")) % 6 / 10.0, F.col("ya") == F.col("yb"), F.col("pa") == F.col("pb"), (F.col("a") % 4).cast("int"))
    return j.select("a", "b", F.round(score, 4).alias("score"), resolve.decision(F.round(score, 9)).alias("decision"))


PAIRS = """WITH p AS (SELECT p_partkey AS id, p_name || p_brand AS k, p_size AS y, p_type AS t FROM part),
s AS (SELECT a.id AS a, b.id AS b, least(0.7::DOUBLE * (0.5::DOUBLE + ((a.id + b.id) % 6) / 10.0::DOUBLE) + CASE WHEN a.y = b.y THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN a.t = b.t THEN 0.10::DOUBLE ELSE 0 END + least(0.10::DOUBLE, 0.05::DOUBLE * (a.id % 4)), 1.0::DOUBLE) AS v FROM p a JOIN p b ON a.k = b.k AND a.id < b.id)
SELECT a, b, round(v, 4) AS score, CASE WHEN round(v, 9) >= 0.92::DOUBLE THEN 'match' WHEN round(v, 9) >= 0.75::DOUBLE THEN 'review' ELSE 'no_match' END AS decision FROM s"""


def agreed_names(spark, sf_dir):
    n = frame(spark, sf_dir, "SELECT l_suppkey AS entity_id, CASE WHEN l_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, l_orderkey * 100 + p_partkey AS ordinal FROM lineitem JOIN part ON p_partkey = l_partkey")
    return resolve.agreed_name(n)


AGREED = """WITH n AS (SELECT l_suppkey AS e, CASE WHEN l_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, l_orderkey * 100 + p_partkey AS o FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT e, lower(name) AS low, count(*) AS k, min(struct_pack(o := o, name := name)) AS f FROM n GROUP BY 1, 2) SELECT e AS entity_id, f.name AS name FROM c QUALIFY row_number() OVER (PARTITION BY e ORDER BY k DESC, f.o) = 1"""


def geocode_match(spark, sf_dir):
    a = view(spark, sf_dir, "addresses").select("entity_id", T.point_key(F.col("city"), F.col("street"), F.col("building")).alias("match_key"), F.when(F.expr("length(entity_id) % 2 = 0"), F.col("voivodeship")).alias("voivodeship"))
    p = frame(spark, sf_dir, "SELECT p_partkey AS id, p_type AS city, p_name AS street, CASE WHEN p_partkey % 5 = 0 THEN p_brand || ' bis' ELSE p_brand END AS building, CASE p_size % 3 WHEN 0 THEN 'mazowieckie' ELSE 'pomorskie' END AS voivodeship, p_partkey % 5000 AS lat, p_size AS lon FROM part")
    points = p.select("id", T.point_key(F.col("city"), F.col("street"), F.col("building")).alias("match_key"), "voivodeship", "lat", "lon")
    return loading.geocoded(a, points)


def _geocode_sql() -> str:
    from ledgerlink.plans.text import sql_fold

    key = lambda c, s, b: f"{sql_fold(c)} || '|' || {sql_fold(s)} || '|' || {sql_fold(b)}"
    return f"""WITH a AS (SELECT entity_id, {key('city', 'street', 'building')} AS match_key, CASE WHEN length(entity_id) % 2 = 0 THEN voivodeship END AS voivodeship FROM addresses),
p AS (SELECT {key('p_type', 'p_name', "CASE WHEN p_partkey % 5 = 0 THEN p_brand || ' bis' ELSE p_brand END")} AS match_key, CASE p_size % 3 WHEN 0 THEN 'mazowieckie' ELSE 'pomorskie' END AS voivodeship, p_partkey % 5000 AS lat, p_size AS lon, p_partkey AS id FROM part),
u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY match_key, voivodeship ORDER BY id) = 1), s AS (SELECT match_key FROM u GROUP BY 1 HAVING count(*) = 1)
SELECT entity_id, a.match_key, lat, lon FROM a JOIN u ON u.match_key = a.match_key AND (u.voivodeship = a.voivodeship OR (a.voivodeship IS NULL AND u.match_key IN (SELECT match_key FROM s)))"""


def _checked(spark, sf_dir):
    _, entities = tables(spark, sf_dir)
    ids = view(spark, sf_dir, "identifiers")
    return {"entities": entities.withColumn("degree", F.when(F.col("id") == "C5", F.lit(1)).otherwise(F.col("degree"))), "relationships": view(spark, sf_dir, "relationships"), "addresses": view(spark, sf_dir, "addresses"), "provenance": view(spark, sf_dir, "provenance"), "identifiers": ids.unionByName(ids.filter("scheme = 'krs'").withColumn("value", F.concat(F.lit("9"), F.substring("value", 2, 9))))}


def check_query(name):
    def run(spark, sf_dir):
        return quality.CHECKS[name].violations(_checked(spark, sf_dir))

    return run


def dq_report(spark, sf_dir):
    return quality.report(_checked(spark, sf_dir), deep=True)


DQ = {
    "entity_holds_one_identifier_per_scheme": "SELECT entity_id AS subject FROM identifiers WHERE scheme = 'krs' AND entity_id IN (SELECT id FROM entities WHERE merged_into_id IS NULL)",
    "one_address_row_per_physical_address": "SELECT lower(city) || ' ' || lower(street) || ' ' || lower(building) AS subject FROM addresses GROUP BY lower(city), lower(street), lower(building) HAVING count(*) > 1 AND count(DISTINCT voivodeship) <= 1",
    "relationship_has_provenance": "SELECT id AS subject FROM relationships r WHERE NOT EXISTS (SELECT 1 FROM provenance p WHERE p.relationship_id = r.id)",
    "company_is_not_registered_at_many_addresses": "SELECT source_id AS subject FROM relationships WHERE relationship_type = 'registered_at' AND superseded_on IS NULL AND source_id IN (SELECT id FROM entities WHERE merged_into_id IS NULL) GROUP BY source_id HAVING count(*) > 12",
    "superseded_fact_is_not_older_than_its_record": "SELECT id AS subject FROM relationships WHERE superseded_on < recorded_on",
    "entity_has_a_display_name": "SELECT id AS subject FROM entities WHERE merged_into_id IS NULL AND (display_name IS NULL OR trim(display_name) = '')",
    "merged_entity_has_no_active_edges": "SELECT id AS subject FROM entities WHERE merged_into_id IS NOT NULL AND id IN (SELECT id FROM degrees)",
    "degree_matches_actual_edge_count": "SELECT e.id AS subject FROM entities e JOIN degrees d ON d.id = e.id WHERE (CASE WHEN e.id = 'C5' THEN 1 ELSE d.degree END) <> d.degree",
}
REPORT = " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) AS violations, {quality.CHECKS[n].threshold} AS threshold, count(*) <= {quality.CHECKS[n].threshold} AS passed, coalesce((SELECT string_agg(subject, ',' ORDER BY subject) FROM (SELECT subject FROM ({sql}) ORDER BY subject LIMIT 5)), '') AS sample FROM ({sql}) x" for n, sql in DQ.items())


def queue_claim(spark, sf_dir):
    return changes.claim(view(spark, sf_dir, "tasks"), 2, NOW, 50).select("id", "status", "attempts")


CLAIM = f"""WITH c AS (SELECT id FROM tasks WHERE source = 2 AND status = 'pending' AND scheduled_for <= TIMESTAMP '{NOW}' ORDER BY priority DESC, scheduled_for, id LIMIT 50)
SELECT t.id, CASE WHEN c.id IS NOT NULL THEN 'running' ELSE status END AS status, CAST(attempts + CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM tasks t LEFT JOIN c ON c.id = t.id"""


def queue_after_failure(spark, sf_dir):
    t = view(spark, sf_dir, "tasks")
    return changes.after_failure(t, t.filter("status = 'running'"), NOW, 600).select("id", "status", "scheduled_for")


def queue_after_success(spark, sf_dir):
    t = view(spark, sf_dir, "tasks")
    return changes.after_success(t, t.filter("id % 3 = 0")).select("id", "status", "attempts")


def queue_stale(spark, sf_dir):
    t = view(spark, sf_dir, "tasks").withColumn("locked_at", F.when(F.col("status") == "running", F.col("scheduled_for")))
    return changes.release_stale(t, NOW, 86400 * 30).select("id", "status", "locked_at")


def queue_enqueue(spark, sf_dir):
    t = view(spark, sf_dir, "tasks").select("id", "source", "status")
    return changes.enqueue(t.filter("id % 3 = 0"), t, ["id", "source"])


def queue_stats(spark, sf_dir):
    return changes.queue_stats(view(spark, sf_dir, "tasks"))


def fetch_due(spark, sf_dir):
    return changes.stale_keys(frame(spark, sf_dir, "SELECT o_custkey AS key, o_orderdate AS ts FROM orders"), "2001-06-30 00:00:00", 400)


def request_batches(spark, sf_dir):
    b = changes.batches(frame(spark, sf_dir, "SELECT lpad(CAST(c_custkey AS STRING), 10, '0') AS key FROM customer"), 30)
    return b.select(F.explode("keys").alias("key"), (F.size("keys") <= 30).alias("fits"))


def snapshot_changes(spark, sf_dir):
    c = view(spark, sf_dir, "companies").select("entity_id", "status", "share_capital")
    new = c.withColumn("status", F.when(F.col("share_capital") < 0, F.lit("deleted")).otherwise(F.col("status"))).withColumn("share_capital", F.when(F.col("share_capital") > 9000, F.col("share_capital") + 1).otherwise(F.col("share_capital")).cast("decimal(18,2)"))
    return changes.snapshot_changes(c, new, ["status", "share_capital"], "2004-01-01").drop("on")


SNAPSHOT = """SELECT entity_id, 'status' AS field, status AS old_value, 'deleted' AS new_value FROM companies WHERE share_capital < 0 AND status IS DISTINCT FROM 'deleted'
UNION ALL SELECT entity_id, 'share_capital', CAST(share_capital AS VARCHAR), CAST(CAST(share_capital + 1 AS DECIMAL(18,2)) AS VARCHAR) FROM companies WHERE share_capital > 9000"""


def newest_reports(spark, sf_dir):
    c = frame(spark, sf_dir, "SELECT c_mktsegment AS name, c_custkey AS id, c_acctbal AS created_at FROM customer")
    return landed.newest_reports(c)


def fetch_costs(spark, sf_dir):
    c = frame(spark, sf_dir, "SELECT s_name AS name, s_suppkey * 1000 AS records, 20 AS page_size, CAST(1 + s_suppkey % 5 AS DOUBLE) AS rate_per_second, CAST(1 + s_suppkey % 3 AS DOUBLE) AS concurrency, CAST(0.5 AS DOUBLE) AS latency_seconds FROM supplier")
    return landed.fetch_costs(c).select("name", "hours")


def lei_closure(spark, sf_dir):
    """Ends of edges that are unknown while the other end is known."""
    r = view(spark, sf_dir, "relationships").filter("relationship_type = 'contractor_of'").select("source_id", "target_id")
    known = frame(spark, sf_dir, "SELECT 'C' || CAST(c_custkey AS STRING) AS id FROM customer WHERE c_custkey % 2 = 0")
    a = known.select(F.col("id").alias("source_id"), F.lit(True).alias("s"))
    b = known.select(F.col("id").alias("target_id"), F.lit(True).alias("t"))
    j = r.join(a, "source_id", "left").join(b, "target_id", "left").filter(F.col("s").isNull() != F.col("t").isNull())
    return j.select(F.when(F.col("s").isNull(), F.col("source_id")).otherwise(F.col("target_id")).alias("missing")).distinct()




def event_windows(spark, sf_dir):
    e = frame(spark, sf_dir, "SELECT event_id, user_id, event_type, ts, value FROM events")
    return windows.tumbling(e).select("start", "event_type", "n")


def event_sliding(spark, sf_dir):
    return windows.sliding(frame(spark, sf_dir, "SELECT event_type, ts FROM events"))


def event_sessions(spark, sf_dir):
    return windows.sessions(frame(spark, sf_dir, "SELECT user_id, ts FROM events"))


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, no"""

NOTICE = '{"items":[{"noticeNumber":"1","noticeType":"T","publicationDate":"2024-03-01T10:00:00Z","organizationName":"Gmina","organizationNationalId":"5252445170","contractors":[{"contractorName":"ALFA Sp. z o.o., ul. X 1","contractorNationalId":"525-24-45-170"},{"contractorName":"BETA S.A.","contractorNationalId":"7740001454"}]}]}'


def notice_mapper(spark, sf_dir):
    pages = spark.createDataFrame([(NOTICE,)], "j string").select(F.from_json("j", landed.NOTICES).alias("p")).select("p.*")
    return landed.notices(pages)[1].drop("attributes")


PERIODS = [("A", "B", "ACCOUNTING_PERIOD", "2020-01-01", "2020-12-31", "RELATIONSHIP_PERIOD", "2019-05-01T00:00:00Z", ""), ("C", "D", "ACCOUNTING_PERIOD", "2020-01-01", "2020-12-31", "", "", ""), ("E", "E", "", "", "", "", "", "")]


def relationship_period(spark, sf_dir):
    names = ["Relationship.StartNode.NodeID", "Relationship.EndNode.NodeID", *[f"Relationship.Period.{i}.{x}" for i in (1, 2) for x in ("periodType", "startDate", "endDate")]]
    rows = [(dict(zip(names, p)) | {"Relationship.RelationshipType": "IS_DIRECTLY_CONSOLIDATED_BY", "Relationship.RelationshipStatus": "ACTIVE"},) for p in PERIODS]
    return landed.lei_relationships(spark.createDataFrame(rows, "row map<string,string>")).select("source_key", "target_key", "valid_from", "valid_to", "locator")


SUBJECTS = '{"result":{"entries":[{"subjects":[{"nip":"5252445170","regon":"012345675","krs":"0000123456"}]},{"subjects":[{"nip":"1","regon":"012345675"}]}]}}'


def bridge_explode(spark, sf_dir):
    pages = spark.createDataFrame([(SUBJECTS,)], "j string").select(F.from_json("j", landed.WHITELIST).alias("p")).select("p.*")
    return landed.bridges(pages)


QUERIES = {
    "doc_content_dedup": (doc_content_dedup, CONTENT),
    "dedupe_last": (dedupe_last, "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"),
    "insert_new": (insert_new, "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type"),
    "upsert_financials": (upsert_financials, "SELECT entity_id, period, CAST(CASE WHEN period >= 1998 THEN revenue * 2 ELSE revenue END AS DECIMAL(20,2)) AS revenue FROM financials"),
    "update_keep_old": (update_keep_old, "SELECT entity_id, nip, CASE WHEN share_capital > 5000 THEN 'verified' ELSE status END AS status FROM companies"),
    "bitemporal_upsert": (bitemporal_upsert, BITEMPORAL),
    "close_missing": (close_missing, CLOSE),
    "merge_groups": (merge_groups, GROUPS),
    "merge_log": (merge_log, f"SELECT survivor_id, merged_id, CAST(1 AS DECIMAL(4,3)) AS score, 'same place' AS reason, 'auto' AS decided_by FROM ({MAPPING}) m"),
    "merge_moved_edges": (merge_moved_edges, MOVED),
    "resolve_by_identifier": (resolve_by_identifier, RESOLVED),
    "resolve_or_create": (resolve_or_create, CREATED),
    "attach_identifiers": (attach_identifiers, "SELECT entity_id, scheme, value FROM identifiers WHERE scheme = 'nip' UNION ALL SELECT 'X' || entity_id, scheme, value FROM identifiers WHERE scheme = 'krs'"),
    "pair_scores": (pair_scores, PAIRS),
    "agreed_names": (agreed_names, AGREED),
    "geocode_match": (geocode_match, _geocode_sql()),
    **{f"dq_{n}": (check_query(n), sql) for n, sql in DQ.items()},
    "dq_report": (dq_report, REPORT),
    "queue_claim": (queue_claim, CLAIM),
    "queue_after_failure": (queue_after_failure, f"SELECT id, CASE WHEN status = 'running' THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END ELSE status END AS status, CASE WHEN status = 'running' THEN TIMESTAMP '{NOW}' + INTERVAL 600 SECOND ELSE scheduled_for END AS scheduled_for FROM tasks"),
    "queue_after_success": (queue_after_success, "SELECT id, CASE WHEN status = 'running' AND id % 3 = 0 THEN 'done' ELSE status END AS status, attempts FROM tasks"),
    "queue_stale": (queue_stale, f"SELECT id, CASE WHEN status = 'running' AND scheduled_for < TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'pending' ELSE status END AS status, CASE WHEN status = 'running' AND scheduled_for >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN scheduled_for END AS locked_at FROM tasks"),
    "queue_enqueue": (queue_enqueue, "SELECT id, source, status FROM tasks"),
    "queue_stats": (queue_stats, "SELECT source, status, count(*) AS n FROM tasks GROUP BY source, status"),
    "fetch_due": (fetch_due, "SELECT o_custkey AS key, max(o_orderdate) AS last FROM orders GROUP BY 1 HAVING max(o_orderdate) <= TIMESTAMP '2001-06-30' - INTERVAL 400 DAY"),
    "request_batches": (request_batches, "SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key, true AS fits FROM customer"),
    "snapshot_changes": (snapshot_changes, SNAPSHOT),
    "newest_reports": (newest_reports, "SELECT c_mktsegment AS name, c_custkey AS id, c_acctbal AS created_at FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) = 1"),
    "fetch_costs": (fetch_costs, "SELECT s_name AS name, round(ceil(s_suppkey * 1000 / 20.0) / least(1.0 + s_suppkey % 5, (1.0 + s_suppkey % 3) / 0.5)::DOUBLE / 3600, 4)::DOUBLE AS hours FROM supplier"),
    "lei_closure": (lei_closure, "SELECT DISTINCT source_id AS missing FROM relationships WHERE relationship_type = 'contractor_of' AND CAST(substr(target_id, 2) AS BIGINT) % 2 = 0"),
    "event_windows": (event_windows, "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "event_sliding": (event_sliding, "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([CAST(date_trunc('day', ts) AS TIMESTAMP), CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 1 DAY]) AS s FROM events) e GROUP BY 1, 2"),
    "event_sessions": (event_sessions, SESSIONS),
    "notice_mapper": (notice_mapper, "SELECT 'nip:7740001454' AS source_key, 'nip:5252445170' AS target_key, 'contractor_of' AS relationship_type, 'T' AS role, DATE '2024-03-01' AS valid_from, DATE '2024-03-01' AS valid_to, 'bzp/1' AS locator"),
    "relationship_period": (relationship_period, "SELECT 'lei:B' AS source_key, 'lei:A' AS target_key, DATE '2019-05-01' AS valid_from, NULL::DATE AS valid_to, 'rr/A/IS_DIRECTLY_CONSOLIDATED_BY' AS locator UNION ALL SELECT 'lei:D', 'lei:C', NULL, NULL, 'rr/C/IS_DIRECTLY_CONSOLIDATED_BY'"),
    "bridge_explode": (bridge_explode, "SELECT '5252445170' AS nip, 'krs' AS scheme, '0000123456' AS value UNION ALL SELECT '5252445170', 'regon', '012345675'"),
}
QUERIES = {k: (f, with_views(sql)) for k, (f, sql) in QUERIES.items()}
