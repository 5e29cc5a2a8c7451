"""Registry queries do the whole job: against brute force in Python, over rows and texts that a cut would leave out."""

import glob
import os
import re
from collections import defaultdict
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq

from ledgerlink.operators import graph as G
from ledgerlink.plans import registry
from ledgerlink.sources.adapters import view

DATA = "/root/testdata/sf0.001"
TABLES = {os.path.basename(f)[:-8]: f for f in glob.glob(f"{DATA}/*.parquet")}


def rows(table):
    return pq.read_table(TABLES[table]).to_pylist()


def test_fold_documents_folds_whole_texts(spark, tmp_path):
    letters = str.maketrans("ąćęłńóśźż", "acelnoszz")
    texts = [None, "", "Zażółć, GĘŚLĄ jaźń! " * 3, "Straße 1\n" * 500 + "ostatnie SŁOWO", "x" * 399 + " y z"]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), tmp_path / "documents.parquet")
    want = {i: None if t is None else " ".join(re.findall("[0-9a-z]+", t.lower().translate(letters).replace("ß", "ss"))) for i, t in enumerate(texts)}
    got = {r["k"]: r["folded"] for r in registry.queries()["fold_documents"](spark, str(tmp_path)).collect()}
    assert got == want and got[3].endswith("ostatnie slowo")


def test_shared_addresses_keeps_all_entities_and_large_addresses(spark):
    ordered = {r["o_custkey"] for r in rows("orders")}
    at = defaultdict(set)
    for r in rows("customer"):
        if r["c_custkey"] in ordered:
            at[f"N{r['c_nationkey']}"].add(f"C{r['c_custkey']}")
    for r in rows("supplier"):
        at[f"N{r['s_nationkey']}"].add(f"S{r['s_suppkey']}")
    want = {(e, a, len(es)) for a, es in at.items() if len(es) > 1 for e in es}
    got = [tuple(r) for r in registry.queries()["shared_addresses"](spark, DATA).select("entity", "address", "entities").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {x[0][0] for x in got} == {"C", "S"}


def test_sharing_address_has_no_largest_group(spark):
    # 300 at one address, one of them twice; a pair; one alone; a fact no longer known.
    links = [(f"e{i}", "big") for i in range(300)] + [("e0", "big"), ("p", "pair"), ("q", "pair"), ("r", "alone")]
    edges = spark.createDataFrame([(*x, "registered_at", None) for x in links] + [("s", "alone", "registered_at", "2003-01-01")], "source_id string, target_id string, relationship_type string, superseded_on string")
    got = {tuple(r) for r in G.sharing_address(edges).collect()}
    assert got == {(f"e{i}", "big", 300) for i in range(300)} | {("p", "pair", 2), ("q", "pair", 2)}


def test_resolve_by_identifier_takes_all_identifiers(spark):
    keys = {r["c_custkey"] for r in rows("customer")}
    want = {}
    for k in keys:
        nip = None if k % 7 == 3 else k + 1 if k % 7 == 5 else k
        if k % 10 == 0:
            want[k] = (f"C{k}", "krs")
        elif nip in keys:
            want[k] = (f"C{nip}", "nip")
    got = {r["record_id"]: (r["entity_id"], r["scheme"]) for r in registry.queries()["resolve_by_identifier"](spark, DATA).collect()}
    assert got == want and 0 < len(want) < len(keys)


def test_geocode_match_takes_all_points(spark):
    fold = lambda x: " ".join(re.findall("[0-9a-z]+", x.lower()))
    key = lambda r, brand: "|".join(map(fold, (r["p_type"], r["p_name"], brand)))
    part = sorted(rows("part"), key=lambda r: r["p_partkey"])
    points = defaultdict(dict)
    for r in part:
        region = "mazowieckie" if r["p_size"] % 3 == 0 else "pomorskie"
        points[key(r, r["p_brand"] + " bis" * (r["p_partkey"] % 5 == 0))].setdefault(region, (r["p_partkey"] % 5000, r["p_size"]))
    want = set()
    for r in part:
        name, k = f"A{r['p_partkey']}", key(r, r["p_brand"])
        region = (None if len(name) % 2 else {0: "mazowieckie", 1: "pomorskie"}.get(r["p_size"] % 3))
        at = points.get(k, {})
        hit = at.get(region) if region else next(iter(at.values())) if len(at) == 1 else None
        if hit:
            want.add((name, k, *hit))
    got = [tuple(r) for r in registry.queries()["geocode_match"](spark, DATA).select("entity_id", "match_key", "lat", "lon").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {int(x[0][1:]) % 2 for x in want} == {0, 1} and len(want) < len(part)


def test_close_missing_takes_all_companies(spark):
    facts = view(spark, DATA, "relationships").collect()
    companies = {f"C{r['c_custkey']}" for r in rows("customer")}
    gone = {r["id"] for r in facts if r["superseded_on"] is None and r["valid_to"] is None and r["confidence"] == "medium" and r["target_id"] in companies}
    want = {(r["id"], *(("2004-01-01",) * 2 if r["id"] in gone else (str(r["valid_to"]), str(r["superseded_on"])))) for r in facts}
    got = [(r["id"], str(r["valid_to"]), str(r["superseded_on"])) for r in registry.queries()["close_missing"](spark, DATA).collect()]
    assert len(got) == len(facts) and set(got) == want
    assert any(int(r["target_id"][1:]) > 100 for r in facts if r["id"] in gone)


def test_financials_takes_all_entities(spark):
    want = defaultdict(Decimal)
    for r in rows("orders"):
        want[r["o_custkey"], r["o_orderdate"].year] += Decimal(str(r["o_totalprice"])).quantize(Decimal("0.01"))
    got = {(r["entity_id"], r["period"]): r["revenue"] for r in registry.queries()["financials"](spark, DATA).collect()}
    assert got == want and len({k[0] for k in got}) > 3


def test_edge_orientation_takes_all_edges(spark):
    facts = view(spark, DATA, "relationships").collect()
    want = sorted((r["id"], way, r["relationship_type"], r["source_id"], r["target_id"]) for r in facts for way in ("in", "out"))
    got = registry.queries()["edge_orientation"](spark, DATA).select("id", "direction", "relationship_type", "source_id", "target_id").collect()
    assert sorted(map(tuple, got)) == want
