"""The catalogue's own queries: those with SQL against it, and contracts of the others, on the smallest tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest

from ledgerlink.llm import catalogue, decontaminate, tokens, toxicity
from ledgerlink.llm.chars import folded

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql_twins(spark, con, name):
    got = catalogue.queries()[name](spark, DATA)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = collections.Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == collections.Counter(tuple(plain(x) for x in r) for r in want.fetchall())


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, text, source FROM documents").fetchall()


def test_op2(spark, documents):
    """Sizes, targets by hand, and words near their targets."""
    sizes = collections.Counter()
    for _, t, s in documents:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal, open_, left = {}, set(order), float(sum(sizes.values()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        goal |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    goal |= share
    rows = catalogue.op2_source_mixing(spark, DATA).collect()
    own, taken = {d: (len(WORD.findall(t or "")), s) for d, t, s in documents}, collections.Counter()
    assert sorted(r["doc_id"] for r in rows) == sorted(own)
    for r in rows:
        size, source = own[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, sizes[source]) and 0 <= r["taken"] <= 3 * size
        assert math.isclose(r["target"], goal[source], rel_tol=1e-9)
        taken[source] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 2 + goal[s] / 20 for s in goal)
    assert sorted(rows) == sorted(catalogue.op2_source_mixing(spark, DATA).collect())


def test_op3(spark, documents):
    rows, load = catalogue.op3_virtual_slot_sharding(spark, DATA).collect(), collections.Counter()
    data = {d: (t or "").encode() for d, t, _ in documents}
    assert sorted(r["doc_id"] for r in rows) == sorted(data)
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data[r["doc_id"]]) + 1, zlib.crc32(data[r["doc_id"]]), "bytes", None)
        load[r["shard"]] += r["size"]
    places = collections.defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert sorted(places) == list(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    heaviest = max(len(t) + 1 for t in data.values())
    assert max(load.values()) <= max(1.02 * sum(load.values()) / 8, heaviest) + 200


def test_op6(spark, documents):
    index = catalogue.op6_token_shards(spark, DATA).collect()
    with open(tokens.VOCABULARY, "rb") as f:
        bpe = tokens.encoder(f.read(), tokens.PATTERN)
    assert sum(r["n_tokens"] for r in index) == sum(len(bpe.encode_ordinary(t)) + 1 for _, t, _ in documents if t)
    assert sorted(r["slot"] for r in index) == list(range(len(index)))


def test_op7(spark, documents):
    first, want = {}, collections.Counter()
    texts = sorted((d, (t or "").encode()) for d, t, _ in documents)
    for d, b in texts:
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], d)
    for d, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < d:
                gone[j : j + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone) if not g)
        want[d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in catalogue.op7_suffix_array_dedup(spark, DATA).collect()) == want


def test_op9(spark, con, documents):
    """Items that stand in a text word for word are found, with no edits."""
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = {(d, i) for d, t, _ in documents for i, x in items if folded(x) and folded(x) in folded(t)}
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in catalogue.op9_benchmark_decontamination(spark, DATA).collect()}
    assert want and {k for k, e in found.items() if e == 0} == want
    assert all(e <= decontaminate.budget(len(folded(dict(items)[i]))) for (_, i), e in found.items())


def test_op10(spark, con):
    """Recall and precision on held-out labels of a larger table; some eight of its labels are not borne out by the texts."""
    data = DATA.replace("0.001", "0.1")
    toxic = dict(con.execute(f"SELECT doc_id, toxic FROM '{data}/labels.parquet'").fetchall())
    rows = catalogue.op10_toxicity(spark, data).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    hits = sum(r["predicted"] for r in held if toxic[r["doc_id"]])
    assert hits >= 0.9 * sum(toxic[r["doc_id"]] for r in held) and hits >= 0.9 * sum(r["predicted"] for r in held)
    assert toxicity.SAMPLE == (1500, 2500)
