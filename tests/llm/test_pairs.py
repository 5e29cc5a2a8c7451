"""Near duplicates, repeated bytes, leaks, toxicity, archives and token shards against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlink.llm import decontaminate, jaccard, suffixes, tokens, toxicity, warc
from ledgerlink.llm.chars import folded
from ledgerlink.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, node long, n int"
EDGE = [(900, None, "a", 1, 1), (901, "", "a", 1, 1), (902, " \n", None, None, None), (903, "Ab", "a", 1, 1), (904, "aB", "b", 2, 2), (905, "one two", "a", 1, 1), (None, "nobody has an id here but words", "a", 1, 1), (906, "x " * 6000, "a", 1, 1)]


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # near copies of one text, more or less changed
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    passage = " ".join(word() for _ in range(30))
    for i in range(60, 110):
        w = [word() for _ in range(rng.randint(1, 80))]
        if i % 2:
            w.insert(rng.randrange(len(w) + 1), passage)
        rows.append((i, " ".join(w)))
    rows += [(i + 200, t) for i, t in rows[::4]] + [(7, rows[7][1]), (3, "another text under the same id")]
    return [(i, t, "s", 0, 0) for i, t in rows] + EDGE


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_components(rows, k, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low_id = {}
    for i, r in enumerate(rows):
        low_id[find(i)] = min((x for x in (low_id.get(find(i)), r[0]) if x is not None), default=None)
    return collections.Counter((r[0], len(sets[i]), low_id[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard(docs, rows, k, num):
    got = collections.Counter(tuple(r) for r in jaccard.join(docs, k, num, 100).collect())
    assert got == brute_components(rows, k, num, 100)


def test_jaccard_in_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_NODES", 8)
    assert collections.Counter(tuple(r) for r in jaccard.join(docs).collect()) == brute_components(rows, 3, 90, 100)


def test_one_of_each(spark, docs, rows):
    """Of each component the row of the smallest id stays; every row is told apart by id and text."""
    kept = collections.Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect())
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    groups, seen = [], set()
    for i in range(len(rows)):
        if i in seen or not sets[i]:
            continue
        seen.add(i)
        stack, group = [i], []
        while stack:
            at = stack.pop()
            group.append(at)
            found = [j for j in range(len(rows)) if j not in seen and sets[j] and 100 * len(sets[at] & sets[j]) >= 80 * len(sets[at] | sets[j])]
            seen.update(found)
            stack += found
        groups.append({(rows[j][0], rows[j][1]) for j in group})
    assert len(groups) == sum(kept[x] for g in groups for x in g)
    for g in groups:
        (one,) = [x for x in g if kept[x]]
        assert kept[one] == 1 and (one[0] is None) == all(x[0] is None for x in g)
        assert one[0] is None or one[0] == min(x[0] for x in g if x[0] is not None)
    assert sum(kept.values()) == len(groups) + sum(not s for s in sets)


def test_one_of_each_by_row(spark):
    a, b = "one two three four five six seven", "of quite another kind are these words here"
    own = spark.createDataFrame([(1, a, 1), (2, a, 2), (2, b, 3), (None, a, 4), (None, b + " x", 5), (None, None, 6), (7, "", 7), (7, "", 8)], "doc_id long, text string, h int")
    assert sorted(r["h"] for r in jaccard.one_of_each(own).collect()) == [1, 3, 6, 7, 8]


def test_jaccard_without_ids(spark):
    """Near copies without an id are compared by text: the work grows with their number."""
    text = " ".join(f"word{i}" for i in range(200))
    docs = spark.range(600).selectExpr("cast(null as long) doc_id", f"concat('{text}', ' end', id) text")
    assert jaccard.join(docs).groupBy("n_shingles", "component_id").count().collect() == [(199, None, 600)]
    assert jaccard.one_of_each(docs).count() == 1


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (3, 4), (7, 7), *[(20 + i, 21 + i) for i in range(30)]], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **{20 + i: 20 for i in range(31)}}


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks(spark):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, text(rng.randint(8, 30))) for i in range(8)] + [(8, None), (9, " ")]
    rows = [(0, None), (1, ""), (2, text(50))]
    for i in range(3, 30):
        p = list(rng.choice(items[:8])[1])
        for _ in range(rng.randint(0, len(p) // 8)):
            at = rng.randrange(len(p))
            p[at : at + rng.randint(0, 1)] = rng.choice(["z", "", "Q"])
        rows.append((i, text(10).upper() + "\n " + "".join(p) + "  " + text(5)))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in rows:
        for i, p in items[:8]:
            e = edits(folded(p), folded(t))
            if e <= decontaminate.budget(len(folded(p))):
                want[d, i] = e
    assert got == want and len(want) > 5


def test_leaks_of_short_items(spark):
    """Items of any length count: under q characters as whole words, under 2 q without edits."""
    items = [(1, "what is two plus two? four"), (2, "Yes"), (3, "blue sky"), (4, "twelve chars"), (5, ""), (6, None)]
    rows = [(1, "so: What is  two plus two? Four!"), (2, "yesterday, yes"), (3, "yesterday the blue skyline"), (4, "blue\n sky"), (5, "xx twelve charsyy"), (6, "twelve chans"), (7, "what is two plus tow? four")]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 1), (2, 2), (4, 3), (5, 4)]


def test_leaks_in_long_runs(spark):
    """A run of one character against an item of the same is counted in pieces."""
    docs = spark.createDataFrame([(1, "a" * 60000), (2, "b " * 30000), (3, "a" * 500)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a" * 1500), (2, "b " * 400)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.leaks(docs, items).collect()) == [(1, 1, 0), (2, 2, 0)]


def test_clean_keeps_whole_rows(spark):
    docs = spark.createDataFrame([(1, "the leaked item is here", 1, "x", 2), (2, "nothing", 3, "y", 4), (None, "a leaked item", 5, "z", 6), (2, None, 7, None, 8)], "doc_id long, text string, key int, row string, _key int")
    items = spark.createDataFrame([(1, "leaked item")], "item_id long, text string")
    assert sorted(tuple(r)[2:] for r in decontaminate.clean(docs, items).collect()) == [(3, "y", 4), (7, None, 8)]


def test_toxicity(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(("ta", "lo", "mi", "re", "su")) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(40)]
        if i % 3 == 0:
            for _ in range(2):
                w[rng.randrange(40)] = rng.choice(("wretchling", "grubfaced"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(5000, "ta lo wretchlingg mi"), (5001, None), (5002, "")]
    labels += [(None, 1), (1, None)]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 900]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) >= 0.97 * len(held)
    assert by[5000]["predicted"] == 1 and by[5001]["predicted"] == by[5002]["predicted"] == 0
    none = toxicity.score(spark.createDataFrame(rows[:3], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r["predicted"] for r in none] == [0, 0, 0]


def test_archives(spark):
    page = "<p>" + "payload " * 40 + "</p>"
    rows = [(5, "http://a", page), (3, "http://b\r\nx", page), (3, "http://b\r\nx", page), (9, None, "tiny"), (10, "u", "tiny"), (11, "u", None), (12, "u", "é" * 30000), (None, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for split in (1 << 24, 97):
        got = collections.Counter(tuple(r) for r in warc.round_trip(pages, split_bytes=split).collect())
        sha = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
        size = lambda h: len((h or "").encode())
        want = collections.Counter([(3, size(page), sha(page), "response", None), (3, size(page), sha(page), "revisit", 3), (5, size(page), sha(page), "revisit", 3), (None, size(page), sha(page), "revisit", 3)])
        want.update((i, size(h), sha(h), "response", None) for i, _, h in rows if h != page)
        assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_false_magic():
    noise = b"\x1f\x8b\x08" * 50 + random.Random(1).randbytes(500)
    record = warc.record(1, "u", b"body", 4, hashlib.sha256(b"body").hexdigest(), None)
    data = noise + record + record
    read = lambda at, n: data[at : at + n]
    for cut in (10, 60, 333, len(noise) + 5):
        found = [at for lo in range(0, len(data), cut) for at, _ in warc.split_records(read, lo, min(lo + cut, len(data)))]
        assert found == [len(noise), len(noise) + len(record)]


def test_token_shards(spark, docs, rows, tmp_path):
    for n in (1, 2, 17, 1000):
        assert sorted(tokens.permuted(np.arange(n), n, 7).tolist()) == list(range(n))
    folder = f"file://{tmp_path}/shards"
    index = sorted(tokens.materialise(docs.repartition(3), folder, length=64, shard_slots=20).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in index] == list(range(len(index)))
    read = list(tokens.read_sequences(folder, 0, 10**6, 64, 20))
    assert [zlib.crc32(s.tobytes()) for s in read] == [r["crc32"] for r in index]
    assert [s.tolist() for s in tokens.read_sequences(folder, 15, 30, 64, 20)] == [s.tolist() for s in read[15:45]]
    with open(tokens.VOCABULARY, "rb") as f:
        bpe = tokens.encoder(f.read(), tokens.PATTERN)
    want = collections.Counter()
    for r in rows:
        ids = bpe.encode_ordinary(r[1] or "")
        want.update(ids + [tokens.END] if ids else [])
    got = collections.Counter(np.concatenate(read).tolist())
    filling = sum(64 - r["n_tokens"] for r in index)
    got[tokens.END] -= filling
    assert got == want and sum(r["n_tokens"] for r in index) == sum(want.values())
    assert {d for r in index for d in r["doc_ids"]} == {r[0] for r in rows if r[1]}
    assert tokens.materialise(docs.limit(0)).count() == 0


@pytest.mark.parametrize("op", [jaccard.join, suffixes.deduplicate, lambda d: decontaminate.leaks(d, d.selectExpr("doc_id as item_id", "text")), lambda d: toxicity.score(d, d.selectExpr("doc_id", "1 as toxic"))])
def test_empty(docs, op):
    assert op(docs.limit(0)).count() == 0
