"""Mixing, sharding, quality rules and licence scans against brute force and edge cases."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerlink.llm import licenses, mixing, quality, sharding
from ledgerlink.llm.common import permuted, sides

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int"
ROWS = [
    (1, "alpha beta gamma delta", "en", "a", 22, 7),
    (1, "alpha beta gamma delta", "en", "a", 22, 7),
    (2, None, "en", "a", None, None),
    (3, "", None, None, 0, 1),
    (None, "one two\n\nthree\x0bfour\tfive six", "de", None, 9, 2),
    (4, "  \n ", "de", "b", 4, 2),
    (5, "é ż " * 3000, "fr", "b", 12000, 3),
    (6, "w" * 5000, "fr", "c", 5000, 3),
    (7, " ".join(f"x{i}" for i in range(700)), "fr", "ż", 10, 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        a, b = sides(n)
        image = permuted(F.col("id"), F.lit(n), F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit(3))
        assert sorted(r[0] for r in spark.range(n).select(image).collect()) == list(range(n))


def test_targets():
    goal = mixing.targets([100, 10, 100], (5, 2, 1), 3)
    assert goal[1] == 30 and math.isclose(sum(goal), 210) and math.isclose(goal[0] / goal[2], 5)
    assert mixing.targets([0, 0], (5, 2, 1), 3) == [0.0, 0.0] and mixing.targets([], (5,), 3) == []


def test_mix(spark, docs):
    mix = mixing.Mix(docs, block_words=16, shard_slots=64)
    rows = mix.taken().collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(r["size"] for r in rows) == sorted(size(r[1]) for r in ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    own, taken, goal = collections.Counter(), collections.Counter(), {}
    for r in rows:
        own[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) <= 40 for s in own)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.Mix(docs, block_words=16, shard_slots=64).taken().collect()), key=str)
    texts = mix.texts()
    assert texts.columns == docs.columns and texts.dtypes == docs.dtypes
    words = collections.Counter()
    for r in texts.collect():
        words[r["source"]] += size(r["text"])
    assert all(words[s] == taken[s] for s in own)


def test_mix_of_small_sources_comes_near(spark):
    rows = [(i, "w " * n, s) for s, n, k in (("a", 50, 1), ("b", 7, 3), ("c", 400, 4), ("d", 1, 1), (None, 90, 2)) for i in range(k)]
    taken, goal = collections.Counter(), {}
    for r in mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).taken().collect():
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - g) <= 1 + g / 30 for s, g in goal.items())


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * 9, "ab"[i % 2], i, i, i, i, i, i) for i in range(6)], "doc_id long, text string, source string, lo int, hi int, twin int, row int, _n int, tie int")
    for r in mixing.Mix(docs).texts().collect():
        assert set(r[3:]) == {r["doc_id"]}


def test_multinomial(spark):
    big = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.repeat(F.lit("w "), 500).alias("text"))
    mix = mixing.Mix(big, block_words=1, shard_slots=2000)
    chance = [q / sum(mix.quota) for q in mix.quota]
    for r in mix.drawn().groupBy("shard").pivot("sid", [0, 1, 2, 3]).count().collect():
        for s in range(4):
            assert abs(r[str(s)] / 2000 - chance[s]) < 5 * math.sqrt(chance[s] / 2000)
    settled = mix.slots().groupBy("sid").count().collect()
    assert {r["sid"]: r["count"] for r in settled} == dict(enumerate(mix.quota))


@pytest.mark.parametrize("op", ["mix", "shard", "judge", "scan"])
def test_empty(spark, docs, op):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {"mix": lambda: mixing.Mix(none).taken(), "shard": lambda: sharding.shard(none), "judge": lambda: quality.judge(none, labels), "scan": lambda: licenses.scan(none)}[op]()
    assert out.count() == 0


def test_shards(spark, docs, tmp_path):
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    rows = sharding.shard(many, 8, path=f"file://{tmp_path}/map").collect()
    load = collections.Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 51 and len(load) == 8
    for s in load:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    import zlib

    assert all(r["text_crc32"] == zlib.crc32(b"x" * (r["size"] - 1)) for r in rows)
    assert sharding.shard(docs, 4).count() == len(ROWS)
    store = sharding.SlotMap(spark, f"file://{tmp_path}/map")
    assert store.versions() == [1, 2]  # slots in turn, then edited by their bytes


def test_the_stored_map_is_edited(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 7 % 90).cast("int")).alias("text"))
    at = lambda rows: {r["virtual_slot"]: r["shard"] for r in rows}
    before, again, grown = (sharding.shard(docs, n, path=path).collect() for n in (8, 8, 9))
    assert at(before) == at(again) and {r["map_version"] for r in again} == {2} and {r["map_version"] for r in grown} == {3}
    moved = [s for s, k in at(grown).items() if k != at(before)[s]]
    assert {at(grown)[s] for s in moved} == {8}
    assert sum(r["size"] for r in grown if r["virtual_slot"] in set(moved)) < 0.13 * sum(r["size"] for r in grown)
    load, held = collections.Counter(), collections.Counter(r["shard"] for r in sharding.SlotMap(spark, path).load(3).collect())
    for r in grown:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 400 and max(held.values()) < 2 * min(held.values())
    assert all(sorted(r["slot"] for r in grown if r["shard"] == s) == list(range(sum(r["shard"] == s for r in grown))) for s in range(9))


def test_empty_slots_spread():
    plan = sharding.rebalance({s: 0 for s in range(100)}, {1: 5, 2: 5}, 4)
    assert set(collections.Counter(plan.values()).values()) <= {24, 25, 26}


def test_rebalance_moves_into_new_shards_only():
    weights = {s: 10 + s % 3 for s in range(400)}
    plan = sharding.rebalance({s: s % 4 for s in weights}, weights, 4)
    grown = sharding.rebalance(plan, weights, 5)
    assert {grown[s] for s in plan if grown[s] != plan[s]} == {4}
    load = collections.Counter()
    for s, k in grown.items():
        load[k] += weights[s]
    assert max(load.values()) - min(load.values()) <= 24
    assert set(sharding.rebalance(plan, weights, 3).values()) == {0, 1, 2}


def features(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered, seen, dup = collections.Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_features(spark, docs):
    texts = [r[1] for r in ROWS] + ["a b c d e a b c d e f", "x\nx\n \ny\nx", "#*$%&|<> a", "a a a a a a a", "\ta\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.features(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == features(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_binomial(spark):
    for n, k, p in ((10, 0, 0.3), (50, 3, 0.2), (3000, 5, 0.01), (20, 19, 0.5)):
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        assert math.isclose(got, want, rel_tol=1e-9)


def test_certified_cutoffs(spark):
    good = [(i, f"plain words of a good text that goes on and on for a while yet {i}", "en") for i in range(3000)]
    bad = [(10_000 + i, f"bad%% words** of## a$$ bad&& text|| that<< goes>> on%% and** on## {i}", "en") for i in range(300)]
    few = [(20_000 + i, "bad%% words** of## a$$ bad&& text|| that<< goes>> on%% and** on##", "de") for i in range(5)]
    docs = spark.createDataFrame([*good, *bad, *few], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad + few] + [(None, 1), (10_001, 1)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] for i, _, _ in good) and not any(kept[i] for i, _, _ in bad)
    assert all(kept[i] for i, _, _ in few)  # too few labels in that stratum for a guarantee


def test_copies_are_one_trial(spark):
    """Thousands of labelled copies of one text are no evidence of a low rate."""
    good = [(i, "plain words of a good text that goes on and on for a while yet", "en") for i in range(3000)]
    bad = [(10_000 + i, "bad%% words** of## a$$ bad&& text|| that<< goes>> on%% and** on##", "en") for i in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad], "doc_id long, quality int")
    assert quality.judge(docs, labels).filter("not kept").count() == 0


def test_licences(spark, docs):
    rows = [(1, licenses.TEMPLATES["mit"]), (2, "intro line\nReleased under the MIT License.\nmore text of no licence"), (3, "no licence at all here"), (4, None), (5, "")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["template"]) for r in found} == {(1, "mit"), (2, "mit-line")}
    words = licenses.normal_words
    pairs = lambda t: {tuple(x) for x in zip(words(t), words(t)[1:])}
    for r in found:
        text = dict(rows)[r["doc_id"]]
        unit = text if r["unit"] == 0 else text.split("\n")[r["unit"] - 1]
        a, b = pairs(unit), pairs(licenses.TEMPLATES[r["template"]])
        assert math.isclose(r["dice"], 2 * len(a & b) / (len(a) + len(b)))
    assert licenses.scan(docs).count() == 0
