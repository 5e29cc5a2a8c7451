"""Each stage of the pipeline against what its input, worked through by hand, should give."""

import collections
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ledgerlink.llm import catalogue, decontaminate, tokens
from ledgerlink.llm.chars import folded, points
from ledgerlink.llm.common import cut, table

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each."""
    docs = table(spark, DATA, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, DATA), "stage")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "source mixing", "token output"]


def test_quality(stages):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({catalogue.oracle_sql()['op5_quality_rules']}) q WHERE kept").fetchall()}
    assert set(rows(stages[1])) == kept < set(rows(stages[0]))


def test_near_duplicates(stages):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts, sets = rows(stages[1]), {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    best = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if best[a] != best[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    best[a] = best[b] = min(best[a], best[b])
                    changed = True
    assert set(rows(stages[2])) == set(best.values()) and rows(stages[2]).items() <= texts.items()


def test_decontamination(spark, stages):
    items = [folded(r["text"]) for r in table(spark, DATA, "benchmark").collect() if folded(r["text"])]
    before, after = rows(stages[2]), rows(stages[3])
    for d, t in before.items():
        text = folded(t)
        if any(i in text for i in items):
            assert d not in after
    for d in set(before) - set(after):
        text = folded(before[d])
        near = [(i, text.find(i[at : at + 20])) for i in items for at in range(0, len(i) - 20, 10) if i[at : at + 20] in text]
        hit = False
        for i, at in near:
            k = decontaminate.budget(len(i))
            part = points(text[max(0, at - len(i) - k) : at + len(i) + k]).astype(np.int64)
            hit |= decontaminate.banded_distance(points(i).astype(np.int64), part, max(0, len(part) - len(i) + k), k) <= k
        assert hit, d


def test_mixing(stages):
    before, words, runs = rows(stages[3]), collections.Counter(), 0
    for r in stages[4].collect():
        mine, whole = WORD.findall(r["text"]), WORD.findall(before[r["doc_id"]])
        assert mine and any(whole[i : i + len(mine)] == mine for i in range(len(whole) - len(mine) + 1)) and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(mine)
        runs += 1
    assert runs and all(n <= 3 * len(WORD.findall(before[d])) for d, n in words.items())
    total = sum(len(WORD.findall(t or "")) for t in before.values())
    assert abs(sum(words.values()) - total) <= 0.05 * total


def test_token_output(spark, stages):
    with open(tokens.VOCABULARY, "rb") as f:
        bpe = tokens.encoder(f.read(), tokens.PATTERN)
    out = corpus_pipeline.STAGES[-1][1](spark, stages[4], DATA)
    assert out.columns == [c.split()[0] for c in tokens.SCHEMA.split(", ")]
    index = out.collect()
    texts = [r for r in stages[4].collect() if r["text"]]
    assert sum(r["n_tokens"] for r in index) == sum(len(bpe.encode_ordinary(r["text"])) + 1 for r in texts)
    assert {d for r in index for d in r["doc_ids"]} == {r["doc_id"] for r in texts}


def test_clashing_columns(spark):
    """Stages keep further columns, whatever their names."""
    from pyspark.sql import functions as F

    names = ("key", "row", "_key", "lo", "twin", "h", "node", "n")
    docs = table(spark, DATA, "documents").limit(60).withColumns({c: F.col("doc_id") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, DATA), "stage")
        assert docs.filter(" or ".join(f"{c} <> doc_id" for c in names)).count() == 0 and docs.columns[-len(names) :] == list(names), name
