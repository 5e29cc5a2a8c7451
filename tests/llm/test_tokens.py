"""Token shards: the training order, sequence by sequence, against one that is laid by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlink.llm import tokens

SCHEMA = "doc_id long, text string, stream int, part string"
ROWS = [(i, f"document {i} " + "some words of it " * (i * 7 % 40), 1, "x") for i in range(60)] + [(3, "under an id again", 2, None), (None, "no id", 3, "y"), (None, None, 4, "z"), (70, "", 5, "z"), (7, "repeated row", 6, "a"), (7, "repeated row", 7, "b")]


def laid_by_hand(spark, length, key):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    with open(tokens.VOCABULARY, "rb") as f:
        bpe = tokens.encoder(f.read(), tokens.PATTERN)
    known = sorted(((r["h"], r["doc_id"] or 0, r["doc_id"], r["text"]) for r in docs.filter("text != ''").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()), key=lambda x: x[:2])
    flow = [(x, d) for _, _, d, t in known for x in [*bpe.encode_ordinary(t), tokens.END]]
    n = -(-len(flow) // length)
    slots = tokens.permuted(np.arange(n), n, key).tolist()
    out = {}
    for i, slot in enumerate(slots):
        part = flow[i * length : (i + 1) * length]
        ids = [d for j, (_, d) in enumerate(part) if j == 0 or part[j - 1][0] == tokens.END]
        out[slot] = ([x for x, _ in part] + [tokens.END] * (length - len(part)), ids, len(part))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_training_order(spark, tmp_path, partitions):
    folder = str(tmp_path / "shards")
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(partitions)
    index = sorted(tokens.materialise(docs, folder, length=32, shard_slots=8).collect(), key=lambda r: r["slot"])
    want = laid_by_hand(spark, 32, 2024)
    assert [r["slot"] for r in index] == sorted(want)
    read = [s.tolist() for s in tokens.read_sequences(folder, 0, 10**6, 32, 8)]
    for r, got in zip(index, read):
        ids, docs_in, used = want[r["slot"]]
        assert got == ids and r["doc_ids"] == docs_in and r["n_tokens"] == used
        assert (r["shard"], r["offset"]) == (r["slot"] // 8, r["slot"] % 8 * 64)


def test_several_streams_hold_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "STREAM_BYTES", 1 << 12)
    indexes = []
    for partitions in (1, 5):
        folder = str(tmp_path / f"shards{partitions}")
        index = tokens.materialise(spark.createDataFrame(ROWS, SCHEMA).repartition(partitions), folder, length=32, shard_slots=8).collect()
        indexes.append(sorted((r["slot"], r["crc32"], r["doc_ids"], r["n_tokens"]) for r in index))
    assert indexes[0] == indexes[1] and [x[0] for x in indexes[0]] == list(range(len(indexes[0])))
    assert sum(x[3] for x in indexes[0]) == sum(x[2] for x in laid_by_hand(spark, 32, 2024).values())
