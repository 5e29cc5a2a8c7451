"""Repeated rows, very long texts and shuffled inputs of the training-data operators."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from ledgerlink.llm import common, decontaminate, licenses, toxicity, warc


def test_responses_of_repeated_pages(spark):
    """Of equal payloads one record is a response, however rows repeat and are dealt."""
    body = "<p>" + "same words " * 20 + "</p>"
    rows = [(5, "b", body), (5, "b", body), (5, "a", body), (9, "z", body), (None, "n", body), (7, "c", "short"), (7, "c", "short"), (None, None, "x" * 200), (None, None, "x" * 200), (8, "e", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4, "url")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    n = len(body.encode())
    assert got == collections.Counter({(5, n, "response", None): 1, (5, n, "revisit", 5): 2, (9, n, "revisit", 5): 1, (None, n, "revisit", 5): 1, (7, 5, "response", None): 2, (None, 200, "response", None): 1, (None, 200, "revisit", None): 1, (8, 0, "response", None): 1})


def test_splits_have_tasks_of_their_own(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20)).alias("html"))
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write(pages.coalesce(2), folder)
    found = warc.read(spark, manifest, f"{folder}/archives", 1 << 14)
    per_task = found.select(F.spark_partition_id().alias("p"), "page_id").groupBy("p").count().collect()
    size = sum(r["bytes"] for r in manifest.collect())
    assert sum(r["count"] for r in per_task) == 400 and len(per_task) >= 0.5 * size / (1 << 14)


def test_very_long_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(("ta", "lo", "mi", "re")) for _ in range(rng.randint(1, 3)))
    text = " ".join(word() for _ in range(150_000))
    item = " ".join("xyz"[i % 3] + str(i) for i in range(30))
    docs = spark.createDataFrame([(1, text[:400_000] + " " + item + " " + text[400_000:]), (2, text)], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(4, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in found] == [(1, 4, 0)] and abs(found[0]["start"] - 400_000) < 100
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    assert sorted(scored) == [1, 2] and all(0 <= s <= 1 for s in scored.values())
    stated = spark.createDataFrame([(1, text + " " + licenses.TEMPLATES["mit-line"] + " " + text)], "doc_id long, text string")
    assert [(r["unit"], r["template"]) for r in licenses.scan(stated).collect()] == [(-150_001, "mit-line")]


def test_templates(spark):
    docs = spark.createDataFrame([(1, "of words that say a licence in their own way")], "doc_id int, text string")
    assert licenses.scan(docs, {}).collect() == [] and licenses.scan(docs, {"empty": "word"}).collect() == []
    own = {"b": "words that say a licence in their own way", "a": "words that say a licence in their own manner"}
    assert [(r["template"], r["shared"]) for r in licenses.scan(docs, own).collect()] == [("b", 8)]


def test_no_folder_off_this_machine(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError):
        common.workspace(Session(), "x")
