import json

from pyspark.sql import functions as F

from ledgerlink.functions import semi


def test_redaction(spark):
    df = spark.createDataFrame([('{"a": [{"PESEL": "44051401359", "n": 1}], "pesel": "12"}',), (None,)], "j string")
    got = [r[0] for r in df.select(semi.redacted(F.col("j"), "p")).collect()]
    out = json.loads(got[0])
    assert out["pesel"] is None and len(out["a"][0]["PESEL"]) == 32 and out["a"][0]["n"] == 1 and got[1] is None


def test_pages(spark):
    df = spark.range(10)
    page, more = semi.has_more(df, [F.col("id")], 4, 4)
    assert [r[0] for r in page.collect()] == [4, 5, 6, 7] and more
    assert not semi.has_more(df, [F.col("id")], 4, 6)[1]


def test_nulls(spark):
    r = spark.range(1).select(semi.without_nulls(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b")).alias("j"), semi.merged(F.lit(None).cast("map<string,string>"), F.create_map(F.lit("k"), F.lit("v"))).alias("m")).first()
    assert r["j"] == '{"a":1}' and r["m"] == {"k": "v"}
