import zipfile

from ledgerlink.sources import registry as landed
from ledgerlink.streaming import windows

GML = """<c><AD_Miejscowosc id="m1"><nazwa>Płock</nazwa></AD_Miejscowosc><AD_UlicaPlac id="u1"><nazwa>Bielska</nazwa></AD_UlicaPlac>
<AD_PunktAdresowy id="p1"><numerPorzadkowy>7</numerPorzadkowy><pos>500000.0 487000.0</pos><miejscowosc href="#m1"/><ulica href="#u1"/></AD_PunktAdresowy>
<AD_PunktAdresowy id="p2"><numerPorzadkowy>9</numerPorzadkowy><miejscowosc href="#m1"/></AD_PunktAdresowy></c>"""


def test_zip_and_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("r.csv", "a,b\n1,x\n2,\n")
    assert [dict(r["row"]) for r in landed.read_zipped_csv(spark, str(tmp_path / "r.zip")).collect()] == [{"a": "1", "b": "x"}, {"a": "2", "b": ""}]
    (tmp_path / "c.csv").write_text("Nip;Nazwa\n1;Żółw\n", "utf-8")
    assert landed.read_semicolon_csv(spark, str(tmp_path / "c.csv"), ["Nip", "Nazwa"]).first()["Nazwa"] == "Żółw"


def test_points(spark, tmp_path):
    (tmp_path / "p.xml").write_text(GML, "utf-8")
    rows = landed.read_points(spark, str(tmp_path / "p.xml")).collect()
    assert [(r["city"], r["street"], r["building"], r["easting"]) for r in rows] == [("Płock", "Bielska", "7", 500000.0)]


def test_stream_of_changes(spark, tmp_path):
    rows = [(1, "status", v, f"2024-01-0{i + 1} 00:00:00") for i, v in enumerate(("a", "a", None, "b"))]
    df = spark.createDataFrame(rows, "entity_id long, field string, value string, ts string")
    df.withColumn("ts", df["ts"].cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity_id long, field string, value string, ts timestamp").parquet(str(tmp_path / "in"))
    q = windows.changes(stream).writeStream.format("memory").queryName("seen_changes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r["old_value"]), str(r["new_value"])) for r in spark.sql("select * from seen_changes").collect()) == [("None", "b"), ("a", "None")]
