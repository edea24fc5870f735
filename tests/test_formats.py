import json

from pyspark.sql import functions as F

from panelmill.sources import formats
from panelmill.streaming.arrivals import latest_versions


def test_semicolon_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;level;v\n1;муниципальное образование верхнего уровня;1,5\n2;нижнего;2\n3;верхнего;нет\n")
    rows = formats.read_semicolon_csv(spark, str(tmp_path / "a.csv"), ["v"], "level", "верхнего").orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in rows] == [("1", 1.5), ("3", None)]


def test_api_json_and_series_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"fields": ["period", "x"], "data": [["2023-01-31 22:00:00", "5.5"], ["2023-03-01 00:00:00", "bad"]]}))
    assert [tuple(r) for r in formats.read_api_json(spark, str(tmp_path / "a.json")).collect()] == [("2023-02", 5.5), ("2023-03", None)]
    (tmp_path / "a.xml").write_text('<D><Series region="R1"><Obs time="январь" value="1,5"/><Obs time="февраль" value="2"/></Series></D>')
    rows = formats.read_series_xml(spark, str(tmp_path / "a.xml")).collect()
    assert [tuple(r) for r in rows] == [("R1", "январь", 1.5), ("R1", "февраль", 2.0)]


def test_month_texts_and_report(spark):
    df = spark.createDataFrame([("Март ", "03(2024)"), ("x", "3(2024)")], "n string, s string")
    got = df.select(formats.russian_month(F.col("n"), F.lit(2024)).alias("a"), formats.sheet_month(F.col("s")).alias("b"))
    assert [tuple(r) for r in got.collect()] == [("2024-03", "2024-03"), (None, None)]
    assert formats.markdown(got, ["a"]).splitlines() == ["| a |", "|---|", "| 2024-03 |", "|  |"]


def test_stream_keeps_the_latest_version(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 5.0, "2024-01-01 10:00:00"), (1, 7.0, "2024-01-01 12:00:00"), (1, 7.0, "2024-01-01 12:00:00"), (2, 1.0, "2024-01-02 10:00:00")], "k long, v double, w string").select("k", "v", F.col("w").cast("timestamp").alias("w")).write.parquet(src)
    stream = spark.readStream.schema("k long, v double, w timestamp").parquet(src)
    q = latest_versions(stream, ["k"], "v", "w").writeStream.outputMode("update").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert {(r["k"], r["v"]) for r in spark.table("latest").collect()} == {(1, 7.0), (2, 1.0)}
