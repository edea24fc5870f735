import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelmill.operators.panel import densify

TOTAL = "Все категории"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """200 entities, three categories, twelve months: versions, zeros, NaN, gaps and one impossible year."""
    d = str(tmp_path_factory.mktemp("readings"))
    rows = [(e, c, f"2023-{m:02d}", float((e * 7 + m * 3 + k * 11) % 97) * (1 + k), v) for e in range(200) for k, c in enumerate((TOTAL, "a", "b")) for m in range(1, 13) if (e + k + m) % 10 for v in range(1 + (e % 9 == 0))]
    rows += [(5, "a", "0101-05", 3.0, 0), (5, TOTAL, "0101-05", 4.0, 0), (6, "a", "2023-01", float("nan"), 5), (None, "a", "2023-01", 1.0, 0), (7, None, "2023-01", 1.0, 0)]
    r = spark.createDataFrame(rows, "territory_id long, category string, date string, value double, v int")
    r.select("territory_id", "category", "date", (F.col("value") + F.col("v")).alias("value"), F.timestamp_seconds(F.col("v") + 1_700_000_000).alias("loaded_at")).write.parquet(f"{d}/consumption.parquet")
    spark.createDataFrame([(e, f"r{e % 5}", 4.0 + e % 12) for e in range(1, 201)], "territory_id long, region string, log_pop double").write.parquet(f"{d}/territory_static.parquet")
    return d


def agrees(spark, folder, name):
    con = duckdb.connect()
    for t in ("consumption", "territory_static"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    out = con.execute(entry.oracle_sql()[name])
    names, want = [x[0] for x in out.description], out.fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, folder).select(*names).collect()]
    return len(want) > 1 and sorted(got, key=str) == sorted(want, key=str)


def test_shares_need_no_grid(spark, folder):
    assert agrees(spark, folder, "ref_e12_shares")


def test_weighted_growth_needs_no_grid(spark, folder):
    assert agrees(spark, folder, "ref_p43_weighted_growth")


def test_grid_is_not_broadcast(spark):
    panel = spark.range(300).select(F.col("id").alias("e"), F.explode(F.sequence(F.lit(1), F.lit(24))).alias("t")).withColumn("c", F.lit("a")).withColumn("y", F.col("t") * 1.0)
    x = densify(panel).where("y is not null")
    assert x.count() == 7200 and len(x.collect()) == 7200
    assert "BroadcastHashJoin" not in x._jdf.queryExecution().executedPlan().toString()
