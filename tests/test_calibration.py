import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.plans import backtest_queries as q
from panelmill.operators import shocks


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    names = list(q.SHOCKS["all"])
    y = 100 * np.exp(rng.normal(0, 0.02, (300, 6, 13)) + rng.normal(0, 0.3, (300, 1, 1)))
    rows = [(e, names[c], q.FIRST_TEST - 1 + t, float(y[e, c, t])) for e in range(300) for c in range(6) for t in range(13)]
    dense = spark.createDataFrame(rows, "e long, c string, t int, y double").cache()
    regions = spark.createDataFrame([(e, f"r{e % 10}") for e in range(300)], "e long, region string")
    return dense, regions


@pytest.fixture
def patched(monkeypatch, panel):
    dense, regions = panel
    monkeypatch.setattr(q, "get_dense", lambda *a: dense)
    monkeypatch.setattr(q, "get_regions", lambda *a: regions)
    monkeypatch.setattr(q, "get_peer", lambda *a: shocks.peer_deviations(dense, regions))


def test_calibration_covers_scenarios_sizes_scores_and_regions(spark, patched):
    rows = q.ref_p32_calibration(spark, "").collect()
    got = {(r["scenario"], r["x"], r["score"]): r for r in rows}
    local = {(s, x, k) for s in ("all", "one", "emergency") for x in (0.05, 0.1, 0.2, 0.3) for k in ("topk", "topk without regions")}
    assert len(rows) == len(got) and set(got) == local | {("region", x, k) for x in (0.05, 0.1, 0.2, 0.3) for k in ("topk", "topk without regions", "regional")}
    assert all(got[k]["n"] == 400 for k in local)
    assert got["all", 0.3, "topk"]["found"] > 95 and got["one", 0.05, "topk"]["found"] < got["one", 0.3, "topk"]["found"]
    assert got["region", 0.3, "regional"]["found"] == 100 and got["region", 0.3, "topk"]["found"] < 10 and got["region", 0.3, "topk without regions"]["found"] > 80


def test_recall_by_size_has_scenarios_sizes_and_false_alarms(spark, patched):
    rows = q.ref_p33_recall_by_size(spark, "").toPandas()
    assert set(zip(rows["scenario"], rows["x"])) == {(s, x) for s in ("all", "one") for x in (0.1, 0.2)} and len(rows) == 20
    assert (rows.groupby(["scenario", "x"])["n"].sum() == 800).all() and rows["false_alarms"].mean() < 2


def test_one_category_is_hit_at_each_key(spark, panel):
    dense, regions = panel
    dev = shocks.peer_deviations(dense, regions)
    keys = q._draw_keys(dev, 3, 50, 1)
    before = dev.withColumn("draw", F.lit(3))
    z = q._by_draw(q._score_draws(before, keys, [(3, "one", 0.2)]))
    moved = z.join(dev.select("e", "c", "t", F.col("d").alias("was")), ["e", "c", "t"]).where(F.abs(F.col("d") - F.col("was")) > 1e-9)
    assert moved.count() == 50 and moved.where(F.abs(F.col("d") - F.col("was") - float(np.log(0.8))) < 1e-9).count() == 50
