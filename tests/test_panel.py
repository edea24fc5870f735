import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.functions import hash_share
from panelmill.operators import external, metrics, news, panel, shocks
from panelmill.plans import backtest


def long(spark, series):
    """{(entity, category): values} as a panel."""
    return spark.createDataFrame([(e, c, t, None if v is None else float(v)) for (e, c), ys in series.items() for t, v in enumerate(ys)], "e long, c string, t int, y double")


def test_quintiles_and_percent_ranks(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7])] + [(9, None)], "i int, x double").withColumn("g", F.lit(1))
    got = {r["i"]: r["q"] for r in df.select("i", panel.quantile_bin("x", 5, ["g"], ["i"]).alias("q")).collect()}
    assert [got[i] for i in range(7)] == [0, 0, 1, 2, 3, 4, 4] and got[9] is None
    tie = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 3.0), (4, None)], "i int, x double").withColumn("g", F.lit(1))
    assert {r["i"]: r["p"] for r in tie.select("i", panel.pct_rank("x", "g").alias("p")).collect()} == {1: 0.5, 2: 0.5, 3: 1.0, 4: None}


def test_dense_grid_and_completeness(spark):
    p = long(spark, {(1, "a"): [1, 2, 3], (1, "b"): [1, 2, 3], (2, "a"): [1, None, 3]}).where("not (e = 2 and t = 1)")
    d = panel.densify(p)
    assert d.count() == 12 and d.where("y is null").count() == 4
    assert [r["e"] for r in panel.complete_entities(p).collect()] == [1]
    assert panel.densify(p.limit(0)).count() == 0
    with pytest.raises(ValueError):
        panel.densify(p, max_categories=1)


def test_features_look_only_backwards(spark):
    rng = np.random.default_rng(0)
    ys = {(e, "a"): list(100 + rng.normal(0, 5, 20)) for e in range(6)}
    one = panel.features(long(spark, ys)).where("t = 14").orderBy("e").drop("y", "l").collect()
    later = {k: v[:14] + [1e6] * 6 for k, v in ys.items()}
    assert one == panel.features(long(spark, later)).where("t = 14").orderBy("e").drop("y", "l").collect()
    r = {x["e"]: x for x in one}[0]
    y = ys[0, "a"]
    assert math.isclose(r["dlog_1"], math.log(y[13] / y[12])) and math.isclose(r["dev_abs_mean3"], y[13] - np.mean(y[11:14])) and math.isclose(r["sn_gap_abs"], y[2] - y[13])


def test_level_shift_and_despike(spark):
    rng = np.random.default_rng(1)
    ys = {(e, "a"): np.exp(5 + rng.normal(0, 0.02, 24)) for e in range(30)}
    ys[3, "a"][10:] *= 1.8
    ys[4, "a"][12] *= 3
    d = long(spark, {k: list(v) for k, v in ys.items()})
    got = {r["e"]: r for r in panel.level_shifts(d).collect()}
    assert set(got) == {3} and got[3]["s"] == 10 and abs(got[3]["step"] - math.log(1.8)) < 0.05
    based = {r["t"]: r["based"] / r["y"] for r in panel.rebase(d, panel.level_shifts(d)).where("e = 3").collect()}
    assert abs(based[2] - 1.8) < 0.1 and based[15] == 1
    changed = {(r["e"], r["t"]) for r in panel.despike(d, 8.0).where("clean <> y").collect()}
    assert (4, 12) in changed and (3, 10) not in changed


def test_simple_models_on_short_and_long_history(spark):
    d = long(spark, {(1, "a"): list(range(10, 34)), (2, "a"): list(range(1, 13)) + [None] * 12})
    got = {(r["model"], r["step"]): r["y_pred"] for r in panel.simple_forecasts(d, 23, 14).where("e = 1").collect()}
    assert got["naive", 5] == 33 and got["mean_3", 1] == 32 and got["drift", 2] == 35 and got["seasonal_naive", 1] == 22 == got["seasonal_naive", 13]
    assert math.isclose(got["seasonal_naive_growth", 1], 22 * (33 + 32 + 31) / (21 + 20 + 19))
    flat = long(spark, {(1, "a"): [100.0] * 16})
    for months in (12, 13, 14, 15, 16):
        growth = [r["y_pred"] for r in panel.simple_forecasts(flat, months - 1, 2, 0).where("model = 'seasonal_naive_growth'").collect()]
        assert growth == [100.0, 100.0]
    short = {(r["model"], r["step"]): r["y_pred"] for r in panel.simple_forecasts(d, 11, 2).where("e = 2").collect()}
    assert short["seasonal_naive_growth", 1] == 1.0 and short["drift", 1] == 13


def test_protocol_and_perfect_metrics(spark):
    assert [o for o in range(12, 24) if metrics.serves(o, 6)] == [12, 18] and metrics.forecast_plan() == {12: 12, 13: 1, 14: 1, 15: 3, 16: 1, 17: 1, 18: 6, 19: 1, 20: 1, 21: 3, 22: 1, 23: 1}
    rows = spark.createDataFrame([("m", float(y), float(y), 5.0) for y in (1, 2, 7)], "model string, y_true double, y_pred double, y_last double")
    r = metrics.metric_table(rows, ["model"]).first()
    assert (r["MAE"], r["WAPE"], r["R2"], r["R2_growth"], r["n"]) == (0, 0, 1, 1, 3)


def test_shock_types_topk_and_recovery(spark):
    df = spark.createDataFrame([(-0.5, 1.6), (-0.5, 0.7), (-0.5, 0.2), (-0.5, -0.7), (0.5, -0.7), (0.5, None)], "d double, p double")
    assert [r[0] for r in df.select(shocks.shock_type(F.col("d"), F.col("p"))).collect()] == ["escalating", "level shift", "one-off", "dip-rebound", "spike-drop", None]
    z = spark.createDataFrame([(1, 0, c, x) for c, x in zip("abcd", [3.0, -4.0, None, 0.0])], "e long, t int, c string, z double")
    assert math.isclose(shocks.top_rms(z, "z").first()["topk"], 5 / math.sqrt(3))
    paths = spark.createDataFrame([(1, "a", 0, k, x) for k, x in enumerate([0.5, 0.2, 0.9, 0.9, 0.9, 0.9], 1)] + [(2, "a", 0, k, 0.9) for k in range(1, 7)] + [(3, "a", 0, k, 0.9 if k < 3 else None) for k in range(1, 7)], "e long, c string, t int, k int, left double")
    assert {r["e"]: r["month"] for r in shocks.recovery_month(paths).collect()} == {1: 2, 2: 7, 3: None}
    gap = spark.createDataFrame([(1, "a", 0, k, None if k == 2 else 0.9) for k in range(1, 7)], "e long, c string, t int, k int, left double")
    assert shocks.recovery_month(gap).first()["month"] == 7


def test_cusum_is_the_best_start_of_three(spark):
    x = [0.2, 1.5, 1.5, -3.0, None, 2.0]
    z = long(spark, {(1, "a"): x}).withColumnRenamed("y", "z")
    got = [r["cusum"] for r in shocks.cusum(z, "z").orderBy("t").collect()]
    u = [0 if v is None else v for v in x]
    want = [max(0, *[s * sum(u[j : i + 1]) - 0.5 * (i + 1 - j) for j in range(max(0, i - 2), i + 1) for s in (1, -1)]) for i in range(6)]
    assert np.allclose(got, want)


def test_versions_bounds_fallback_and_draws(spark):
    v = spark.createDataFrame([("c1", 1, 2020, 2022), ("c1", 2, 2022, 9999), ("c2", 3, 2020, 2021), ("c3", 4, 2020, 2021), ("c3", 5, 2020, 2021)], "code string, territory_id long, year_from int, year_to int")
    f = spark.createDataFrame([("c1", 2021), ("c1", 2022), ("c1", 2030), ("c2", 2021), ("c3", 2023)], "code string, year int")
    got = {(r["code"], r["year"]): r["territory_id"] for r in external.attach_version(f, v, "code", "year", 2025, stable="code").collect()}
    assert got == {("c1", 2021): 1, ("c1", 2022): 2, ("c1", 2030): 2, ("c2", 2021): 3, ("c3", 2023): None}
    import hashlib

    d = spark.createDataFrame([(str(i),) for i in range(50)], "p string").select("p", hash_share(F.col("p")).alias("h")).collect()
    assert all(r["h"] == int(hashlib.md5(r["p"].encode()).hexdigest(), 16) % 10000 for r in d)


def test_fasting_share_and_expanding_median(spark):
    assert np.allclose([panel.fasting_share(2023 * 12 + m) for m in (2, 3, 6)], [9 / 31, 20 / 30, 0])
    with pytest.raises(ValueError):
        panel.fasting_share(2031 * 12)
    r = spark.createDataFrame([(1, "5"), (2, "77")], "e long, region string")
    got = {(x["e"], x["t"]): x for x in panel.fasting_features(r, [2023 * 12 + 2]).collect()}
    assert math.isclose(got[1, 2023 * 12 + 2]["ramadan_next"], 0.95 * 20 / 30) and got[2, 2023 * 12 + 2]["ramadan_t"] == 0
    c = spark.createDataFrame([(1, t, float(n)) for t, n in enumerate([3, 1, 4])], "territory_id long, t int, n double")
    got = [r["s"] for r in news.spikes(c, "n", "s").orderBy("t").collect()]
    assert got[0] is None and math.isclose(got[1], math.log(2 / 4)) and math.isclose(got[2], math.log(5 / 3))


def test_model_names_inherit(spark):
    c = backtest.model_config("catboost_logdiff_dsp_g123_rel")
    assert c["deseason"] == "panel" and c["features"] == ["geo", "regional", "population", "relative"] and c["target"] == "log_diff"
    with pytest.raises(ValueError):
        backtest.model_config("chronos2")
    assert backtest.resolve({"a": {"x": 1, "p": {"d": 1}}, "b": {"base": "a", "p": {"e": 2}}}, "b") == {"x": 1, "p": {"e": 2}}


def test_a_single_wrong_date_does_not_blow_up_the_grid(spark):
    d = spark.createDataFrame([(1, "a", 24276, 1.0), (1, "a", 24277, 2.0), (2, "a", 119_999, 3.0)], "e long, c string, t int, y double")
    with pytest.raises(ValueError, match="months"):
        panel.densify(d)
    assert panel.densify(d, last=24277).count() == 4


def test_season_profile_fills_unseen_months_from_another(spark):
    rng = np.random.default_rng(0)
    season = np.array([0.0, 0.1, -0.1, 0.2, 0, 0, 0.05, 0, 0, 0, 0, 0.3])
    d = long(spark, {(e, "a"): list(np.exp(season + rng.normal(0, 1e-6, 12) + e)) for e in range(5)})
    nat = spark.createDataFrame([("a", m, float(v)) for m, v in enumerate(season - season.mean())], "c string, moy int, level double")
    got = {r["moy"]: r["level"] for r in panel.season_profile(d, nat).collect()}
    assert np.allclose([got[m] for m in range(12)], season - season.mean(), atol=1e-4)


def test_robust_distance_and_isolation_find_planted_rows(spark):
    from panelmill.operators import outliers

    rng = np.random.default_rng(4)
    x = rng.multivariate_normal([0, 0, 0], [[1, 0.6, 0], [0.6, 1, 0], [0, 0, 4]], 1500)
    x[:30] += [6, -6, 0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "e long, v0 double, v1 double, v2 double")
    fit = outliers.robust_location(df, ["v0", "v1", "v2"])
    clean = x[30:]
    assert np.allclose(np.linalg.inv(fit.inverse), np.cov(clean.T), rtol=0.25, atol=0.15) and np.allclose(fit.mean, clean.mean(0), atol=0.15)
    far = df.select("e", fit.squared(["v0", "v1", "v2"]).alias("d")).orderBy(F.desc("d")).limit(30).collect()
    assert {r["e"] for r in far} == set(range(30))
    d = x - fit.mean
    got = {r["e"]: r["d"] for r in df.select("e", fit.squared(["v0", "v1", "v2"]).alias("d")).collect()}
    assert np.allclose([got[i] for i in range(1500)], np.einsum("ij,jk,ik->i", d, fit.inverse, d))
    s = {r["e"]: r["iforest"] for r in outliers.isolation_scores(df, ["e"], ["v0", "v1", "v2"], trees=60, sample=256).collect()}
    assert np.mean([s[i] for i in range(30)]) > 1.2 * np.mean([s[i] for i in range(30, 1500)])
    assert abs(outliers.chi2_point(0.975, 6) - 14.449) < 0.01
    assert outliers.isolation_scores(df.limit(0), ["e"], ["v0"]).count() == 0
    assert outliers.robust_location(df.limit(0), ["v0"]).mean.tolist() == [0.0]


def test_hits_within_months(spark):
    scores = spark.createDataFrame([(e, t, 10.0 if (e, t) in {(1, 3), (2, 4)} else float(e + t) / 100) for e in range(1, 60) for t in range(6)], "e long, t int, score double")
    keys = spark.createDataFrame([(1, 3), (2, 3), (3, 3)], "e long, t int")
    assert [round(shocks.hit_within(scores, keys, k).first()["found"], 4) for k in (0, 1)] == [round(1 / 3, 4), round(2 / 3, 4)]
