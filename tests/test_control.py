import numpy as np
from pyspark.sql import functions as F

from panelmill.operators.control import Chart, chart_spikes, implausible, latest_valid, stuck_runs


def series(seed=0, n=40, months=24, noise=0.04):
    return np.random.default_rng(seed).normal(0, noise, (n, months))


def test_spikes_levels_and_quiet_series():
    y = series()
    y[0, 10] += 1.0
    y[1, 5:7] -= 0.8
    y[2, 8:] += 0.9  # lasts: a new level
    y[3, 8:14] += 0.9  # a level for half a year
    y[4, 12] += 0.12  # a moderate shock
    y[5, 0] += 1.0
    y[6, 23] -= 1.0
    y[7, 4:9] = np.nan
    f = chart_spikes(y, Chart())
    want = np.zeros(y.shape, bool)
    want[0, 10] = want[1, 5] = want[1, 6] = want[5, 0] = want[6, 23] = True
    assert (f == want).all()


def test_scale_is_the_sources_own():
    y = np.vstack([series(1, 1, noise=0.01), series(2, 1, noise=0.2)])
    y[:, 9] += 0.3
    f = chart_spikes(y, Chart())
    assert f[0, 9] and not f[1].any()


def test_runs():
    x = np.array([[1, 1, 1, 1, 2, 2, 2, np.nan, 2], [3, 3, 3, np.nan, 3, 3, 3, 3, 3]], float)
    assert stuck_runs(x, 4).astype(int).tolist() == [[1, 1, 1, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 1, 1, 1, 1, 1]]


def test_operator_on_dirty_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(1, "a", t, float(100 * np.exp(rng.normal(0, 0.03)))) for t in range(24)] + [(2, "a", t, float(100 * np.exp(rng.normal(0, 0.03)))) for t in range(24)]
    rows[3] = (1, "a", 3, 900.0)
    rows[5] = (1, "a", 5, -1.0)
    rows[7] = (1, "a", 7, float("inf"))
    rows[9] = (1, "a", 9, None)
    rows[10] = (1, "a", 10, float("nan"))
    for t in range(30, 34):
        rows[t] = (2, "a", t - 24, 55.5)
    rows += [(3, None, 0, 5.0), (3, "a", None, 5.0)]
    df = spark.createDataFrame(rows, "s long, c string, t int, v double")
    bad = (F.col("v") <= 0) | (F.col("v") == float("inf"))
    got = {(r["s"], r["t"], r["reason"]) for r in implausible(df, ["s", "c"], "t", "v", True, bad, "c").collect()}
    assert got == {(1, 3, "spike"), (1, 5, "impossible"), (1, 7, "impossible")} | {(2, t, "stuck") for t in range(6, 10)}
    assert implausible(df.limit(0), ["s", "c"], "t", "v", True, bad, "c").count() == 0


def test_latest_version(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (1, None, 3), (1, 7.0, 2), (2, 1.0, None), (2, 2.0, 1), (3, 1.0, 1), (3, 4.0, 1)], "k long, v double, w int")
    assert {r["k"]: r["v"] for r in latest_valid(df, ["k"], "v", "w").collect()} == {1: None, 2: 2.0, 3: 4.0}


def test_quiet_sources_of_shock_scores_have_smaller_cases(spark, monkeypatch):
    from panelmill.plans import general

    rng = np.random.default_rng(8)
    months = [f"2023-{m:02d}" for m in range(1, 13)] + [f"2024-{m:02d}" for m in range(1, 13)]
    z = rng.normal(0, 1, (40, 24)) * np.where(np.arange(40) < 10, 0.4, 1.5)[:, None]
    z[0, 9] += 8.0  # 20 scales of a quiet source
    z[20, 9] += 8.0  # five scales of another
    z[21, 5] += 30.0
    rows = [(e, months[t], float(z[e, t]), t) for e in range(40) for t in range(24)]
    shocks = spark.createDataFrame(rows, f"territory_id long, month string, `z: {general.TOTAL}` double, detected_at long")
    empty = spark.createDataFrame([], "territory_id long, category string, date string, value double, loaded_at long")
    monkeypatch.setattr(general, "read_table", lambda spark, folder, name: empty if name == "consumption" else shocks)
    got = {(r["territory_id"], r["month"]) for r in general.p5_found(spark, "").collect()}
    assert got == {(0, "2023-10"), (21, "2023-06")}


def test_few_sources_also_lose_their_common_season(spark):
    rng = np.random.default_rng(5)
    for sources in (19, 20):
        rows = [(e, "a", t, float(100 * np.exp(rng.normal(0, 0.03) + (0.9 if t % 12 == 11 else 0)))) for e in range(sources) for t in range(24)]
        df = spark.createDataFrame(rows, "s long, c string, t int, v double")
        assert implausible(df, ["s", "c"], "t", "v", True, F.col("v") <= 0, "c").count() == 0


def test_an_absurd_date_costs_no_more_than_any_other(spark):
    rng = np.random.default_rng(6)
    rows = [(e, "a", t, float(100 * np.exp(rng.normal(0, 0.03)))) for e in range(20) for t in range(24)] + [(0, "a", 119_999, 100.0)]
    rows[5] = (0, "a", 5, 900.0)
    df = spark.createDataFrame(rows, "s long, c string, t int, v double")
    assert [(r["s"], r["t"]) for r in implausible(df, ["s", "c"], "t", "v", True, F.col("v") <= 0, "c").collect()] == [(0, 5)]
    from panelmill.operators.control import _parts, _table
    import pandas as pd

    pdf = pd.DataFrame({"_t": [np.arange(24)] * 19 + [np.append(np.arange(24), 119_999)], "_x": [np.ones(24)] * 19 + [np.ones(25)], "_y": [np.ones(24)] * 19 + [np.ones(25)], "_bad": [np.zeros(24, bool)] * 19 + [np.zeros(25, bool)]})
    assert max(_table(p)[1].size for p in _parts(pdf)) <= 20 * 25
    assert sorted(len(p) for p in _parts(pdf, 60)) and sum(len(p) for p in _parts(pdf, 60)) == 20


def test_runs_need_neighbouring_steps():
    x = np.full((1, 5), 7.0)
    assert stuck_runs(x, 4, np.array([[0, 1, 2, 4, 5]])).sum() == 0 and stuck_runs(x, 4, np.array([[0, 1, 2, 3, 9]])).sum() == 4
