import numpy as np

from panelmill.llm.ranking import rank_bin, rank_walk


def brute(v, damping=0.5, rounds=400):
    """Stationary distribution of the walk, item by item; missing scores stand at the mean percentile."""
    n, k = v.shape
    share = np.full(v.shape, np.nan)
    for s in range(k):
        for i in np.flatnonzero(np.isfinite(v[:, s])):
            have = v[np.isfinite(v[:, s]), s]
            share[i, s] = ((have > v[i, s]).sum() + (have == v[i, s]).sum() / 2) / len(have)
    mean = np.where(np.isfinite(share).any(1), np.nansum(share, 1) / np.maximum(np.isfinite(share).sum(1), 1), 1.0)
    pos = np.floor(np.where(np.isfinite(share), share, mean[:, None]) * n)
    p = np.full((n, n), (1 - damping) / n)
    for i in range(n):
        for s in range(k):
            up = pos[:, s] < pos[i, s]
            p[i] += damping / k * (up / up.sum() if up.any() else np.full(n, 1 / n))
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        x = x @ p
    return x


def test_equals_the_walk_worked_out_by_hand(spark):
    rng = np.random.default_rng(0)
    v = np.stack([rng.normal(size=60), rng.pareto(1, 60) * 1e6, rng.integers(0, 5, 60).astype(float)], 1)
    v[3, 0] = v[7, 1] = v[7, 2] = np.nan
    v[9] = np.nan
    v[11, 1] = np.inf
    rows = [(i, *[None if i == 3 and np.isnan(x) else float(x) for x in r], "extra") for i, r in enumerate(v)]
    df = spark.createDataFrame(rows + rows[:5], "id long, a double, b double, c double, stationarity string")
    got = {r["id"]: r for r in rank_walk(df, "id", ["a", "b", "c"], tol=1e-12).collect()}
    v[11, 1] = np.nan
    want = brute(v)
    assert len(got) == 60 and got[9]["n_scores"] == 0 and got[9]["place"] == 60
    assert max(abs(got[i]["stationarity"] - want[i]) for i in got if i != 9) < 1e-6
    order = sorted((i for i in got if i != 9), key=lambda i: -want[i])
    places = [got[i]["place"] for i in order]
    assert places == sorted(places) and places[0] == 1


def test_scale_does_not_matter_and_bad_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    one = {r["id"]: r["place"] for r in rank_walk(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"]).collect()}
    wide = [(i, a, float(np.exp(9 * b))) for i, a, b in rows]
    assert one == {r["id"]: r["place"] for r in rank_walk(spark.createDataFrame(wide, "id long, a double, b double"), "id", ["a", "b"]).collect()}
    none = spark.createDataFrame([(1, None, float("nan")), (2, None, None)], "id long, a double, b double")
    assert {r["place"] for r in rank_walk(none, "id", ["a", "b"]).collect()} == {1}
    assert rank_walk(none.limit(0), "id", ["a", "b"]).count() == 0


def test_bins_are_monotone():
    b = rank_bin(np.arange(200_000), 2000, 0.002)
    assert (np.diff(b) >= 0).all() and (b[:2000] == np.arange(2000)).all() and b[-1] < 5000


def test_bins_give_the_order_of_the_exact_walk(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=5000)
    v = np.stack([base + rng.normal(size=5000), np.exp(base + rng.normal(size=5000)), base + rng.standard_cauchy(5000)], 1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "id long, a double, b double, c double")
    place = lambda **k: np.array([r["place"] for r in rank_walk(df, "id", ["a", "b", "c"], **k).orderBy("id").collect()])
    exact, binned, coarse = place(exact=10_000), place(), place(exact=200)
    assert np.corrcoef(exact, binned)[0, 1] > 0.9999 and np.abs(exact - binned).max() <= 10
    assert np.corrcoef(exact, coarse)[0, 1] > 0.9999
