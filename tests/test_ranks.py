import numpy as np
from pyspark.sql import functions as F

from panelmill.operators import shocks
from panelmill.operators.ranks import whole_percentiles, whole_rank

INF = float("inf")


def test_levels_of_scores_with_infinite_distances(spark):
    """Infinite scores are the greatest, and the levels are those of NumPy's percentiles."""
    rng = np.random.default_rng(1)
    a, b = rng.gamma(2, 1, 2000).round(3), rng.gamma(2, 1, 2000).round(3)
    b[:5], a[5:7] = INF, -INF
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "i int, a double, b double").repartition(3)
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x]) / len(x)
    combo = np.maximum(rank(a), rank(b))
    cuts = np.quantile(combo, [0.99, 0.97])
    got = {r["i"]: (r["combo"], r["level"]) for r in shocks.levels(shocks.combo(df, "a", "b"), "combo").collect()}
    assert np.allclose([got[i][0] for i in range(2000)], combo)
    assert [got[i][1] for i in range(2000)] == ["shock" if c >= cuts[0] else "watch" if c >= cuts[1] else "" for c in combo]
    assert shocks.levels(df.where("false").withColumn("combo", F.col("a")), "combo").count() == 0


def test_ranges_of_ends(spark):
    x = [-INF, -1e308, -5e-324, 0.0, 5e-324, 1.0, 1e308, INF, INF, float("nan")]
    df = spark.createDataFrame([(v,) for v in [*x, None]], "x double")
    got = [(r["rank"], r["rank_n"]) for r in whole_rank(df, "x").orderBy("rank").collect()]
    assert got == [(None, None), *[(r, 10) for r in (1, 2, 3, 4, 5, 6, 7, 8.5, 8.5, 10)]]


def test_percentiles_by_key_are_exact(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.lognormal(0, 3, 1001), "b": rng.normal(0, 1, 1000).round(2), "c": np.array([7.0]), "d": np.array([-2.0, -2.0, 5.0, INF]), "e": np.array([1e-9, 1e9])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("f", None)]
    shares = [0.0, 0.1, 0.5, 0.97, 1.0]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {r["k"]: r for r in whole_percentiles(df, "x", shares, "k").collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        want = [-2.0, -2.0, 1.5, INF, INF] if k == "d" else np.quantile(x, shares)
        assert got[k]["n"] == len(x) and np.allclose(got[k]["q"], want), k
    whole = whole_percentiles(df.where("k in ('a', 'b')"), "x", [0.5]).first()
    assert whole["n"] == 2001 and whole["q"] == [np.median(np.concatenate([groups["a"], groups["b"]]))]
    assert whole_percentiles(df.where("false"), "x", [0.5]).count() == 0
