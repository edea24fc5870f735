import math
import random

import pytest

from panelmill.llm.percentiles import percentiles, summaries

PROBS = [0.01, 0.25, 0.5, 0.9, 0.99]


def exact(values, p):
    v = sorted(values)
    return v[max(math.ceil(round(p * 10_000) * len(v) / 10_000), 1) - 1]


def frame(spark, n=3000, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = r.choice([r.gauss(0, 1e3), r.expovariate(1e-4), 5.0, 5.0, 0.0, -r.paretovariate(0.5)])
        rows.append((r.choice(["a", "b", None]), i % 5, r.choice([x, x, x, x, x, None, float("nan"), float("inf"), -float("inf")])))
    return spark.createDataFrame(rows, "g string, day int, x double"), rows


@pytest.mark.parametrize("error", [0.0, 0.005, 0.05])
def test_within_the_stated_error_and_days_combine(spark, error):
    df, rows = frame(spark)
    whole = percentiles(summaries(df, ["g"], ["x"], error), ["g"], PROBS)
    got = {(r["g"], r["p"]): r for r in whole.collect()}
    parts = [summaries(df.where(f"day = {d}"), ["day", "g"], ["x"], error) for d in range(5)]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    again = {(r["g"], r["p"]): r["value"] for r in percentiles(joined, ["g"], PROBS).collect()}
    for g in ("a", "b", None):
        mine = [x for k, _, x in rows if k == g]
        fine = [x for x in mine if x is not None and math.isfinite(x)]
        for p in PROBS:
            r, want = got[g, p], exact(fine, p)
            assert abs(r["value"] - want) <= error * abs(want) + 1e-9 * abs(want)
            assert again[g, p] == r["value"]
            assert (r["n"], r["n_null"], r["n_nan"], r["n_inf"]) == (len(fine), sum(x is None for x in mine), sum(x is not None and math.isnan(x) for x in mine), sum(x is not None and math.isinf(x) for x in mine))


def test_groups_without_numbers_and_empty_table(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 2.0)], "g string, x double")
    got = {(r["g"], r["p"]): (r["value"], r["n"]) for r in percentiles(summaries(df, ["g"], ["x"]), ["g"], [0.5]).collect()}
    assert got["a", 0.5] == (None, 0) and got["b", 0.5][1] == 1 and abs(got["b", 0.5][0] - 2) <= 0.01
    assert percentiles(summaries(df.limit(0), ["g"], ["x"]), ["g"], [0.5]).count() == 0
