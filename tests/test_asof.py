import random

from pyspark.sql import functions as F

from panelmill.operators.asof import known_asof, with_release
from panelmill.functions import month_number

V = "e long, a string, k int, y int, q int, r int, id long, other string"


def run(spark, events, versions, **kw):
    ev = spark.createDataFrame(events, "sid long, e long, at int, other string")
    ve = spark.createDataFrame(versions, V)
    out = known_asof(ev, ve, "e", "at", "k", "a", ["y", "q", "r"], ["id"], **kw)
    assert set(out.columns) == {"sid", "e", "at", "other", "a", "id"}
    return {(r["sid"], r["a"]): r["id"] for r in out.collect()}


def brute(events, versions):
    want = {}
    for s, e, at, _ in events:
        for a in {v[1] for v in versions if v[1]}:
            known = [v for v in versions if v[0] == e and v[1] == a and v[2] is not None and at is not None and v[2] <= at]
            if known and e is not None:
                want[s, a] = max(known, key=lambda v: (v[3], v[4], v[5], v[6]))[6]
    return want


def test_against_brute_force_with_hot_entity(spark):
    rnd = random.Random(1)
    pick = lambda: 1 if rnd.random() < 0.4 else rnd.randint(1, 6)
    versions = [(pick(), rnd.choice("xyz"), rnd.randint(0, 40), 2020 + rnd.randint(0, 3), rnd.randint(1, 4), rnd.randint(1, 2), i, "v") for i in range(300)]
    events = [(i, pick(), rnd.randint(-2, 45), "e") for i in range(150)]
    for width in (1, 6, 100):
        assert run(spark, events, versions, shard_months=width) == brute(events, versions)


def test_late_news_about_an_old_quarter_does_not_win(spark):
    versions = [(1, "x", 5, 2023, 2, 1, 10, ""), (1, "x", 9, 2023, 1, 2, 11, ""), (1, "x", 7, 2023, 2, 2, 12, "")]
    assert run(spark, [(1, 1, 5, ""), (2, 1, 9, ""), (3, 1, 4, ""), (4, 1, 6, "")], versions) == {(1, "x"): 10, (2, "x"): 12, (4, "x"): 10}


def test_nulls_and_empty(spark):
    versions = [(None, "x", 1, 2023, 1, 1, 1, ""), (1, None, 1, 2023, 1, 1, 2, ""), (1, "x", None, 2023, 1, 1, 3, "")]
    assert run(spark, [(1, 1, 5, None), (2, None, 5, ""), (3, 1, None, "")], versions) == {}
    assert run(spark, [], [(1, "x", 1, 2023, 1, 1, 1, "")]) == {} == run(spark, [(1, 1, 5, "")], [])


def test_release_months(spark):
    df = spark.createDataFrame([("2023-05",), ("05.2023",), (" 2023-12 ",), ("2023-13",), ("soon",), ("",), (None,)], "m string")
    assert [r[0] for r in df.select(month_number(F.col("m"))).collect()] == [2023 * 12 + 4, 2023 * 12 + 4, 2023 * 12 + 11, None, None, None, None]
    q = spark.createDataFrame([("r", 2022, 4, "2022-11"), ("r", 2022, 4, "2022-12"), ("r", 2023, 1, None), ("none", 2023, 1, None)], "indicator string, year int, quarter int, release_month string")
    lag = spark.createDataFrame([("r", 2021, 2023, 6), ("r", 2023, 9999, 5)], "indicator string, year_from int, year_to int, lag_months int")
    got = {(r["indicator"], r["year"], r["release_month"]): r["_known"] for r in with_release(q, lag).collect()}
    assert got == {("r", 2022, "2022-11"): 2022 * 12 + 17, ("r", 2022, "2022-12"): 2022 * 12 + 11, ("r", 2023, None): 2023 * 12 + 7, ("none", 2023, None): None}
