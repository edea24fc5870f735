import math
import random

import pytest
from pyspark.sql import functions as F

from panelmill.llm.percentiles import cell_number, cell_value, combine, distinct_summaries, sketched, summaries
from panelmill.sources.tables import row_digest

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 2139.59, -1e-9, None, float("nan"), float("inf"), -float("inf")]


def frame(spark, n, measures=2, seed=0):
    """Half of the rows in one group, null groups, odd values, and every tenth row twice."""
    r = random.Random(seed)
    rows = [(i, r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([1, 2, None]) if i % 2 else 1, *[r.choice(ODD) if r.random() < 0.1 else r.choice([1, -1]) * r.lognormvariate(5, 0.1) for _ in range(measures)]) for i in range(n)]
    names = [f"m{j}" for j in range(measures)]
    return spark.createDataFrame(rows + rows[::10], "id long, g string, day int, " + ", ".join(f"{m} double" for m in names)), names


def moved(spark, df):
    """Records and bytes that df writes to its exchanges."""
    context, group = spark.sparkContext, f"moved-{random.random()}"
    context.setJobGroup(group, group)
    df.write.format("noop").mode("overwrite").save()
    context.setJobGroup("", "")
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    done = [store.lastStageAttempt(s) for s in stages]
    done = [s for s in done if str(s.status()) == "COMPLETE"]
    return sum(s.shuffleWriteRecords() for s in done), sum(s.shuffleWriteBytes() for s in done)


def listed(df, *by):
    return sorted((tuple(r[c] for c in (*by, "measure", "kind", "value", "n")) for r in df.collect()), key=repr)


def test_rows_move_once(spark):
    df, names = frame(spark, 20_000)
    spark.catalog.clearCache()
    records, _ = moved(spark, distinct_summaries(df, row_digest(df)[0], ["day", "g"], names))
    assert 22_000 <= records <= 22_000 * 1.05  # the rows, and the sizes of the groups


@pytest.mark.parametrize("measures", [1, 2, 3, 4, 7])
def test_parts_combine_to_the_summary_without_copies(spark, measures):
    df, names = frame(spark, 3000, measures)
    parts = distinct_summaries(df, row_digest(df)[0], ["day", "g"], names)
    assert listed(combine(parts, ["day", "g"]), "day", "g") == listed(summaries(df.distinct(), ["day", "g"], names), "day", "g")


def test_a_hot_group_is_split(spark):
    df, names = frame(spark, 20_000)
    parts = distinct_summaries(df, row_digest(df)[0], ["day", "g"], names)
    most = parts.groupBy("day", "g", "measure", "kind", "value").count().groupBy("g").agg(F.max("count").alias("k"))
    assert {r["g"]: r["k"] for r in most.collect()}["hot"] > 4


def test_no_groups_and_empty_table(spark):
    df, names = frame(spark, 500)
    assert listed(combine(distinct_summaries(df, row_digest(df)[0], [], names), [])) == listed(summaries(df.distinct(), [], names))
    none = df.limit(0)
    assert distinct_summaries(none, row_digest(none)[0], ["g"], names).count() == 0


@pytest.mark.parametrize("error", [0.3, 0.005, 1e-6])
def test_cells_are_small_integers_and_give_the_representative(spark, error):
    df = spark.createDataFrame([(x,) for x in ODD], "x double")
    for r in df.select("x", cell_number(F.col("x"), error).alias("c"), sketched(F.col("x"), error).alias("want")).withColumn("got", cell_value(F.col("c"), error)).collect():
        assert 0 <= r["c"] < 2**63
        if r["x"] is None or not math.isfinite(r["x"]):
            assert r["c"] < 3 and r["got"] is None
        else:
            assert r["got"] == r["want"]
