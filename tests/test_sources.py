from panelmill.sources.tables import durable, exact_rows, write_cells


def test_exact_rows_counts_copies_once(spark):
    rows = [(1, None, 2.0), (1, 2.0, None), (1, None, 2.0), (1, float("nan"), None), (1, float("nan"), None), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "a long, b double, `c d` double")
    assert exact_rows(df).count() == 4
    assert exact_rows(df, "a").count() == 4
    assert exact_rows(df.limit(0)).count() == 0


def test_durable_has_no_lineage(spark):
    df = durable(spark.range(10), "t")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_replaced_or_kept(spark, tmp_path):
    at = str(tmp_path / "cells")
    one = spark.createDataFrame([("m", "c", 1), ("m", "d", 2)], "model string, category string, v int")
    write_cells(one, at, ["model", "category"], overwrite=False)
    two = spark.createDataFrame([("m", "d", 9), ("n", "c", 3)], "model string, category string, v int")
    write_cells(two, at, ["model", "category"], overwrite=False)
    read = lambda: {(r["model"], r["category"]): r["v"] for r in spark.read.parquet(at).collect()}
    assert read() == {("m", "c"): 1, ("m", "d"): 2, ("n", "c"): 3}
    write_cells(two, at, ["model", "category"])
    assert read() == {("m", "c"): 1, ("m", "d"): 9, ("n", "c"): 3}
