import pytest

from panelmill.plans.backtest import backtest


def test_models_that_are_not_built_are_refused(spark):
    rows = spark.createDataFrame([(1, "a", t, 10.0 + t) for t in range(24)], "e long, c string, t int, y double")
    with pytest.raises(ValueError, match="catboost_diff"):
        backtest(rows, ["naive", "catboost_diff"])
