"""Fitted models on panel features: ridge and boosted trees (MLlib), season clusters, per-series smoothing."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ["dlog_1", "dlog_2", "dlog_3", "dev_log_mean3", "dev_log_mean6", "vol_dlog_6", "log_level_1", "dlog_lag12", "sn_gap_log", "yoy_log_1", "common_dlog_1"]


def training_rows(f: DataFrame, last: int) -> DataFrame:
    """Feature rows with their target, log growth, up to month `last`."""
    return f.where(F.col("t") <= last).withColumn("target", F.col("l") - F.col("log_level_1")).where("target is not null")


def fit_ridge(rows: DataFrame, alpha: float = 1.0):
    """Ridge with medians for gaps and a flag for each; columns are scaled by the population deviation; MLlib's penalty is set so that it equals alpha * |w|^2."""
    rows = rows.withColumns({f"{c}_isna": F.col(c).isNull().cast("double") for c in NUMERIC})
    filled = Imputer(strategy="median", inputCols=NUMERIC, outputCols=[f"{c}_f" for c in NUMERIC]).fit(rows)
    x = filled.transform(rows)
    s = x.agg(*[F.avg(f"{c}_f").alias(f"{c}_m") for c in NUMERIC], *[F.stddev_pop(f"{c}_f").alias(f"{c}_s") for c in NUMERIC], F.stddev_pop("target").alias("sd"), F.count(F.lit(1)).alias("n")).first()

    def scale(d: DataFrame) -> DataFrame:
        return d.withColumns({f"{c}_z": (F.col(f"{c}_f") - s[f"{c}_m"]) / (s[f"{c}_s"] or 1.0) for c in NUMERIC})

    columns = [f"{c}_z" for c in NUMERIC] + [f"{c}_isna" for c in NUMERIC]
    reg = LinearRegression(featuresCol="x", labelCol="target", solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha * (s["sd"] or 1.0) / s["n"])
    model = reg.fit(VectorAssembler(inputCols=columns, outputCol="x").transform(scale(x)))

    def predict(d: DataFrame) -> DataFrame:
        d = d.withColumns({f"{c}_isna": F.col(c).isNull().cast("double") for c in NUMERIC})
        d = VectorAssembler(inputCols=columns, outputCol="x").transform(scale(filled.transform(d)))
        return model.transform(d).drop("x", *columns, *[f"{c}_f" for c in NUMERIC])

    return predict


def fit_boosted(rows: DataFrame, rounds: int = 20, depth: int = 5, step: float = 0.1, loss: str = "squared", seed: int = 42):
    """Boosted trees on the same columns; gaps become a value below all others. Stands for the reference's boosting library, whose numbers it does not repeat."""
    low = rows.agg(*[(F.min(c) - 1).alias(c) for c in NUMERIC]).first()
    fill = {c: low[c] if low[c] is not None else -1.0 for c in NUMERIC}
    stages = [StringIndexer(inputCol="c", outputCol="c_i", handleInvalid="keep"), VectorAssembler(inputCols=[*NUMERIC, "c_i"], outputCol="x"), GBTRegressor(featuresCol="x", labelCol="target", maxIter=rounds, maxDepth=depth, stepSize=step, lossType=loss, seed=seed)]
    model = Pipeline(stages=stages).fit(rows.fillna(fill))
    return lambda d: model.transform(d.fillna(fill)).drop("x", "c_i")


def forecast_next(f: DataFrame, predict, t: int) -> DataFrame:
    """(e, c, y_true, y_pred) for month t: the last level times exp of the predicted growth, at least 1."""
    rows = f.where((F.col("t") == t) & F.col("level_1").isNotNull())
    return predict(rows).select("e", "c", F.col("y").alias("y_true"), F.greatest(F.lit(1.0), F.col("level_1") * F.exp("prediction")).alias("y_pred"))


def season_clusters(dense: DataFrame, k: int = 8, seed: int = 0) -> DataFrame:
    """(e, c, cluster): k-means of the twelve calendar-month means of ln y against the month's median."""
    l = F.when(F.col("y") > 0, F.ln("y"))  # noqa: E741
    r = dense.withColumn("l", l).withColumn("r", F.col("l") - F.median("l").over(Window.partitionBy("c", "t")))
    r = r.withColumn("r", F.col("r") - F.avg("r").over(Window.partitionBy("e", "c")))
    wide = r.groupBy("e", "c").agg(*[F.coalesce(F.avg(F.when(F.col("t") % 12 == m, F.col("r"))), F.lit(0.0)).alias(f"m{m}") for m in range(12)])
    x = VectorAssembler(inputCols=[f"m{m}" for m in range(12)], outputCol="x").transform(wide)
    return KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster").fit(x).transform(x).select("e", "c", "cluster")


def smooth_series(panel: DataFrame, last: int, steps: int, kind: str) -> DataFrame:
    """(e, c, step, y_pred): per-series exponential smoothing: 'ets' (simple, weight by squared error) or 'theta' (smoothing plus half the line's slope) or 'ar' (first-order autoregression on growth). Stand-ins for library models; too short series repeat the last value."""
    arrays = panel.where((F.col("t") <= last) & F.col("y").isNotNull()).groupBy("e", "c").agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("s"))
    flat = arrays.select("e", "c", F.col("s.y").alias("y"))

    def run(batches):
        for pdf in batches:
            rows = [_smooth(np.asarray(y, float), steps, kind) for y in pdf["y"]]
            out = pdf.loc[pdf.index.repeat(steps), ["e", "c"]].reset_index(drop=True)
            out["step"] = np.tile(np.arange(1, steps + 1, dtype="int32"), len(pdf))
            out["y_pred"] = np.concatenate(rows) if rows else np.zeros(0)
            yield out

    return flat.mapInPandas(run, flat.select("e", "c").schema.simpleString()[7:-1] + ", step int, y_pred double")


def _level(y: np.ndarray, a: float) -> tuple[float, float]:
    s, err = y[0], 0.0
    for v in y[1:]:
        err += (v - s) ** 2
        s += a * (v - s)
    return err, s


def _smooth(y: np.ndarray, steps: int, kind: str) -> np.ndarray:
    k = np.arange(1, steps + 1)
    if len(y) < 4:
        return np.full(steps, y[-1])
    if kind == "ar":
        g = np.diff(np.log(np.maximum(y, 1)))
        a, b = g[:-1] - g[:-1].mean(), g[1:] - g[1:].mean()
        phi = float(np.clip((a * b).sum() / max((a * a).sum(), 1e-12), -0.9, 0.9))
        m, x, out = g.mean(), g[-1], []
        for _ in k:
            x = m + phi * (x - m)
            out.append(x)
        return y[-1] * np.exp(np.cumsum(out))
    grid = np.linspace(0.05, 1, 20)
    a = min(grid, key=lambda v: _level(y, v)[0])
    s = _level(y, a)[1]
    if kind == "theta":
        slope = np.polyfit(np.arange(len(y)), y, 1)[0]
        return np.maximum(s + slope / 2 * k, 1.0)
    return np.full(steps, max(s, 1.0))

