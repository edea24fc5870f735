"""Model registry with inheritance, and the expanding-window backtest."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators import metrics, models, panel
from panelmill.sources.tables import durable

SIMPLE = ["naive", "mean_3", "mean_6", "mean_12", "drift", "seasonal_naive", "seasonal_naive_growth"]
SERIES = {"auto_ets": "ets", "auto_theta": "theta", "auto_arima": "ar"}
#: The roots of the fitted models and what a part of a name changes in them.
ROOTS = {
    "catboost_logdiff": {"kind": "boosted", "target": "log_diff", "loss": "squared"},
    "catboost_diff": {"kind": "boosted", "target": "diff", "loss": "squared"},
    "ridge_logdiff": {"kind": "ridge", "target": "log_diff", "alpha": 1.0},
    "ridge_diff": {"kind": "ridge", "target": "diff", "alpha": 1.0},
}
GROUPS = {"1": "geo", "2": "regional", "3": "population", "4": "rosstat_q", "m": "macro", "n": "news", "r": "calendar"}
PARTS = {
    "ds": {"deseason": "national"}, "dsp": {"deseason": "panel"}, "m1": {"min_t": 1}, "dir": {"strategy": "direct"}, "lmae": {"loss": "absolute"}, "w": {"weight": "level"}, "rel": {"features": ["relative"]},
    "d4": {"depth": 4}, "rw1": {"winsor": 0.01}, "rw5": {"winsor": 0.05}, "sp": {"despike": 5}, "s1": {"seed": 1}, "s2": {"seed": 2}, "rb": {"rebase": True}, "sh": {"features": ["shift"]}, "st": {"features": ["structure", "scluster"]},
    "stx": {"features": ["structure", "scluster", "cross"]}, "tn": {"features": ["trend"]}, "id": {"features": ["moid"]}, "tr": {"features": ["tourism"]}, "ps": {"features": ["pseason"]}, "nz": {"season_unseen": "zero"}, "pd": {"per_day": 1.0},
    "dj": {"drop_jumps": 2}, "rc09": {"recency": 0.9}, "sb05": {"season_blend": 0.5}, "mac": {"features": ["macro"]},
}


def resolve(table: Mapping[str, Mapping], name: str) -> dict:
    """Settings of a named entry: its `base` chain first, own keys replace inherited ones as a whole."""
    own = dict(table[name])
    base = own.pop("base", None)
    return {**(resolve(table, base) if base else {}), **own}


def model_config(name: str) -> dict:
    """Settings of a model by its name: a root and parts joined by '_'; 'g' with digits or letters adds feature groups. Unknown names raise."""
    if name in SIMPLE:
        return {"kind": "simple"}
    if name in SERIES:
        return {"kind": "series", "smoothing": SERIES[name]}
    root = next((r for r in sorted(ROOTS, key=len, reverse=True) if name == r or name.startswith(r + "_")), None)
    if root is None:
        raise ValueError(f"no model {name!r}; models with downloaded weights are not offered")
    out = {**ROOTS[root], "features": []}
    for part in name[len(root) :].split("_")[1:]:
        if part.startswith("g") and part[1:] and set(part[1:]) <= set(GROUPS):
            out["features"] = out["features"] + [GROUPS[c] for c in part[1:]]
        elif part in PARTS:
            change = PARTS[part]
            out |= {k: out["features"] + v if k == "features" else v for k, v in change.items()}
        else:
            raise ValueError(f"unknown part {part!r} in {name!r}")
    return out


def backtest(readings: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Forecast table (model, e, c, origin, step, t, y_true, y_pred, y_last) of simple and smoothing models over the protocol's plan.

    One forecast per origin serves every horizon. Origins count months from the start of the panel.
    """
    names = names or [*SIMPLE, *SERIES]
    if unknown := set(names) - {*SIMPLE, *SERIES}:
        raise ValueError(f"the backtest builds no {', '.join(sorted(unknown))}")
    ends = readings.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if ends["a"] is None:
        raise ValueError("the panel is empty")
    months = ends["b"] - ends["a"] + 1
    parts = []
    for origin, steps in metrics.forecast_plan(months=months).items():
        last = ends["a"] + origin - 1
        simple = [panel.simple_forecasts(readings, last, steps, ends["a"]).where(F.col("model").isin(names))] if set(names) & set(SIMPLE) else []
        smooth = [models.smooth_series(readings, last, steps, SERIES[m]).withColumn("model", F.lit(m)) for m in names if m in SERIES]
        part = reduce(DataFrame.unionByName, [*simple, *smooth])
        parts.append(part.withColumn("origin", F.lit(origin)).withColumn("t", F.lit(last) + F.col("step")))
    out = reduce(DataFrame.unionByName, parts)
    truth = readings.select("e", "c", "t", F.col("y").alias("y_true"))
    base = readings.select("e", "c", (F.col("t") - ends["a"] + 1).alias("origin"), F.col("y").alias("y_last"))
    return out.join(truth, ["e", "c", "t"], "left").join(base, ["e", "c", "origin"], "left")


def recursive_forecast(dense: DataFrame, last: int, steps: int, fit) -> DataFrame:
    """(e, c, step, y_pred): a fitted growth model applied month by month, each prediction entering the features of the next.

    Predicted growth is clipped to the 0.5 % and 99.5 % points of the training target. Each
    month is written to the shared folder, so the plan does not grow with the steps.
    """
    known = dense.where(F.col("t") <= last)
    rows = durable(models.training_rows(panel.features(known), last), "train")
    low, high = rows.agg(F.percentile("target", F.array(F.lit(0.005), F.lit(0.995)))).first()[0]
    predict = fit(rows)
    cells = known.select("e", "c").distinct()
    for k in range(1, steps + 1):
        t = last + k
        grown = known.unionByName(cells.select("e", "c", F.lit(t).alias("t"), F.lit(None).cast("double").alias("y")))
        now = predict(panel.features(grown).where((F.col("t") == t) & F.col("level_1").isNotNull()))
        growth = F.greatest(F.least("prediction", F.lit(high)), F.lit(low))
        new = now.select("e", "c", F.lit(t).alias("t"), F.greatest(F.lit(1.0), F.col("level_1") * F.exp(growth)).alias("y"))
        known = durable(known.unionByName(new), "recursion")
    return known.where(F.col("t") > last).select("e", "c", (F.col("t") - last).alias("step"), F.col("y").alias("y_pred"))


def direct_forecast(dense: DataFrame, last: int, steps: int, fit) -> DataFrame:
    """(e, c, step, y_pred): one fit per step on the mean growth over that many months."""
    f = durable(panel.features(dense.where(F.col("t") <= last + 1)), "features")
    out = []
    for k in range(1, steps + 1):
        ahead = f.select("e", "c", (F.col("t") - k + 1).alias("t"), F.col("l").alias("lk"))
        rows = f.where(F.col("t") <= last).join(ahead, ["e", "c", "t"]).withColumn("target", (F.col("lk") - F.col("log_level_1")) / k).where("target is not null")
        predict = fit(durable(rows, "direct"))
        now = predict(f.where((F.col("t") == last + 1) & F.col("level_1").isNotNull()))
        out.append(now.select("e", "c", F.lit(k).alias("step"), F.greatest(F.lit(1.0), F.col("level_1") * F.exp(F.col("prediction") * k)).alias("y_pred")))
    return reduce(DataFrame.unionByName, out)


def deseasoned(dense: DataFrame, profile: DataFrame) -> DataFrame:
    """y over the exponential of the seasonal level of its calendar month; `reseasoned` takes it back."""
    d = dense.withColumn("moy", F.col("t") % 12).join(profile, ["c", "moy"], "left")
    return d.select("e", "c", "t", (F.col("y") / F.exp(F.coalesce("level", F.lit(0.0)))).alias("y"))


def per_day(dense: DataFrame, power: float, back: bool = False) -> DataFrame:
    """y over (with back: times) the number of days of its month to a power."""
    days = F.pow(F.day(F.last_day(F.make_date(F.floor(F.col("t") / 12).cast("int"), (F.col("t") % 12 + 1).cast("int"), F.lit(1)))), F.lit(float(power)))
    return dense.withColumn("y", F.col("y") * days if back else F.col("y") / days)


def reseasoned(dense: DataFrame, profile: DataFrame) -> DataFrame:
    d = dense.withColumn("moy", F.col("t") % 12).join(profile, ["c", "moy"], "left")
    return d.select("e", "c", "t", (F.col("y") * F.exp(F.coalesce("level", F.lit(0.0)))).alias("y"))
