"""Choosing among forecasts: rules, online choice, intervals, ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.operators.panel import with_medians
from panelmill.operators.ranks import whole_bins


def common_month_r2(dense: DataFrame) -> DataFrame:
    """(c, r2): share of the variance of log growth (readings floored at 1) that the month's median explains."""
    w = Window.partitionBy("c", "e").orderBy("t")
    l = F.ln(F.when(F.col("y").isNotNull(), F.greatest("y", F.lit(1.0))))  # noqa: E741
    g = dense.withColumn("l", l).withColumn("g", F.col("l") - F.lag("l", 1).over(w)).where("g is not null")
    g = with_medians(g, ["c", "t"], {"m": "g"}).withColumn("r", F.col("g") - F.col("m"))
    return g.groupBy("c").agg((1 - F.var_pop("r") / F.nullif(F.var_pop("g"), F.lit(0.0))).alias("r2"))


def errors(rows: DataFrame) -> DataFrame:
    """Mean absolute error by model, category, horizon, origin and month."""
    ae = F.abs(F.col("y_pred") - F.col("y_true"))
    return rows.where("y_pred is not null").groupBy("model", "category", "horizon", "origin", "step", "month").agg(F.avg(ae).alias("ae"))


def online_choice(err: DataFrame) -> DataFrame:
    """(category, horizon, origin, model, past_ae): at each origin the model with the least mean error over months known by then.

    A month is known at an origin if its step began early enough: origin + step - 1 < the
    deciding origin. Only models with past errors compete; ties by name.
    """
    asked = err.select("category", "horizon", F.col("origin").alias("at")).distinct()
    known = err.join(asked, ["category", "horizon"]).where(F.col("origin") + F.col("step") <= F.col("at"))
    past = known.groupBy("category", "horizon", "at", "model").agg(F.avg("ae").alias("past_ae"))
    rn = F.row_number().over(Window.partitionBy("category", "horizon", "at").orderBy(F.round("past_ae", 9), "model"))
    return past.withColumn("rn", rn).where("rn = 1").select("category", "horizon", F.col("at").alias("origin"), "model", "past_ae")


def rule_choice(dense: DataFrame, homogeneous: str, heterogeneous: str, months: int | None = None, threshold: float = 0.5) -> DataFrame:
    """(category, model): `homogeneous` where a common month explains at least `threshold` of the growth in the first `months` months, else `heterogeneous`."""
    d = dense if months is None else dense.where(F.col("t") < F.lit(dense.agg(F.min("t")).first()[0] + months))
    return common_month_r2(d).select(F.col("c").alias("category"), F.when(F.col("r2") >= threshold, homogeneous).otherwise(heterogeneous).alias("model"))


def online_final(rows: DataFrame, rule: DataFrame, candidates: Sequence[str], window: int | None = None) -> DataFrame:
    """Forecasts of the candidate that did best so far: category, territory_id, origin, step, month, model, y_true, y_pred.

    rows are protocol rows. For each (category, horizon, origin) the candidate with the least mean error over
    earlier origins of the same horizon whose month was known by then (of the last `window` months, if given); while some
    candidate has no such error, that of `rule` (category, model). A row that serves several
    horizons comes from the shortest one. Ties by name.
    """
    x = rows.where(F.col("model").isin(list(candidates)) & F.col("y_pred").isNotNull())
    ae = F.abs(F.col("y_pred") - F.col("y_true"))
    known = x.groupBy("category", "horizon", "origin", "step", "model").agg(F.sum(ae).alias("s"), F.count(F.lit(1)).alias("k"))
    asked = known.select("category", "horizon", F.col("origin").alias("at")).distinct()
    past = known.join(asked, ["category", "horizon"]).where((F.col("origin") < F.col("at")) & (F.col("origin") + F.col("step") <= F.col("at")))
    if window:
        past = past.where(F.col("origin") + F.col("step") - 1 >= F.col("at") - window)
    mae = past.groupBy("category", "horizon", "at", "model").agg((F.sum("s") / F.sum("k")).alias("mae"))
    best = mae.groupBy("category", "horizon", "at").agg(F.min_by("model", F.struct(F.round("mae", 9), "model")).alias("best"), F.count(F.lit(1)).alias("n"))
    chosen = asked.join(best, ["category", "horizon", "at"], "left").join(rule.select("category", F.col("model").alias("rule")), "category", "left")
    chosen = chosen.select("category", "horizon", F.col("at").alias("origin"), F.when(F.col("n") == len(candidates), F.col("best")).otherwise(F.col("rule")).alias("model"))
    out = x.join(chosen, ["category", "horizon", "origin", "model"])
    key = ["category", "territory_id", "origin", "step"]
    least = F.min_by(F.struct("month", "model", "y_true", "y_pred"), F.struct("horizon", "run_id"))
    return out.groupBy(*key).agg(least.alias("r")).select(*key, "r.*")


def residuals(rows: DataFrame, dense: DataFrame, shocked: DataFrame) -> DataFrame:
    """Protocol rows with r = ln(truth / forecast) (both floored at 1), vol_q, after_shock and first_half.

    vol_q is the quintile, within category and horizon, of the spread of the growth of the series before the
    origin (over rows; ties by territory, origin, step). after_shock: the entity had a
    shock (shocked: e, t) in the last known month. Null where no growth is known.
    """
    one = lambda c: F.greatest(F.col(c), F.lit(1.0))
    start = dense.agg(F.min("t")).first()[0] or 0
    w = Window.partitionBy("c", "e").orderBy("t")
    l = F.ln(F.when(F.col("y").isNotNull(), one("y")))  # noqa: E741
    g = dense.withColumn("l", l).withColumn("g", F.col("l") - F.lag("l", 1).over(w)).select("e", "c", "t", F.stddev_pop("g").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("vol"))
    vol = g.select(F.col("e").alias("territory_id"), F.col("c").alias("category"), (F.col("t") - start + 1).alias("origin"), "vol")
    r = rows.where("y_pred is not null and y_true is not null").join(vol, ["territory_id", "category", "origin"], "left")
    hit = shocked.select(F.col("e").alias("territory_id"), (F.col("t") - start + 1).alias("origin"), F.lit(True).alias("_hit")).distinct()
    r = r.join(hit, ["territory_id", "origin"], "left").withColumn("after_shock", F.col("_hit").isNotNull()).drop("_hit")
    r = r.withColumn("r", F.ln(one("y_true") / one("y_pred"))).withColumn("first_half", F.substring("month", 6, 2).cast("int") <= 6)
    r = r.withColumn("_k", F.concat_ws("|", "category", F.col("horizon").cast("string"))).withColumn("_tie", F.col("territory_id") * 10_000 + F.col("origin") * 100 + F.col("step"))
    return whole_bins(r, "vol", 5, "_tie", "vol_q", "_k").drop("_k", "_tie")


def bands(r: DataFrame, share: float = 0.9) -> DataFrame:
    """(category, horizon, vol_q, lo, hi): the middle `share` of the residuals."""
    tail = (1 - share) / 2
    q = F.percentile("r", F.array(F.lit(tail), F.lit(1 - tail)))
    return r.groupBy("category", "horizon", "vol_q").agg(q.alias("_q")).select("category", "horizon", "vol_q", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def shock_factor(r: DataFrame, fitted: DataFrame, share: float = 0.9) -> DataFrame:
    """One row, k: by how much bands must widen after a shock to hold `share` of those rows; at least 1."""
    x = r.where("after_shock").join(fitted, ["category", "horizon", "vol_q"])
    return x.agg(F.greatest(F.lit(1.0), F.coalesce(F.percentile(F.abs("r") / F.nullif((F.col("hi") - F.col("lo")) / 2, F.lit(0.0)), share), F.lit(1.0))).alias("k"))


def band_coverage(r: DataFrame, fitted: DataFrame, k: float = 1.0) -> DataFrame:
    """(category, horizon, coverage, coverage_after_shock, n_after_shock, width): share of the rows inside, bands being k times as wide after a shock; width is the median in percent of the level."""
    x = r.join(fitted, ["category", "horizon", "vol_q"])
    mid, half = (F.col("lo") + F.col("hi")) / 2, (F.col("hi") - F.col("lo")) / 2 * F.when(F.col("after_shock"), F.lit(k)).otherwise(1.0)
    inside = ((F.col("r") >= mid - half) & (F.col("r") <= mid + half)).cast("double")
    return x.groupBy("category", "horizon").agg(
        (100 * F.avg(inside)).alias("coverage"), (100 * F.avg(F.when(F.col("after_shock"), inside))).alias("coverage_after_shock"), F.count_if("after_shock").alias("n_after_shock"), (100 * F.median(F.expm1(2 * half))).alias("width"))


def next_year(forecasts: DataFrame, choice: DataFrame, fitted: DataFrame, dense: DataFrame, shocked: DataFrame, k: float = 1.3, horizons: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """Forecasts after the last month with bands: category, territory_id, step, model, y_pred, lo90, hi90, shock.

    forecasts: (e, c, step, model, y_pred) of all candidates. A step takes the model that `choice` (category, horizon, model) names
    for the least horizon that covers it, and the band of that horizon and of the volatility quintile of the
    series over all months (within the category, ties by entity); k times as wide where the entity is in `shocked` (e).
    """
    w = Window.partitionBy("c", "e").orderBy("t")
    l = F.ln(F.when(F.col("y").isNotNull(), F.greatest("y", F.lit(1.0))))  # noqa: E741
    vol = dense.withColumn("l", l).withColumn("g", F.col("l") - F.lag("l", 1).over(w)).groupBy("e", "c").agg(F.stddev_pop("g").alias("vol"))
    vol = whole_bins(vol, "vol", 5, "e", "vol_q", "c").drop("vol")
    f = next_horizon(forecasts, horizons).withColumnRenamed("bucket", "horizon").join(choice.select(F.col("category").alias("c"), "horizon", "model"), ["c", "horizon", "model"])
    f = f.join(vol, ["e", "c"], "left").join(fitted.withColumnRenamed("category", "c"), ["c", "horizon", "vol_q"], "left")
    f = f.join(shocked.select("e", F.lit(True).alias("_s")).distinct(), "e", "left").withColumn("shock", F.col("_s").isNotNull())
    mid, half = (F.col("lo") + F.col("hi")) / 2, (F.col("hi") - F.col("lo")) / 2 * F.when(F.col("shock"), F.lit(k)).otherwise(1.0)
    return f.select(F.col("c").alias("category"), F.col("e").alias("territory_id"), "step", "model", "y_pred", (F.col("y_pred") * F.exp(mid - half)).alias("lo90"), (F.col("y_pred") * F.exp(mid + half)).alias("hi90"), "shock")


def monthly_choice(rows: DataFrame, default: str, last: int = 3) -> DataFrame:
    """One-step choice month by month: (category, month, chosen, best_all, best_<last>, top3_all): errors of the rules.

    rows has one-step forecasts: model, category, territory_id, month, y_true, y_pred. In each month every rule picks by the mean, over the months
    before (all, or the `last` ones of the category), of the monthly mean errors: the best model, or the mean forecast of the best three. The first month takes
    `default`. Ties by name.
    """
    ae = F.abs(F.col("y_pred") - F.col("y_true"))
    key = ["category", "territory_id", "month"]
    one = rows.where("y_pred is not null").groupBy(*key, "model").agg(F.avg("y_pred").alias("y_pred"), F.max("y_true").alias("y_true"))
    mae = one.groupBy("category", "model", "month").agg(F.avg(ae).alias("mae"))
    line = mae.select("category", "month").distinct().withColumn("i", F.row_number().over(Window.partitionBy("category").orderBy("month")))
    mae = mae.join(line, ["category", "month"])
    past = line.select("category", F.col("month").alias("at"), F.col("i").alias("j")).join(mae, "category").where("i < j")
    score = past.groupBy("category", "at", "model").agg(F.avg("mae").alias("all"), F.avg(F.when(F.col("i") >= F.col("j") - last, F.col("mae"))).alias("late"))
    place = lambda c: F.row_number().over(Window.partitionBy("category", "at").orderBy(F.round(c, 9).asc_nulls_last(), "model"))
    score = score.withColumn("p_all", place("all")).withColumn("p_late", place("late"))
    first = line.where("i = 1").select("category", F.col("month").alias("at"), F.lit(default).alias("model"), F.lit(1).alias("p_all"), F.lit(1).alias("p_late"))
    picks = score.select("category", "at", "model", "p_all", "p_late").unionByName(first).where("p_all <= 3 or p_late = 1").withColumnRenamed("at", "month")
    x = one.join(picks, ["category", "month", "model"])
    each = x.groupBy(*key).agg(F.max("y_true").alias("y_true"), *[F.avg(F.when(c, F.col("y_pred"))).alias(n) for n, c in (("best_all", F.col("p_all") == 1), (f"best_{last}", F.col("p_late") == 1), ("top3_all", F.col("p_all") <= 3))])
    err = each.groupBy("category", "month").agg(*[F.avg(F.abs(F.col(n) - F.col("y_true"))).alias(n) for n in ("best_all", f"best_{last}", "top3_all")])
    return err.join(picks.where("p_all = 1").select("category", "month", F.col("model").alias("chosen")), ["category", "month"])


def ensemble(rows: DataFrame, best: DataFrame, k: int = 3) -> DataFrame:
    """Mean forecast of the k models with the least error of each cell (category, horizon)."""
    w = Window.partitionBy("category", "horizon").orderBy(F.round("MAE", 9), "model")
    top = best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("category", "horizon", "model")
    key = ["category", "horizon", "territory_id", "origin", "step", "month"]
    return rows.where("y_pred is not null").join(top, ["category", "horizon", "model"]).groupBy(*key).agg(F.avg("y_pred").alias("y_pred"), F.max("y_true").alias("y_true"), F.count(F.lit(1)).alias("models"))


def next_horizon(steps: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """Adds bucket: the least horizon that covers the step."""
    return steps.withColumn("bucket", F.array_min(F.filter(F.array(*map(F.lit, horizons)), lambda h: h >= F.col("step"))))
