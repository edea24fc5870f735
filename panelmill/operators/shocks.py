"""Shock detection on deviations (e, t, c, d): scaling, splitting by region, scoring, typing, recovery."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import hash_share
from panelmill.operators.panel import floored_log, quantile_bin, series, with_medians
from panelmill.operators.ranks import whole_percentiles, whole_rank
from panelmill.operators.series import nan_median, per_cell
from panelmill.sources.tables import durable

MIN_REGION = 5
ALL = "Все категории"
#: Shocks that are injected and their multipliers by category (None: one category by draw), their sizes, and size classes of recovery.
SCENARIOS = {
    "all": {ALL: -1.0, "Продовольствие": -1.0, "Здоровье": -1.0, "Маркетплейсы": -1.0, "Общественное питание": -1.0, "Транспорт": -1.0},
    "one": None,
    "emergency": {"Продовольствие": 0.5, "Маркетплейсы": -1.0, "Общественное питание": -1.0, "Транспорт": -0.5, ALL: -1 / 3},
}
SIZES = (0.05, 0.10, 0.20, 0.30)
RECOVERY_EDGES = (0.05, 0.10, 0.20, 0.40)


def peer_deviations(dense: DataFrame, regions: DataFrame) -> DataFrame:
    """(e, c, t, region, d, level_prev): log growth minus the median of the region, or of all in regions of fewer than five."""
    w = series()
    l = F.ln(F.when(F.col("y").isNotNull(), F.greatest("y", F.lit(1.0))))  # noqa: E741
    x = dense.withColumn("l", l).withColumn("g", F.col("l") - F.lag("l", 1).over(w)).withColumn("level_prev", F.lag("y", 1).over(w))
    x = durable(x.join(regions.select("e", "region"), "e").select("e", "c", "t", "region", "g", "level_prev").where("g is not null"), "growth")
    near = x.groupBy("c", "t", "region").agg(F.count(F.lit(1)).alias("_n"), F.median("g").alias("_near")).select(F.col("c").alias("_c"), F.col("t").alias("_t"), F.col("region").alias("_region"), F.when(F.col("_n") >= MIN_REGION, F.col("_near")).alias("_near"))
    x = x.join(near, F.col("c").eqNullSafe(F.col("_c")) & (F.col("t") == F.col("_t")) & F.col("region").eqNullSafe(F.col("_region")), "left").drop("_c", "_t", "_region")
    x = with_medians(x, ["c", "t"], {"_all": "g"})
    return x.select("e", "c", "t", "region", (F.col("g") - F.coalesce("_near", "_all")).alias("d"), "level_prev")


def forecast_deviations(fc: DataFrame) -> DataFrame:
    """(e, c, t, d, level_prev, expected) of one-step forecasts: ln of truth over forecast, both floored at 1."""
    floor = lambda x: F.greatest(F.col(x), F.lit(1.0))
    one = fc.where("step = 1 and y_true is not null and y_pred is not null")
    return one.select(F.col("territory_id").alias("e"), F.col("category").alias("c"), "month", "model", F.ln(floor("y_true") / floor("y_pred")).alias("d"), F.col("y_last").alias("level_prev"), F.col("y_pred").alias("expected"))


def standardise(dev: DataFrame) -> DataFrame:
    """Adds q (size quintile of level_prev within category and month) and z (robust, within category, month and quintile)."""
    x = durable(dev.withColumn("q", quantile_bin("level_prev", 5, ["c", "t"], ["e"])), "sized")
    x = with_medians(x, ["c", "t", "q"], {"_m": "d"})
    x = with_medians(x, ["c", "t", "q"], {"_s": F.abs(F.col("d") - F.col("_m"))})
    return x.withColumn("z", (F.col("d") - F.col("_m")) / F.greatest(1.4826 * F.col("_s"), F.lit(1e-4))).drop("_m", "_s")


def expanding_scale(z: DataFrame, least: int, warm: int | None, floor: float = 1.0, x: str = "z") -> DataFrame:
    """(e, c, t, vol): 1.4826 MAD of the x of earlier months of the series, at least `floor`.

    warm months from the start of the whole table share the scale of those months (a
    look-ahead at the start only); without warm, fewer than `least` earlier months of the
    table give `floor`. One row a series is shuffled; each month is one pass over a matrix of series.
    """

    def scale(v: np.ndarray) -> np.ndarray:
        out = np.full(v.shape, floor)
        for j in range(v.shape[1]):
            past = v[:, : max(j, warm) if warm else j]
            med = nan_median(past)
            mad = 1.4826 * nan_median(np.abs(past - med[:, None]))
            enough = np.isfinite(past).sum(1) >= least
            out[:, j] = np.where(enough & np.isfinite(mad), np.maximum(mad, floor), floor)
        return out

    return per_cell(z.where(F.col(x).isNotNull()).select("e", "c", "t", x), ["e", "c"], [x], "vol", scale)


def rescale(z: DataFrame, vol: DataFrame) -> DataFrame:
    """z divided by the series' own volatility (1 where it is unknown)."""
    return z.join(vol.select("e", "c", "t", "vol"), ["e", "c", "t"], "left").withColumn("z", F.col("z") / F.coalesce("vol", F.lit(1.0))).drop("vol")


def split_region(z: DataFrame, clip: float = 8.0) -> DataFrame:
    """Adds z_reg (median of the region's month, 0 in regions of fewer than five entities) and z_loc = z - z_reg, after clipping z."""
    x = z.withColumn("z", F.greatest(F.least("z", F.lit(clip)), F.lit(-clip)))
    size = x.select("region", "t", "e").distinct().groupBy("region", "t").agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(size, ["region", "t"], "left")
    x = with_medians(x, ["region", "t", "c"], {"_m": "z"})
    x = x.withColumn("z_reg", F.when(F.col("_n") >= MIN_REGION, F.col("_m")).otherwise(0.0))
    return x.withColumn("z_loc", F.col("z") - F.col("z_reg")).drop("_n", "_m")


def top_rms(z: DataFrame, x: str, k: int = 3, fixed: bool = True) -> DataFrame:
    """(e, t, topk): root mean square of the k largest |x| over the categories; with fixed, missing ones count as 0."""
    w = Window.partitionBy("e", "t").orderBy(F.desc(F.abs(x)), "c")
    top = z.where(F.col(x).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    s = F.sum(F.col(x) * F.col(x))
    return top.groupBy("e", "t").agg(F.sqrt(s / (k if fixed else F.count(F.lit(1)))).alias("topk"))


def combine(z: DataFrame, threshold: float = 3.0) -> DataFrame:
    """(e, t, region, score, flag, regional): first detector: clipped z, root mean square of the top three, and whether 30 % of a region of five or more is flagged."""
    x = z.withColumn("z", F.greatest(F.least("z", F.lit(8.0)), F.lit(-8.0)))
    s = top_rms(x, "z", 3, fixed=False).withColumnRenamed("topk", "score")
    s = s.join(z.select("e", "region").distinct(), "e").withColumn("flag", F.col("score") >= threshold)
    w = Window.partitionBy("region", "t")
    share = F.avg(F.col("flag").cast("double")).over(w)
    return s.withColumn("regional", (share >= 0.3) & (F.count(F.lit(1)).over(w) >= MIN_REGION))


def window_sum(z: DataFrame, x: str) -> DataFrame:
    """(e, c, t, w): (this month + the month before) / sqrt 2; a missing month counts as 0."""
    prev = z.select("e", "c", (F.col("t") + 1).alias("t"), F.col(x).alias("_p"))
    return z.join(prev, ["e", "c", "t"], "left").select("e", "c", "t", ((F.coalesce(x, F.lit(0.0)) + F.coalesce("_p", F.lit(0.0))) / 2**0.5).alias("w"))


def combo(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Adds combo: the greater of the two percentile ranks (average ties); no task holds the table."""
    x = whole_rank(whole_rank(scores, a, "_a"), b, "_b")
    return x.withColumn("combo", F.greatest(F.col("_a") / F.col("_a_n"), F.col("_b") / F.col("_b_n"))).drop("_a", "_b", "_a_n", "_b_n")


def levels(scores: DataFrame, x: str, shock: float = 0.99, watch: float = 0.97) -> DataFrame:
    """Adds level: 'shock', 'watch' or '' by exact percentiles of x over all rows (two scalars, by running counts); scores is read three times."""
    q = (whole_percentiles(scores, x, [shock, watch]).first() or {"q": [None, None]})["q"]
    return scores.withColumn("level", F.when(F.col(x) >= F.lit(q[0]), "shock").when(F.col(x) >= F.lit(q[1]), "watch").otherwise(""))


def drivers(z: DataFrame, x: str = "z", d: str = "d", least: float = 2.0, k: int = 3) -> DataFrame:
    """(e, t, main, drivers): category of the largest |x| and a text of the top k with |x| >= least as 'category +p%'."""
    w = Window.partitionBy("e", "t").orderBy(F.desc(F.round(F.abs(x), 9)), "c")
    r = z.where(F.col(x).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    pct = F.round(F.expm1(d) * 100).cast("int")
    part = F.when(F.abs(x) >= least, F.concat(F.col("c"), F.lit(" "), F.when(pct >= 0, "+").otherwise(""), pct.cast("string"), F.lit("%")))
    agg = r.groupBy("e", "t").agg(F.min_by("c", "_r").alias("main"), F.sort_array(F.collect_list(F.struct("_r", part.alias("p")))).alias("_l"))
    return agg.select("e", "t", "main", F.array_join(F.transform("_l", lambda s: s["p"]), ", ").alias("drivers"))


def shock_type(d: Column, p: Column) -> Column:
    """Kind of a shock d by the persistence p of the next month: escalating, level shift, one-off, or a reversal by the sign of d."""
    return F.when(p.isNull(), None).when(p >= 1.5, "escalating").when(p >= 0.5, "level shift").when(p > -0.5, "one-off").when(d < 0, "dip-rebound").otherwise("spike-drop")


def persistence(dev: DataFrame, dense: DataFrame) -> DataFrame:
    """(e, c, t, d, p): p = (ln y of the next month - ln expected - common growth) / d."""
    w = series()
    l = F.ln(F.when(F.col("y").isNotNull(), F.greatest("y", F.lit(1.0))))  # noqa: E741
    x = dense.withColumn("l", l).withColumn("g", F.lead("l", 1).over(w) - F.col("l"))
    x = with_medians(x.withColumn("next", F.lead("l", 1).over(w)), ["c", "t"], {"common": "g"})
    j = dev.join(x.select("e", "c", "t", "l", "next", "common"), ["e", "c", "t"])
    return j.select("e", "c", "t", "d", ((F.col("next") - (F.col("l") - F.col("d")) - F.col("common")) / F.nullif("d", F.lit(0.0))).alias("p"))


def jump_deviations(dense: DataFrame) -> DataFrame:
    """(e, c, t, d, level_prev) of the simplest detector: log growth itself, readings floored at 1; `standardise` makes it comparable."""
    w = series()
    x = dense.withColumn("l", floored_log("y")).withColumn("d", F.col("l") - F.lag("l", 1).over(w)).withColumn("level_prev", F.lag("y", 1).over(w))
    return x.where("d is not null").select("e", "c", "t", "d", "level_prev")


def gaps(dense: DataFrame, regions: DataFrame) -> DataFrame:
    """(e, c, t, region, g): ln y (floored at 1) minus the median of the region's month."""
    x = dense.join(regions.select("e", "region"), "e").withColumn("l", floored_log("y"))
    return with_medians(x, ["c", "t", "region"], {"_m": "l"}).select("e", "c", "t", "region", (F.col("l") - F.col("_m")).alias("g"))


def level_deviations(dense: DataFrame, regions: DataFrame, window: int = 6, least: int = 3) -> DataFrame:
    """(e, c, t, d, level_prev): level against the region (all, in regions of fewer than five) minus its mean over the months before, if `least` of them are there."""
    r = regions.select("e", "region").distinct()
    many = r.join(dense.select("e").distinct(), "e").groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    x = durable(dense.join(r, "e").join(many, "region").withColumn("l", floored_log("y")), "levels")
    x = with_medians(with_medians(x, ["c", "t", "region"], {"_m": "l"}), ["c", "t"], {"_all": "l"})
    x = x.withColumn("r", F.col("l") - F.when(F.col("_n") >= MIN_REGION, F.col("_m")).otherwise(F.col("_all")))
    w = series().rowsBetween(-window, -1)
    x = x.withColumn("d", F.when(F.count("r").over(w) >= least, F.col("r") - F.avg("r").over(w))).withColumn("level_prev", F.lag("y", 1).over(series()))
    return x.where("d is not null and level_prev is not null").select("e", "c", "t", "d", "level_prev")


def level_detector(g: DataFrame, window: int = 6, least: int = 3) -> DataFrame:
    """Adds dev: level against the mean of the six months before, if three are there."""
    w = series().rowsBetween(-window, -1)
    return g.withColumn("dev", F.when(F.count("g").over(w) >= least, F.col("g") - F.avg("g").over(w)))


def cusum(z: DataFrame, x: str, k: float = 0.5) -> DataFrame:
    """Adds cusum: two-sided sum with the start within the last three months, never below 0; missing counts as 0."""
    w = series()
    u = [F.coalesce(x, F.lit(0.0)), F.coalesce(F.lag(x, 1).over(w), F.lit(0.0)), F.coalesce(F.lag(x, 2).over(w), F.lit(0.0))]
    here = [F.lit(True), F.row_number().over(w) > 1, F.row_number().over(w) > 2]
    sums, up, down = [F.lit(0.0)], None, None
    for v, there in zip(u, here):
        up = v - k if up is None else up + v - k
        down = -v - k if down is None else down - v - k
        sums += [F.when(there, up), F.when(there, down)]
    return z.withColumn("cusum", F.greatest(*sums))


def multiplier(scenario: str, pick: str = "pick") -> Column:
    """Multiplier of the category c in a scenario; null where it is not touched. A scenario of one category hits the one named in column `pick`."""
    m = SCENARIOS[scenario]
    if m is None:
        return F.when(F.col("c") == F.col(pick), F.lit(-1.0))
    out = F.lit(None).cast("double")
    for c, v in m.items():
        out = F.when(F.col("c") == c, F.lit(float(v))).otherwise(out)
    return out


def drawn_category(names: list[str], *key: str) -> Column:
    """One of the names by the md5 of the key columns: the same in every engine."""
    return F.element_at(F.array(*[F.lit(c) for c in sorted(names)]), hash_share(F.concat_ws("|", *[F.col(k).cast("string") for k in key])) % len(names) + 1)


def inject(dev: DataFrame, keys: DataFrame, scenario: str, size: float) -> DataFrame:
    """dev with d moved by ln(1 + multiplier * size) at the keys (e, t, and pick for a scenario of one category)."""
    pick = F.col("pick") if "pick" in keys.columns else F.lit(None).cast("string")
    hit = dev.join(keys.select("e", "t", pick.alias("_pick"), F.lit(True).alias("_hit")), ["e", "t"], "left")
    m = multiplier(scenario, "_pick")
    return hit.withColumn("d", F.col("d") + F.when(F.col("_hit") & m.isNotNull(), F.log1p(m * size)).otherwise(0.0)).drop("_hit", "_pick")


def inject_levels(dense: DataFrame, keys: DataFrame, scenario: str, size: float) -> DataFrame:
    """A dense panel whose readings from month t of a key (e, t, pick; one key an entity) on are multiplied by 1 + multiplier * size: a lasting step."""
    hit = dense.join(keys.select("e", F.col("t").alias("_from"), F.col("pick").alias("_pick")), "e", "left")
    m = F.when(F.col("t") >= F.col("_from"), multiplier(scenario, "_pick"))
    return hit.select("e", "c", "t", (F.col("y") * (1 + F.coalesce(m, F.lit(0.0)) * size)).alias("y"))


def recovery(g: DataFrame, events: DataFrame, months: int = 6, least: float = RECOVERY_EDGES[0]) -> DataFrame:
    """(e, c, t, size, k, left): share of a gap's change that is left k months after an event; events whose change is smaller than `least` give none."""
    w = series()
    x = g.withColumn("_b", F.lag("g", 1).over(w))
    for k in range(0, months + 1):
        x = x.withColumn(f"_g{k}", F.lead("g", k).over(w))
    ev = x.join(events.select("e", "c", "t").distinct(), ["e", "c", "t"], "left_semi").withColumn("size", F.col("g") - F.col("_b")).where(F.abs("size") >= least)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), ((F.col(f"_g{k}") - F.col("_b")) / F.col("size")).alias("left")) for k in range(1, months + 1)])
    return ev.select("e", "c", "t", "size", F.explode(rows).alias("r")).select("e", "c", "t", "size", "r.k", "r.left")


def recovery_month(paths: DataFrame, months: int = 6) -> DataFrame:
    """(e, c, t, month): first k with |left| < 1/3; months + 1 if there is none and the last month is known, null if that is unknown."""
    agg = paths.groupBy("e", "c", "t").agg(F.min(F.when(F.abs("left") < 1 / 3, F.col("k"))).alias("hit"), F.max(F.when((F.col("k") == months) & F.col("left").isNotNull(), 1)).alias("known"))
    return agg.select("e", "c", "t", F.when(F.col("hit").isNotNull(), F.col("hit")).when(F.col("known") == 1, F.lit(months + 1)).alias("month"))


def size_class(size: Column) -> Column:
    """Class 0..3 of a change by its size: 5, 10, 20 and 40 % are the lower edges; null below."""
    out = F.when(F.abs(size) >= RECOVERY_EDGES[0], F.lit(0))
    for k, edge in enumerate(RECOVERY_EDGES[1:], 1):
        out = F.when(F.abs(size) >= edge, F.lit(k)).otherwise(out)
    return out


def hit_within(scores: DataFrame, keys: DataFrame, k: int, share: float = 0.99) -> DataFrame:
    """(found, n): part of the keys (e, t) whose entity reaches, in one of the months t..t+k, the `share` point of `score` over the clean cells.

    scores has e, t and score. A cell is clean if its entity has no key or its month lies before the key's.
    """
    x = scores.join(keys.select("e", F.col("t").alias("_from")), "e", "left")
    cut = x.where(F.col("_from").isNull() | (F.col("t") < F.col("_from"))).agg(F.percentile("score", share)).first()[0]
    seen = x.where((F.col("t") >= F.col("_from")) & (F.col("t") <= F.col("_from") + k)).groupBy("e").agg(F.max((F.col("score") >= F.lit(cut)).cast("int")).alias("_hit"))
    return keys.select("e").distinct().join(seen, "e", "left").agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("found"), F.count(F.lit(1)).alias("n"))
