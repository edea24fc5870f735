"""Queries of the backtest, the recursive and direct strategies, seasonal scaling and detector calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelmill.operators import models, panel, shocks
from panelmill.plans import backtest
from panelmill.plans.panels import PROFILE_SQL, SIMPLE_SQL, get_dense, get_regions
from panelmill.plans.registry import Registry
from panelmill.plans.shock_queries import get_peer
from panelmill.plans.sql import DENSE, GROWTH
from panelmill.sources.tables import durable, read_table

REG = Registry()


def _usable(spark, sf_dir):
    return get_dense(spark, sf_dir).withColumn("y", F.when(F.col("y") > 0, F.col("y")))


PLAN_SQL = "o AS (SELECT origin, max(h) AS steps FROM (SELECT unnest([1, 3, 6, 12]) AS h), (SELECT unnest(range(12, 24)) AS origin) WHERE (origin - 12) % h = 0 AND origin + h <= (SELECT max(t) - min(t) + 1 FROM dense) GROUP BY origin)"


@REG.add(f"WITH {DENSE}, {PLAN_SQL}, {SIMPLE_SQL} SELECT s.e, s.c, s.origin, s.step, s.t, s.model, s.y_pred, a.y AS y_true, b.y AS y_last FROM simple s LEFT JOIN dense a ON a.e = s.e AND a.c = s.c AND a.t = s.t LEFT JOIN dense b ON b.e = s.e AND b.c = s.c AND b.t = s.t - s.step", "y_pred y_true y_last")
def ref_e03_backtest(spark, sf_dir):
    return backtest.backtest(durable(get_dense(spark, sf_dir), "dense"), backtest.SIMPLE)


@REG.add()
def ref_m06_series_models(spark, sf_dir):
    return backtest.backtest(durable(get_dense(spark, sf_dir), "dense"), list(backtest.SERIES))


@REG.add()
def ref_p22_recursive_ridge(spark, sf_dir):
    d = durable(_usable(spark, sf_dir), "dense")
    return backtest.recursive_forecast(d, d.agg(F.max("t")).first()[0] - 3, 3, models.fit_ridge)


@REG.add()
def ref_p21_direct_ridge(spark, sf_dir):
    d = durable(_usable(spark, sf_dir), "dense")
    return backtest.direct_forecast(d, d.agg(F.max("t")).first()[0] - 3, 3, models.fit_ridge)


@REG.add(f"WITH {GROWTH}, {PROFILE_SQL} SELECT d.e, d.c, d.t, d.y / exp(coalesce(level, 0)) AS y FROM dense d LEFT JOIN pf ON d.c = pf.c AND d.t % 12 = pf.moy", "y")
def ref_p20_deseason(spark, sf_dir):
    d = get_dense(spark, sf_dir)
    return backtest.deseasoned(d, panel.season_profile(d))


@REG.add(f"WITH {GROWTH}, {PROFILE_SQL} SELECT d.e, d.c, d.t, d.y / exp(coalesce(level, 0)) / day(last_day(make_date(CAST(d.t // 12 AS INT), CAST(d.t % 12 + 1 AS INT), 1))) AS y FROM dense d LEFT JOIN pf ON d.c = pf.c AND d.t % 12 = pf.moy", "y")
def ref_p20_deseason_per_day(spark, sf_dir):
    d = get_dense(spark, sf_dir)
    return backtest.deseasoned(backtest.per_day(d, 1.0), panel.season_profile(d))


@REG.add()
def ref_t07_seeded_sample(spark, sf_dir):
    return read_table(spark, sf_dir, "top_shocks_news").select("shock_id").distinct().orderBy(F.xxhash64(F.lit(42), "shock_id"), "shock_id").limit(400)


ALL = shocks.ALL
SHOCKS = shocks.SCENARIOS
SIZES = shocks.SIZES
FIRST_TEST = 2024 * 12
COPY = 1_000_000  # copies of the panel, one for each draw, lie so many months apart, so that every month of a copy is scored by itself


def _draw_keys(dev, draw: int, count: int, seed: int):
    """(draw, e, t, pick): so many entity-months of the test by a seeded hash, each with a category."""
    names = sorted(r["c"] for r in dev.select("c").distinct().collect())
    pick = F.element_at(F.array(*[F.lit(c) for c in names]), (F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(draw), "e", "t"), F.lit(len(names))) + 1).cast("int"))
    base = dev.select("e", "t").distinct().orderBy(F.xxhash64(F.lit(seed), F.lit(draw), "e", "t"), "e", "t").limit(count)
    return base.select(F.lit(draw).alias("draw"), "e", "t", pick.alias("pick"))


def _score_draws(copies, keys, draws: list[tuple[int, str, float]]):
    """Copies (draw and the columns of dev) with the shocks of their draw at the keys, scored: e, c, region, t (with the copy), z, z_reg, z_loc."""
    mult = F.lit(None).cast("double")
    for k, name, x in draws:
        one = F.when(F.col("c") == F.col("pick"), -1.0)
        m = SHOCKS[name]
        here = one if m is None else F.try_element_at(F.create_map(*[F.lit(v) for kv in m.items() for v in kv]), F.col("c"))
        mult = F.when(F.col("draw") == k, here * x).otherwise(mult)
    hit = copies.join(F.broadcast(keys.withColumn("_hit", F.lit(True))), ["draw", "e", "t"], "left")
    hit = hit.withColumn("d", F.col("d") + F.coalesce(F.when(F.col("_hit"), F.log1p(mult)), F.lit(0.0)))
    return durable(shocks.split_region(shocks.standardise(hit.withColumn("t", F.col("t") + F.col("draw") * COPY).drop("draw", "pick", "_hit"))), "copies")


def _by_draw(scored):
    return scored.withColumn("draw", F.floor(F.col("t") / COPY).cast("int")).withColumn("t", (F.col("t") % COPY).cast("int"))


def _against_clean(scored, keys, by: list[str]):
    """Share of hit rows and of clean rows that reach the 99 % point of the clean rows of their draw, in percent, and the hit rows."""
    rows = scored.join(F.broadcast(keys.select("draw", "e", "t").withColumn("_hit", F.lit(True))), ["draw", "e", "t"], "left").withColumn("_hit", F.col("_hit").isNotNull())
    cut = rows.where(~F.col("_hit")).groupBy("draw").agg(F.percentile("topk", 0.99).alias("cut"))
    over = (F.col("topk") >= F.col("cut")).cast("double")
    return rows.join(F.broadcast(cut), "draw").groupBy("draw", *by).agg((100 * F.avg(F.when(F.col("_hit"), over))).alias("found"), (100 * F.avg(F.when(~F.col("_hit"), over))).alias("false_alarms"), F.count_if("_hit").alias("n"))


def _named(rows, draws: list[tuple[int, str, float]]):
    label = F.create_map(*[v for k, name, x in draws for v in (F.lit(k), F.struct(F.lit(name).alias("scenario"), F.lit(x).alias("x")))])
    return rows.withColumn("_l", label[F.col("draw")]).select("_l.scenario", "_l.x", *[c for c in rows.columns if c != "draw"])


def _injected(dev, draws: list[tuple[int, str, float]], count: int, seed: int):
    keys = None
    for k, _, _ in draws:
        one = _draw_keys(dev, k, count, seed)
        keys = one if keys is None else keys.unionByName(one)
    keys = durable(keys, "keys")
    copies = dev.withColumn("draw", F.explode(F.array(*[F.lit(k) for k, _, _ in draws])))
    return keys, _score_draws(copies, keys, draws)


def _regional(dev, draws_each: int = 20, seed: int = 0):
    """Shocks of a whole region in one month: only that month is scored anew, as months do not touch each other; the others come from the untouched copy."""
    many = dev.groupBy("region").agg(F.countDistinct("e").alias("n")).where((F.col("n") >= shocks.MIN_REGION) & F.col("region").isNotNull())
    regions, months = sorted(r["region"] for r in many.collect()), sorted(r["t"] for r in dev.select("t").distinct().collect())
    if not regions:
        return None
    rng = np.random.default_rng(seed)
    draws = [(1 + i, "all", x) for i, x in enumerate(np.repeat(SIZES, draws_each).tolist())]
    chosen = [(k, regions[rng.integers(len(regions))], months[rng.integers(len(months))]) for k, _, _ in draws]
    places = F.array(*[F.struct(F.lit(k).alias("draw"), F.lit(r).alias("r"), F.lit(m).alias("m")) for k, r, m in chosen])
    copies = dev.withColumn("_p", F.explode(F.filter(places, lambda p: p["m"] == F.col("t"))))
    keys = durable(copies.where("_p.r = region").select("_p.draw", "e", "t", F.lit(None).cast("string").alias("pick")).distinct(), "keys")
    z = _score_draws(copies.withColumn("draw", F.col("_p.draw")).drop("_p").unionByName(dev.withColumn("draw", F.lit(0))), keys, draws)
    at = z.select("e", "t", "region").distinct()
    kinds = {"regional": (shocks.top_rms(z.select(F.col("region").alias("e"), "c", "t", "z_reg").distinct(), "z_reg").withColumn("region", F.col("e")), 0.98)}
    kinds |= {name: (shocks.top_rms(z, x).join(at, ["e", "t"]), 0.99) for name, x in (("topk", "z_loc"), ("topk without regions", "z"))}
    out = None
    for name, (scored, share) in kinds.items():
        s = durable(_by_draw(scored), "scored")
        clean = s.where("draw = 0").drop("draw").withColumn("_p", F.explode(F.filter(places, lambda p: p["m"] != F.col("t")))).select("_p.draw", "topk", F.lit(False).alias("hit"))
        own = s.where("draw > 0").withColumn("_p", F.element_at(F.filter(places, lambda p: p["draw"] == F.col("draw")), 1)).select("draw", "topk", F.col("region").eqNullSafe(F.col("_p.r")).alias("hit"))
        rows = clean.unionByName(own)
        cut = rows.where("not hit").groupBy("draw").agg(F.percentile("topk", share).alias("cut"))
        each = rows.where("hit").join(F.broadcast(cut), "draw").groupBy("draw").agg(F.avg((F.col("topk") >= F.col("cut")).cast("double")).alias("f"), F.count(F.lit(1)).alias("k"))
        got = _named(each, draws).groupBy("x").agg((100 * F.avg("f")).alias("found"), F.sum("k").alias("n")).select(F.lit("region").alias("scenario"), "x", F.lit(name).alias("score"), "found", "n")
        out = got if out is None else out.unionByName(got)
    return out


@REG.add()
def ref_p32_calibration(spark, sf_dir):
    """Share of injected shocks found at one false alarm in a hundred test entity-months without a shock, by scenario, size and score.

    Each of the 3 x 4 draws hits 400 entity-months of the test; 20 draws a size hit a whole region in one month.
    """
    dev = durable(get_peer(spark, sf_dir).where(F.col("t") >= FIRST_TEST), "peer")
    draws = [(k, name, x) for k, (name, x) in enumerate((name, x) for name in SHOCKS for x in SIZES)]
    keys, z = _injected(dev, draws, 400, 5)
    out = None
    for name, x in (("topk", "z_loc"), ("topk without regions", "z")):
        row = _named(_against_clean(_by_draw(shocks.top_rms(z, x)), keys, []), draws).select("scenario", "x", F.lit(name).alias("score"), "found", "n")
        out = row if out is None else out.unionByName(row)
    # deviations from the region's own median hold nothing regional: whole regions are tried on deviations from the median of all
    regions = get_regions(spark, sf_dir).select("e", "region")
    common = shocks.peer_deviations(get_dense(spark, sf_dir), regions.withColumn("region", F.lit(""))).drop("region").join(regions, "e")
    regional = _regional(durable(common.where(F.col("t") >= FIRST_TEST), "common"))
    return out if regional is None else out.unionByName(regional)


@REG.add()
def ref_p33_recall_by_size(spark, sf_dir):
    """Recall of 800 injected shocks a draw and share of false alarms, by spending quintile of the entity, for two scenarios and two sizes."""
    dev = durable(get_peer(spark, sf_dir).where(F.col("t") >= FIRST_TEST), "peer")
    draws = [(k, name, x) for k, (name, x) in enumerate((name, x) for name in ("all", "one") for x in (0.1, 0.2))]
    keys, z = _injected(dev, draws, 800, 7)
    size = dev.where(F.col("c") == ALL).groupBy("e").agg(F.median("level_prev").alias("v")).withColumn("one", F.lit(1)).select("e", panel.quantile_bin("v", 5, ["one"], ["e"]).alias("q"))
    rows = _by_draw(shocks.top_rms(z, "z_loc")).join(size, "e", "left")
    return _named(_against_clean(rows, keys, ["q"]).where("q is not null"), draws)


@REG.add()
def ref_p36_news_check(spark, sf_dir):
    """Share of shocks with headlines against the share of all rows, by level."""
    s = read_table(spark, sf_dir, "top_shocks_news").select("shock_id", F.coalesce("уровень", F.lit("")).alias("level"), (F.length(F.trim(F.coalesce("заголовки", F.lit("")))) > 0).cast("double").alias("covered")).distinct()
    return s.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("covered").alias("covered"))


@REG.add()
def ref_e11_event_study(spark, sf_dir):
    """Mean gap in months 1 and 2 after a shock month, for shocks and for the other months of covered entities."""
    from panelmill.functions import month_number

    g = shocks.gaps(get_dense(spark, sf_dir), get_regions(spark, sf_dir))
    ev = read_table(spark, sf_dir, "top_shocks_news").where(F.col("уровень") == "шок").select(F.col("territory_id").alias("e"), month_number(F.col("month")).alias("t0")).distinct()
    after = ev.select("e", F.explode(F.array(F.struct((F.col("t0") + 1).alias("t"), F.lit(1).alias("lag")), F.struct((F.col("t0") + 2).alias("t"), F.lit(2).alias("lag")))).alias("x")).select("e", "x.t", "x.lag")
    covered = g.join(ev.select("e").distinct(), "e", "left_semi").join(after, ["e", "t"], "left")
    return covered.groupBy("c", F.coalesce("lag", F.lit(0)).alias("lag")).agg(F.avg("g").alias("gap"), F.count("g").alias("n"))


QUERIES, ORACLE = REG.queries, REG.oracle
