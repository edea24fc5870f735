"""Queries of the forecast protocol, metrics, selection and report operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.operators import metrics, panel, selection
from panelmill.functions import month_number
from panelmill.operators.ranks import cumulate, whole_bins, whole_percentiles, whole_rank
from panelmill.plans.panels import SIMPLE_SQL, TOTAL, get_dense, get_readings, get_regions
from panelmill.plans.registry import Registry
from panelmill.plans.sql import DENSE, FORECASTS, GROWTH, METRIC_NAMES, METRICS, PROTOCOL
from panelmill.sources.tables import durable, read_table

REG = Registry()


def get_forecasts(spark, sf_dir, *extra):
    return metrics.load_forecasts(read_table(spark, sf_dir, "forecasts"), *extra)


def get_protocol(spark, sf_dir):
    return metrics.protocol_rows(get_forecasts(spark, sf_dir))


@REG.add("SELECT CAST(o AS INT) AS origin, CAST(max(h) AS INT) AS steps FROM (SELECT unnest([1, 3, 6, 12]) AS h), (SELECT unnest(range(12, 24)) AS o) WHERE (o - 12) % h = 0 AND o <= 24 - h GROUP BY o")
def ref_e02_forecast_plan(spark, sf_dir):
    return spark.createDataFrame(list(metrics.forecast_plan().items()), "origin int, steps int")


@REG.add(f"WITH {PROTOCOL} SELECT run_id, model, category, territory_id, origin, step, month, CAST(horizon AS INT) AS horizon FROM pr")
def ref_c02_protocol_rows(spark, sf_dir):
    return get_protocol(spark, sf_dir).select("run_id", "model", "category", "territory_id", "origin", "step", "month", "horizon")


@REG.add(f"WITH {PROTOCOL} SELECT model, category, CAST(horizon AS INT) AS horizon, {METRICS} FROM pr WHERE y_pred IS NOT NULL GROUP BY 1, 2, 3", METRIC_NAMES)
def ref_g01_metrics(spark, sf_dir):
    return metrics.metric_table(get_protocol(spark, sf_dir), ["model", "category", "horizon"])


@REG.add(f"WITH {PROTOCOL} SELECT model, category, CAST(horizon AS INT) AS horizon, step, {METRICS} FROM pr WHERE y_pred IS NOT NULL GROUP BY GROUPING SETS ((model, category, horizon, step), (model, category, horizon))", METRIC_NAMES)
def ref_g02_metrics_two_grains(spark, sf_dir):
    rows = get_protocol(spark, sf_dir).where("y_pred is not null")
    keys = [F.col(c) for c in ("model", "category", "horizon", "step")]
    return rows.groupingSets([keys, keys[:3]], *keys).agg(*metrics.metric_columns())


MAE_SQL = f"WITH {PROTOCOL}, mae AS (SELECT model, category, CAST(horizon AS INT) AS horizon, avg(abs(y_pred - y_true)) AS \"MAE\" FROM pr WHERE y_pred IS NOT NULL GROUP BY 1, 2, 3)"


def get_mae(spark, sf_dir):
    return get_protocol(spark, sf_dir).where("y_pred is not null").groupBy("model", "category", "horizon").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("MAE"))


@REG.add(f"{MAE_SQL}, r AS (SELECT category, horizon, \"MAE\" AS ref FROM mae WHERE model = 'naive'), b AS (SELECT *, row_number() OVER (PARTITION BY category, horizon ORDER BY \"MAE\", model) AS rn FROM mae) SELECT b.category, b.horizon, b.model, b.\"MAE\", 100 * (1 - b.\"MAE\" / r.ref) AS gain FROM b LEFT JOIN r USING (category, horizon) WHERE rn = 1", "MAE gain")
def ref_g03_best_model(spark, sf_dir):
    m = get_mae(spark, sf_dir)
    ref = m.where("model = 'naive'").select("category", "horizon", F.col("MAE").alias("ref"))
    return metrics.best_by(m, ["category", "horizon"]).join(ref, ["category", "horizon"], "left").select("category", "horizon", "model", "MAE", (100 * (1 - F.col("MAE") / F.col("ref"))).alias("gain"))


@REG.add(f"{MAE_SQL} SELECT *, rank() OVER (PARTITION BY category, horizon ORDER BY \"MAE\") + (count(*) OVER (PARTITION BY category, horizon, \"MAE\") - 1) / 2 AS rank FROM mae", "MAE rank")
def ref_w22_average_rank(spark, sf_dir):
    return metrics.average_rank(get_mae(spark, sf_dir), ["category", "horizon"])


@REG.add(f"WITH {PROTOCOL}, m AS (SELECT model, category, CAST(horizon AS INT) AS horizon, {METRICS} FROM pr WHERE y_pred IS NOT NULL GROUP BY 1, 2, 3) SELECT a.model, b.model AS root, a.category, a.horizon, 100 * (a.\"MAE\" / b.\"MAE\" - 1) AS \"dMAE\", 100 * (a.\"WAPE\" / b.\"WAPE\" - 1) AS \"dWAPE\", a.\"R2_growth\" - b.\"R2_growth\" AS \"dR2_growth\" FROM m a JOIN m b ON a.category = b.category AND a.horizon = b.horizon AND b.model = CASE WHEN a.model = 'seasonal_naive_growth' THEN 'seasonal_naive' WHEN a.model = 'catboost_logdiff' THEN 'catboost_diff' ELSE 'naive' END", "dMAE dWAPE dR2_growth")
def ref_e05_ablation_delta(spark, sf_dir):
    """Each model against its root: the model it was made from by one change, or naive."""
    m = durable(metrics.metric_table(get_protocol(spark, sf_dir), ["model", "category", "horizon"]), "metrics")
    root = F.when(F.col("model") == "seasonal_naive_growth", "seasonal_naive").when(F.col("model") == "catboost_logdiff", "catboost_diff").otherwise("naive")
    base = m.select(F.col("model").alias("root"), "category", "horizon", *[F.col(c).alias(f"_{c}") for c in ("MAE", "WAPE", "R2_growth")])
    rel = lambda c: (100 * (F.col(c) / F.col(f"_{c}") - 1)).alias(f"d{c}")
    return m.withColumn("root", root).join(base, ["root", "category", "horizon"]).select("model", "root", "category", "horizon", rel("MAE"), rel("WAPE"), (F.col("R2_growth") - F.col("_R2_growth")).alias("dR2_growth"))


PAIR_SQL = f"""WITH {PROTOCOL}, ae AS (SELECT model, category, territory_id, origin, step, month, CAST(horizon AS INT) AS horizon, avg(abs(y_pred - y_true)) AS ae FROM pr WHERE y_pred IS NOT NULL GROUP BY ALL),
pair AS (SELECT a.category, a.territory_id, a.origin, a.step, a.month, a.horizon, a.ae AS ae_a, b.ae AS ae_b FROM ae a JOIN ae b USING (category, territory_id, origin, step, month, horizon) WHERE a.model = 'naive' AND b.model = 'seasonal_naive')"""


@REG.add(f"{PAIR_SQL} SELECT category, horizon, count(*) AS n, avg(ae_a) AS mae_a, avg(ae_b) AS mae_b, avg(CASE WHEN ae_b < ae_a THEN 1.0 ELSE 0.0 END) AS wins FROM pair GROUP BY ALL", "mae_a mae_b wins")
def ref_e08_pair_comparison(spark, sf_dir):
    p = metrics.paired(get_protocol(spark, sf_dir), "naive", "seasonal_naive")
    return p.groupBy("category", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("ae_a").alias("mae_a"), F.avg("ae_b").alias("mae_b"), F.avg((F.col("ae_b") < F.col("ae_a")).cast("double")).alias("wins"))


@REG.add(f"WITH {PROTOCOL}, m AS (SELECT model, category, CAST(horizon AS INT) AS horizon, run_id, avg(abs(y_pred - y_true)) AS mae FROM pr WHERE y_pred IS NOT NULL GROUP BY ALL) SELECT model, category, horizon, count(*) AS runs, (max(mae) - min(mae)) / nullif(avg(mae), 0) AS spread FROM m GROUP BY ALL", "spread")
def ref_e09_run_noise(spark, sf_dir):
    m = get_protocol(spark, sf_dir).where("y_pred is not null").groupBy("model", "category", "horizon", "run_id").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    return m.groupBy("model", "category", "horizon").agg(F.count(F.lit(1)).alias("runs"), ((F.max("mae") - F.min("mae")) / F.nullif(F.avg("mae"), F.lit(0.0))).alias("spread"))


HALVES_SQL = f"""WITH {PROTOCOL}, h AS (SELECT model, category, CAST(horizon AS INT) AS horizon, avg(abs(y_pred - y_true)) FILTER (WHERE CAST(substr(month, 6, 2) AS INT) <= 6) AS h1, avg(abs(y_pred - y_true)) FILTER (WHERE CAST(substr(month, 6, 2) AS INT) > 6) AS h2 FROM pr WHERE y_pred IS NOT NULL GROUP BY ALL)"""


def get_halves(spark, sf_dir):
    ae, early = F.abs(F.col("y_pred") - F.col("y_true")), F.substring("month", 6, 2).cast("int") <= 6
    return get_protocol(spark, sf_dir).where("y_pred is not null").groupBy("model", "category", "horizon").agg(F.avg(F.when(early, ae)).alias("h1"), F.avg(F.when(~early, ae)).alias("h2"))


@REG.add(f"{HALVES_SQL} SELECT * FROM h", "h1 h2")
def ref_e06_halves(spark, sf_dir):
    return get_halves(spark, sf_dir)


@REG.add(f"{HALVES_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY category, horizon ORDER BY round(h1, 9), model) AS r1, row_number() OVER (PARTITION BY category, horizon ORDER BY round(h2, 9), model) AS r2 FROM h WHERE h1 IS NOT NULL AND h2 IS NOT NULL) SELECT a.category, a.horizon, a.model AS chosen, b.model AS oracle, a.h2 AS chosen_h2, b.h2 AS oracle_h2 FROM s a JOIN s b USING (category, horizon) WHERE a.r1 = 1 AND b.r2 = 1", "chosen_h2 oracle_h2")
def ref_e06_half_selection(spark, sf_dir):
    h = get_halves(spark, sf_dir).where("h1 is not null and h2 is not null")
    w = lambda c: F.row_number().over(Window.partitionBy("category", "horizon").orderBy(F.round(c, 9), "model"))
    s = h.withColumn("r1", w("h1")).withColumn("r2", w("h2"))
    a = s.where("r1 = 1").select("category", "horizon", F.col("model").alias("chosen"), F.col("h2").alias("chosen_h2"))
    return a.join(s.where("r2 = 1").select("category", "horizon", F.col("model").alias("oracle"), F.col("h2").alias("oracle_h2")), ["category", "horizon"])


@REG.add(f"{MAE_SQL}, top AS (SELECT category, horizon, model FROM (SELECT *, row_number() OVER (PARTITION BY category, horizon ORDER BY round(\"MAE\", 9), model) AS rn FROM mae) WHERE rn <= 3), e AS (SELECT pr.category, CAST(pr.horizon AS INT) AS horizon, territory_id, origin, step, month, avg(y_pred) AS p, max(y_true) AS y FROM pr JOIN top ON pr.category = top.category AND pr.horizon = top.horizon AND pr.model = top.model WHERE y_pred IS NOT NULL GROUP BY ALL) SELECT category, horizon, count(*) AS n, avg(abs(p - y)) AS mae FROM e GROUP BY ALL", "mae")
def ref_e06_ensemble_of_three(spark, sf_dir):
    e = selection.ensemble(get_protocol(spark, sf_dir), get_mae(spark, sf_dir))
    return e.groupBy("category", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))


@REG.add(
    f"""WITH {PROTOCOL}, er AS (SELECT model, category, CAST(horizon AS INT) AS horizon, origin, step, month, avg(abs(y_pred - y_true)) AS ae FROM pr WHERE y_pred IS NOT NULL GROUP BY ALL),
k AS (SELECT er.category, er.horizon, a.decided, er.model, avg(ae) AS past_ae FROM er JOIN (SELECT DISTINCT category, horizon, origin AS decided FROM er) a ON er.category = a.category AND er.horizon = a.horizon AND er.origin + er.step <= a.decided GROUP BY ALL)
SELECT category, horizon, decided AS origin, model, past_ae FROM (SELECT *, row_number() OVER (PARTITION BY category, horizon, decided ORDER BY round(past_ae, 9), model) AS rn FROM k) WHERE rn = 1""",
    "past_ae",
)
def ref_p41_online_choice(spark, sf_dir):
    return selection.online_choice(selection.errors(get_protocol(spark, sf_dir)))


@REG.add(f"WITH {GROWTH}, r AS (SELECT c, gf AS g, gf - median(gf) OVER (PARTITION BY c, t) AS r FROM gr WHERE gf IS NOT NULL) SELECT c, 1 - var_pop(r) / nullif(var_pop(g), 0) AS r2 FROM r GROUP BY c", "r2")
def ref_g13_common_month_r2(spark, sf_dir):
    return selection.common_month_r2(get_dense(spark, sf_dir))


@REG.add(f"WITH {GROWTH}, r AS (SELECT c, gf AS g, gf - median(gf) OVER (PARTITION BY c, t) AS r FROM gr WHERE gf IS NOT NULL AND t < (SELECT min(t) + 12 FROM dense)) SELECT c AS category, CASE WHEN 1 - var_pop(r) / nullif(var_pop(g), 0) >= 0.5 THEN 'catboost_logdiff' ELSE 'catboost_diff' END AS model FROM r GROUP BY c")
def ref_p40_model_rule(spark, sf_dir):
    return get_rule(get_dense(spark, sf_dir))


#: the two candidates of the final forecast
HOMOGENEOUS, HETEROGENEOUS = "catboost_logdiff", "catboost_diff"


def get_rule(dense):
    return selection.rule_choice(dense, HOMOGENEOUS, HETEROGENEOUS, 12)


def get_shocked(spark, sf_dir):
    return read_table(spark, sf_dir, "top_shocks_news").where(F.col("уровень") == "шок").select(F.col("territory_id").alias("e"), month_number(F.col("month")).alias("t")).distinct()


RULE_SQL = """rr AS (SELECT c, gf AS g, gf - median(gf) OVER (PARTITION BY c, t) AS r FROM gr WHERE gf IS NOT NULL AND t < (SELECT min(t) + 12 FROM dense)),
rule AS (SELECT c AS category, CASE WHEN 1 - var_pop(r) / nullif(var_pop(g), 0) >= 0.5 THEN 'catboost_logdiff' ELSE 'catboost_diff' END AS model FROM rr GROUP BY c)"""
FINAL_SQL = f"""WITH {GROWTH}, {PROTOCOL.strip()}, {RULE_SQL}, hit AS (SELECT DISTINCT territory_id, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS t FROM top_shocks_news WHERE "уровень" = 'шок'),
vl AS (SELECT e AS territory_id, c AS category, t - (SELECT min(t) FROM dense) + 1 AS origin, stddev_pop(gf) OVER (PARTITION BY c, e ORDER BY t ROWS UNBOUNDED PRECEDING) AS vol FROM gr),
r0 AS (SELECT pr.category, CAST(horizon AS INT) AS horizon, pr.territory_id, pr.origin, step, CAST(substr(month, 6, 2) AS INT) <= 6 AS first_half, ln(greatest(y_true, 1.0) / greatest(y_pred, 1.0)) AS r, vol, hit.territory_id IS NOT NULL AS after_shock
 FROM pr JOIN rule ON pr.category = rule.category AND pr.model = rule.model LEFT JOIN vl ON vl.territory_id = pr.territory_id AND vl.category = pr.category AND vl.origin = pr.origin
 LEFT JOIN hit ON hit.territory_id = pr.territory_id AND hit.t - (SELECT min(t) FROM dense) + 1 = pr.origin WHERE y_pred IS NOT NULL),
r1 AS (SELECT *, rank() OVER (PARTITION BY category, horizon ORDER BY vol, territory_id * 10000 + origin * 100 + step) AS rn, count(*) OVER (PARTITION BY category, horizon) AS n FROM r0 WHERE vol IS NOT NULL),
res AS (SELECT *, CAST(CASE WHEN n <= 1 THEN 0 ELSE greatest(CAST(floor(((rn - 1) * 5 + n - 2) / (n - 1)) AS INT) - 1, 0) END AS INT) AS vol_q FROM r1)"""
BANDS_SQL = f"""{FINAL_SQL}, f AS (SELECT category, horizon, vol_q, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM res WHERE first_half AND NOT after_shock GROUP BY ALL),
kf AS (SELECT greatest(1.0, coalesce(quantile_cont(abs(r) / nullif((hi - lo) / 2, 0), 0.9), 1.0)) AS k FROM res JOIN f USING (category, horizon, vol_q) WHERE first_half AND after_shock)"""


def get_residuals(spark, sf_dir):
    dense = durable(get_dense(spark, sf_dir), "dense")
    rows = get_protocol(spark, sf_dir).join(get_rule(dense), ["category", "model"])
    return dense, durable(selection.residuals(rows, dense, get_shocked(spark, sf_dir)).where("vol_q is not null"), "residuals")


@REG.add(f"{BANDS_SQL} SELECT * FROM f", "lo hi")
def ref_p39_interval_bands(spark, sf_dir):
    r = get_residuals(spark, sf_dir)[1]
    return selection.bands(r.where("first_half and not after_shock"))


@REG.add(
    f"""{BANDS_SQL}, v AS (SELECT 'plain' AS variant, 1.0 AS k UNION ALL SELECT 'wider after a shock', k FROM kf), x AS (SELECT variant, category, horizon, r, after_shock, (lo + hi) / 2 AS mid, (hi - lo) / 2 * CASE WHEN after_shock THEN k ELSE 1.0 END AS half FROM res JOIN f USING (category, horizon, vol_q), v WHERE NOT first_half)
SELECT variant, category, horizon, 100 * avg(CASE WHEN r >= mid - half AND r <= mid + half THEN 1.0 ELSE 0.0 END) AS coverage, 100 * avg(CASE WHEN r >= mid - half AND r <= mid + half THEN 1.0 ELSE 0.0 END) FILTER (WHERE after_shock) AS coverage_after_shock, count(*) FILTER (WHERE after_shock) AS n_after_shock, 100 * median(exp(2 * half) - 1) AS width FROM x GROUP BY ALL""",
    "coverage coverage_after_shock width",
)
def ref_p39_interval_coverage(spark, sf_dir):
    r = get_residuals(spark, sf_dir)[1]
    fitted = durable(selection.bands(r.where("first_half and not after_shock")), "bands")
    k = selection.shock_factor(r.where("first_half"), fitted).first()["k"]
    late = r.where("not first_half")
    parts = [selection.band_coverage(late, fitted, v).withColumn("variant", F.lit(name)) for name, v in (("plain", 1.0), ("wider after a shock", k))]
    return parts[0].unionByName(parts[1])


@REG.add(
    f"""{FINAL_SQL}, f AS (SELECT category, horizon, vol_q, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM res GROUP BY ALL),
ma AS (SELECT category, CAST(horizon AS INT) AS horizon, model, avg(abs(y_pred - y_true)) AS mae FROM pr WHERE model IN ('seasonal_naive', 'seasonal_naive_growth') AND y_pred IS NOT NULL GROUP BY ALL),
ch AS (SELECT category, horizon, model FROM (SELECT *, row_number() OVER (PARTITION BY category, horizon ORDER BY round(mae, 9), model) AS rn FROM ma) WHERE rn = 1),
o AS (SELECT (SELECT max(t) - min(t) + 1 FROM dense) AS origin, 12 AS steps), {SIMPLE_SQL},
vv AS (SELECT e, c, stddev_pop(gf) AS vol FROM gr GROUP BY e, c), vr AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY vol, e) AS rn, count(*) OVER (PARTITION BY c) AS n FROM vv WHERE vol IS NOT NULL),
vq AS (SELECT e, c, CASE WHEN n <= 1 THEN 0 ELSE greatest(CAST(floor(((rn - 1) * 5 + n - 2) / (n - 1)) AS INT) - 1, 0) END AS vol_q FROM vr),
y AS (SELECT s.c AS category, s.e AS territory_id, s.step, s.model, s.y_pred, lo, hi, h.territory_id IS NOT NULL AS shock FROM simple s JOIN ch ON ch.category = s.c AND ch.model = s.model AND ch.horizon = CASE WHEN step <= 1 THEN 1 WHEN step <= 3 THEN 3 WHEN step <= 6 THEN 6 ELSE 12 END
 LEFT JOIN vq ON vq.e = s.e AND vq.c = s.c LEFT JOIN f ON f.category = s.c AND f.horizon = ch.horizon AND f.vol_q = vq.vol_q LEFT JOIN (SELECT territory_id FROM hit WHERE t = (SELECT max(t) FROM dense)) h ON h.territory_id = s.e)
SELECT category, territory_id, step, model, y_pred, y_pred * exp((lo + hi) / 2 - (hi - lo) / 2 * CASE WHEN shock THEN 1.3 ELSE 1.0 END) AS lo90, y_pred * exp((lo + hi) / 2 + (hi - lo) / 2 * CASE WHEN shock THEN 1.3 ELSE 1.0 END) AS hi90, shock FROM y""",
    "y_pred lo90 hi90",
)
def ref_p42_next_year(spark, sf_dir):
    """Twelve months after the panel, from the two seasonal models, with bands of the final forecast's residuals."""
    dense, r = get_residuals(spark, sf_dir)
    mae = get_mae(spark, sf_dir).where(F.col("model").isin("seasonal_naive", "seasonal_naive_growth")).withColumn("MAE", F.round("MAE", 9))
    ends = dense.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    last = get_shocked(spark, sf_dir).where(F.col("t") == ends["b"])
    return selection.next_year(panel.simple_forecasts(dense, ends["b"], 12, ends["a"]), metrics.best_by(mae, ["category", "horizon"]), durable(selection.bands(r), "bands"), dense, last)


ONLINE_SQL = f"""WITH {GROWTH}, {PROTOCOL.strip()}, {RULE_SQL}, x AS (SELECT run_id, category, CAST(horizon AS INT) AS horizon, territory_id, origin, step, month, model, y_true, y_pred FROM pr WHERE model IN ('catboost_logdiff', 'catboost_diff') AND y_pred IS NOT NULL),
k AS (SELECT a.category, a.horizon, a.decided, x.model, avg(abs(y_pred - y_true)) AS mae FROM (SELECT DISTINCT category, horizon, origin AS decided FROM x) a JOIN x ON x.category = a.category AND x.horizon = a.horizon AND x.origin < a.decided AND x.origin + x.step <= a.decided {{window}} GROUP BY ALL),
b AS (SELECT category, horizon, decided, arg_min(model, (round(mae, 9), model)) AS best, count(*) AS n FROM k GROUP BY ALL),
ch AS (SELECT a.category, a.horizon, a.decided, CASE WHEN n = 2 THEN best ELSE rule.model END AS model FROM (SELECT DISTINCT category, horizon, origin AS decided FROM x) a LEFT JOIN b USING (category, horizon, decided) LEFT JOIN rule ON rule.category = a.category)
SELECT category, territory_id, origin, step, month, model, y_true, y_pred FROM (SELECT x.*, row_number() OVER (PARTITION BY x.category, territory_id, origin, step ORDER BY x.horizon, run_id) AS rn FROM x JOIN ch ON ch.category = x.category AND ch.horizon = x.horizon AND ch.decided = x.origin AND ch.model = x.model) WHERE rn = 1"""


@REG.add(ONLINE_SQL.format(window=""), "y_true y_pred")
def ref_m13_final_online(spark, sf_dir):
    return selection.online_final(get_protocol(spark, sf_dir), get_rule(get_dense(spark, sf_dir)), [HOMOGENEOUS, HETEROGENEOUS])


@REG.add(ONLINE_SQL.format(window="AND x.origin + x.step - 1 >= a.decided - 3"), "y_true y_pred")
def ref_m13_final_online_3(spark, sf_dir):
    return selection.online_final(get_protocol(spark, sf_dir), get_rule(get_dense(spark, sf_dir)), [HOMOGENEOUS, HETEROGENEOUS], 3)


@REG.add(
    f"""WITH {FORECASTS}, one AS (SELECT category, territory_id, month, model, avg(y_pred) AS p, max(y_true) AS y FROM fc WHERE step = 1 AND y_pred IS NOT NULL AND y_true IS NOT NULL GROUP BY ALL),
m AS (SELECT category, model, month, avg(abs(p - y)) AS mae FROM one GROUP BY ALL), l AS (SELECT category, month, row_number() OVER (PARTITION BY category ORDER BY month) AS i FROM (SELECT DISTINCT category, month FROM m)), mi AS (SELECT m.*, i FROM m JOIN l USING (category, month)),
s AS (SELECT l.category, l.month, model, avg(mae) AS a, avg(mae) FILTER (WHERE mi.i >= l.i - 3) AS b FROM l JOIN mi ON mi.category = l.category AND mi.i < l.i GROUP BY ALL),
q AS (SELECT category, month, model, row_number() OVER (PARTITION BY category, month ORDER BY round(a, 9), model) AS pa, row_number() OVER (PARTITION BY category, month ORDER BY round(b, 9) NULLS LAST, model) AS pb FROM s UNION ALL SELECT category, month, 'catboost_diff', 1, 1 FROM l WHERE i = 1),
e AS (SELECT o.category, o.month, o.territory_id, max(y) AS y, avg(p) FILTER (WHERE pa = 1) AS best_all, avg(p) FILTER (WHERE pb = 1) AS best_3, avg(p) FILTER (WHERE pa <= 3) AS top3_all FROM one o JOIN q ON q.category = o.category AND q.month = o.month AND q.model = o.model AND (pa <= 3 OR pb = 1) GROUP BY ALL)
SELECT e.category, e.month, avg(abs(best_all - y)) AS best_all, avg(abs(best_3 - y)) AS best_3, avg(abs(top3_all - y)) AS top3_all, c.model AS chosen FROM e JOIN q c ON c.category = e.category AND c.month = e.month AND c.pa = 1 GROUP BY e.category, e.month, c.model""",
    "best_all best_3 top3_all",
)
def ref_e07_monthly_choice(spark, sf_dir):
    return selection.monthly_choice(get_forecasts(spark, sf_dir).where("step = 1 and y_true is not null"), HETEROGENEOUS)


@REG.add(
    f"""{HALVES_SQL}, n AS (SELECT category, horizon, h1 AS n1, h2 AS n2 FROM h WHERE model = 'naive'), w AS (SELECT h.*, h1 / n1 AS r1, h2 / n2 AS r2, n2 FROM h JOIN n USING (category, horizon) WHERE h1 IS NOT NULL AND h2 IS NOT NULL),
c AS (SELECT * FROM w WHERE model IN (SELECT model FROM w GROUP BY model HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT category, horizon FROM w)))),
m1 AS (SELECT model FROM c GROUP BY model ORDER BY round(avg(r1), 9), model LIMIT 1), m2 AS (SELECT category, model FROM (SELECT category, model, row_number() OVER (PARTITION BY category ORDER BY round(avg(r1), 9), model) AS rn FROM c GROUP BY category, model) WHERE rn = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY category, horizon ORDER BY round(h1, 9), model) AS rn FROM c),
t AS (SELECT pr.category, CAST(pr.horizon AS INT) AS horizon, avg(y_pred) AS p, max(y_true) AS y FROM pr JOIN o ON o.category = pr.category AND o.horizon = pr.horizon AND o.model = pr.model AND o.rn <= 3 WHERE y_pred IS NOT NULL AND CAST(substr(month, 6, 2) AS INT) > 6 GROUP BY pr.category, pr.horizon, territory_id, origin, step, month),
t3 AS (SELECT category, horizon, avg(abs(p - y)) AS mae FROM t GROUP BY ALL)
SELECT o.category, o.horizon, 100 * (max(o.r2) FILTER (WHERE o.model = (SELECT model FROM m1)) - 1) AS "R1", 100 * (max(o.r2) FILTER (WHERE o.model = m2.model) - 1) AS "R2", 100 * (max(o.r2) FILTER (WHERE rn = 1) - 1) AS "R3", 100 * (any_value(t3.mae) / any_value(o.n2) - 1) AS "R4", 100 * (min(o.r2) - 1) AS oracle, max(o.model) FILTER (WHERE rn = 1) AS model_r3, any_value(m2.model) AS model_r2
FROM o JOIN m2 ON m2.category = o.category LEFT JOIN t3 ON t3.category = o.category AND t3.horizon = o.horizon GROUP BY o.category, o.horizon""",
    "R1 R2 R3 R4 oracle",
)
def ref_e06_rules(spark, sf_dir):
    """Rules that choose by the first half year, as errors of the second half against naive, in percent: one model for all (R1), one a category (R2), the best of each cell (R3), the mean of its best three (R4)."""
    h = durable(get_halves(spark, sf_dir).where("h1 is not null and h2 is not null"), "halves")
    n = h.where("model = 'naive'").select("category", "horizon", F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    w = h.join(n, ["category", "horizon"]).withColumn("r1", F.col("h1") / F.col("n1")).withColumn("r2", F.col("h2") / F.col("n2"))
    cells = w.select("category", "horizon").distinct().count()
    c = w.join(w.groupBy("model").count().where(F.col("count") == cells).select("model"), "model")
    one = c.groupBy("model").agg(F.round(F.avg("r1"), 9).alias("s")).orderBy("s", "model").first()
    two = metrics.best_by(c.groupBy("category", "model").agg(F.round(F.avg("r1"), 9).alias("MAE")), ["category"]).select("category", F.col("model").alias("model_r2"))
    o = c.withColumn("rn", F.row_number().over(Window.partitionBy("category", "horizon").orderBy(F.round("h1", 9), "model")))
    e = selection.ensemble(get_protocol(spark, sf_dir).where(F.substring("month", 6, 2).cast("int") > 6), o.where("rn <= 3").select("category", "horizon", "model", F.col("h1").alias("MAE")))
    t3 = e.groupBy("category", "horizon").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("t3"))
    pick = lambda cond: F.max(F.when(cond, F.col("r2")))
    g = o.join(two, "category").groupBy("category", "horizon", "model_r2").agg(pick(F.col("model") == F.lit(one["model"] if one else None)).alias("a"), pick(F.col("model") == F.col("model_r2")).alias("b"), pick(F.col("rn") == 1).alias("c3"), F.min("r2").alias("least"), F.max("n2").alias("n2"), F.max(F.when(F.col("rn") == 1, F.col("model"))).alias("model_r3"))
    pct = lambda v: 100 * (v - 1)
    return g.join(t3, ["category", "horizon"], "left").select("category", "horizon", pct(F.col("a")).alias("R1"), pct(F.col("b")).alias("R2"), pct(F.col("c3")).alias("R3"), pct(F.col("t3") / F.col("n2")).alias("R4"), pct(F.col("least")).alias("oracle"), "model_r3", "model_r2")


@REG.add(f"WITH {FORECASTS} SELECT category, 100 * avg(CASE WHEN y_true >= q05 AND y_true <= q95 THEN 1.0 ELSE 0.0 END) AS coverage, median((q95 - q05) / y_true) FILTER (WHERE y_true > 0) AS width, count(*) AS n FROM fc WHERE q05 IS NOT NULL AND q95 IS NOT NULL AND y_true IS NOT NULL GROUP BY category", "coverage width")
def ref_p39_quantile_coverage(spark, sf_dir):
    return metrics.coverage(get_forecasts(spark, sf_dir, "q05", "q95"))


@REG.add(f"WITH {FORECASTS} SELECT DISTINCT step, CAST(CASE WHEN step <= 1 THEN 1 WHEN step <= 3 THEN 3 WHEN step <= 6 THEN 6 WHEN step <= 12 THEN 12 END AS INT) AS bucket FROM fc")
def ref_p42_horizon_bucket(spark, sf_dir):
    return selection.next_horizon(read_table(spark, sf_dir, "forecasts").select("step").distinct())


POP_SQL = "pop AS (SELECT DISTINCT territory_id AS e, exp(log_pop) AS pop FROM territory_static WHERE log_pop BETWEEN 5 AND 16)"


@REG.add(f"WITH {DENSE}, {POP_SQL}, s AS (SELECT c, t, sum(y * pop) / sum(CASE WHEN y IS NOT NULL THEN pop END) AS v FROM dense JOIN pop USING (e) WHERE y IS NOT NULL GROUP BY ALL), b AS (SELECT c, min_by(v, t) AS base FROM s GROUP BY c) SELECT s.c, s.t, v, v / base - 1 AS growth FROM s JOIN b USING (c)", "v growth")
def ref_p43_weighted_growth(spark, sf_dir):
    pop = read_table(spark, sf_dir, "territory_static").where("log_pop between 5 and 16").select(F.col("territory_id").alias("e"), F.exp("log_pop").alias("pop")).distinct()
    s = get_readings(spark, sf_dir).join(pop, "e").groupBy("c", "t").agg((F.sum(F.col("y") * F.col("pop")) / F.sum("pop")).alias("v"))
    base = s.groupBy("c").agg(F.min_by("v", "t").alias("base"))
    return s.join(base, "c").select("c", "t", "v", (F.col("v") / F.col("base") - 1).alias("growth"))


@REG.add(f"WITH {DENSE}, q AS (SELECT c, t, count(y) AS n, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM dense GROUP BY ALL) SELECT c, t, n, q[1] AS p10, q[2] AS p50, q[3] AS p90 FROM q", "p10 p50 p90")
def ref_e12_level_bands(spark, sf_dir):
    q = F.percentile("y", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return get_dense(spark, sf_dir).groupBy("c", "t").agg(F.count("y").alias("n"), q.alias("q")).select("c", "t", "n", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


@REG.add(f"WITH {GROWTH}, a AS (SELECT e, c, g, lag(g) OVER (PARTITION BY c, e ORDER BY t) AS p FROM gr), k AS (SELECT e, c, corr(g, p) AS r, count(CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN 1 END) AS n FROM a GROUP BY ALL) SELECT c, median(r) AS autocorrelation FROM k WHERE n >= 5 AND isfinite(r) GROUP BY c", "autocorrelation")
def ref_g16_autocorrelation(spark, sf_dir):
    w = Window.partitionBy("c", "e").orderBy("t")
    g = get_dense(spark, sf_dir).withColumn("l", F.when(F.col("y") > 0, F.ln("y"))).withColumn("g", F.col("l") - F.lag("l", 1).over(w)).withColumn("p", F.lag("g", 1).over(w))
    k = g.groupBy("e", "c").agg(F.corr("g", "p").alias("r"), F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)).alias("n"))
    return k.where("n >= 5 and not isnan(r)").groupBy("c").agg(F.median("r").alias("autocorrelation"))


@REG.add(
    f"""WITH {DENSE}, m AS (SELECT e, avg(y) AS v FROM dense WHERE c = '{TOTAL}' AND y > 0 GROUP BY e), a AS (SELECT DISTINCT territory_id AS e, ma.market_access AS x FROM market_access ma WHERE NOT isnan(ma.market_access) AND ma.market_access BETWEEN 0 AND 1000),
r AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS b FROM m JOIN a USING (e)) SELECT corr(a, b) AS spearman, count(*) AS n FROM r""",
    "spearman",
)
def ref_g14_spearman(spark, sf_dir):
    m = get_dense(spark, sf_dir).where((F.col("c") == TOTAL) & (F.col("y") > 0)).groupBy("e").agg(F.avg("y").alias("v"))
    a = read_table(spark, sf_dir, "market_access").where("market_access between 0 and 1000").select(F.col("territory_id").alias("e"), F.col("market_access").alias("x")).distinct()
    j = whole_rank(whole_rank(m.join(a, "e"), "v", "a"), "x", "b")
    return j.agg(F.corr("a", "b").alias("spearman"), F.count(F.lit(1)).alias("n"))


@REG.add(f"WITH {DENSE}, s AS (SELECT a.e, a.t, a.c, a.y / b.y AS share FROM dense a JOIN dense b ON a.e = b.e AND a.t = b.t AND b.c = '{TOTAL}' WHERE a.c <> '{TOTAL}' AND b.y > 0 AND a.y > 0) SELECT c, median(share) AS share, count(*) AS n FROM s GROUP BY c", "share")
def ref_e12_shares(spark, sf_dir):
    m = get_readings(spark, sf_dir).where("y > 0").groupBy("e", "t").agg(F.collect_list(F.struct("c", "y")).alias("x"))  # as many as there are categories
    m = m.select("x", F.explode(F.filter("x", lambda s: s["c"] == TOTAL)).alias("b")).select("b", F.explode(F.filter("x", lambda s: s["c"] != TOTAL)).alias("a"))
    s = durable(m.select("a.c", (F.col("a.y") / F.col("b.y")).alias("share")), "shares")
    return whole_percentiles(s, "share", [0.5], "c").select("c", F.col("q")[0].alias("share"), "n")


@REG.add(f"WITH {GROWTH}, r AS (SELECT e, c, t, g - median(g) OVER (PARTITION BY c, t) AS idio FROM gr WHERE g IS NOT NULL) SELECT e, c, t, idio FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(abs(idio), 9) DESC, e, t) AS rn FROM r) WHERE rn <= 5", "idio")
def ref_t04_top_jumps(spark, sf_dir):
    w = Window.partitionBy("c", "e").orderBy("t")
    g = get_dense(spark, sf_dir).withColumn("l", F.when(F.col("y") > 0, F.ln("y"))).withColumn("g", F.col("l") - F.lag("l", 1).over(w)).where("g is not null")
    g = panel.with_medians(g, ["c", "t"], {"m": "g"}).withColumn("idio", F.col("g") - F.col("m"))
    rn = F.row_number().over(Window.partitionBy("c").orderBy(F.desc(F.round(F.abs("idio"), 9)), "e", "t"))
    return g.withColumn("rn", rn).where("rn <= 5").select("e", "c", "t", "idio")


@REG.add(f"WITH {PROTOCOL}, m AS (SELECT model, territory_id, avg(100 * abs(y_pred - y_true) / nullif(abs(y_true), 0)) AS mape FROM pr WHERE y_pred IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(mape, 9), territory_id) AS rn, count(*) OVER (PARTITION BY model) AS n FROM m WHERE mape IS NOT NULL) SELECT model, territory_id, mape, CASE WHEN rn <= 5 THEN 'best' WHEN rn > n - 5 THEN 'worst' ELSE 'middle' END AS place FROM r WHERE rn <= 5 OR rn > n - 5 OR abs(rn - (n // 2 + 1)) <= 2", "mape")
def ref_t05_best_middle_worst(spark, sf_dir):
    """The five best, middle and worst entities of each model (a report of fifteen: the limit is the feature)."""
    ape = 100 * F.abs(F.col("y_pred") - F.col("y_true")) / F.nullif(F.abs("y_true"), F.lit(0.0))
    m = get_protocol(spark, sf_dir).where("y_pred is not null").groupBy("model", "territory_id").agg(F.avg(ape).alias("mape")).where("mape is not null")
    x = cumulate(m.withColumn("k", F.round("mape", 9)).withColumn("one", F.lit(1)), "model", ["k", "territory_id"], "one")
    rn, n = F.col("upto"), F.col("total")
    place = F.when(rn <= 5, "best").when(rn > n - 5, "worst").when(F.abs(rn - (F.floor(n / 2) + 1)) <= 2, "middle")
    return x.select("model", "territory_id", "mape", place.alias("place")).where("place is not null")


ORACLE_GAIN_SQL = f"""WITH {PROTOCOL}, x AS (SELECT model, category, CAST(horizon AS INT) AS horizon, month, step, origin, s.region, ln(y_true / y_pred) AS r FROM pr JOIN reg s ON s.e = territory_id WHERE y_true > 0 AND y_pred > 0),
y AS (SELECT *, median(r) OVER (PARTITION BY model, category, horizon, origin, step) AS n, median(r) OVER (PARTITION BY model, category, horizon, origin, step, region) AS g FROM x)
SELECT model, category, horizon, avg(abs(r)) AS plain, avg(abs(r - n)) AS national, avg(abs(r - g)) AS regional FROM y GROUP BY ALL"""


@REG.add(ORACLE_GAIN_SQL.replace("WITH ", "WITH reg AS (SELECT DISTINCT territory_id AS e, region FROM territory_static), ", 1), "plain national regional")
def ref_e13_oracle_gain(spark, sf_dir):
    x = get_protocol(spark, sf_dir).where("y_true > 0 and y_pred > 0").join(get_regions(spark, sf_dir).withColumnRenamed("e", "territory_id"), "territory_id").withColumn("r", F.ln(F.col("y_true") / F.col("y_pred")))
    key = ["model", "category", "horizon", "origin", "step"]
    x = panel.with_medians(panel.with_medians(x, key, {"n": "r"}), [*key, "region"], {"g": "r"})
    return x.groupBy("model", "category", "horizon").agg(F.avg(F.abs("r")).alias("plain"), F.avg(F.abs(F.col("r") - F.col("n"))).alias("national"), F.avg(F.abs(F.col("r") - F.col("g"))).alias("regional"))


@REG.add(f"WITH {DENSE}, m AS (SELECT e, avg(y) AS v FROM dense WHERE c = '{TOTAL}' GROUP BY e), n AS (SELECT e, v, row_number() OVER (ORDER BY v NULLS LAST, e) AS rn, count(v) OVER () AS n FROM m) SELECT e, CAST(CASE WHEN v IS NULL THEN NULL ELSE greatest(CAST(floor(((rn - 1) * 5 + n - 2) / (n - 1)) AS INT) - 1, 0) END AS INT) AS q FROM n")
def ref_w12_quintiles(spark, sf_dir):
    m = get_dense(spark, sf_dir).where(F.col("c") == TOTAL).groupBy("e").agg(F.avg("y").alias("v"))
    return whole_bins(m, "v", 5, "e", "q").select("e", "q")


@REG.add(f"WITH {DENSE} SELECT e, string_agg(CAST(CAST(round(coalesce(y, 0)) AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS history FROM dense WHERE c = '{TOTAL}' GROUP BY e")
def ref_e15_site_history(spark, sf_dir):
    d = get_dense(spark, sf_dir).where(F.col("c") == TOTAL).groupBy("e").agg(F.sort_array(F.collect_list(F.struct("t", F.round(F.coalesce("y", F.lit(0.0))).cast("bigint").alias("v")))).alias("s"))
    return d.select("e", F.array_join(F.transform("s", lambda s: s["v"].cast("string")), ",").alias("history"))


@REG.add(f"WITH {DENSE}, s AS (SELECT e, c, string_agg(CASE WHEN y IS NOT NULL THEN CAST(CAST(round(y) AS BIGINT) AS VARCHAR) ELSE 'null' END, ',' ORDER BY t) AS v FROM dense GROUP BY e, c) SELECT s.e, reg.region, concat('{{\"hist\":{{', string_agg(concat('\"', c, '\":[', v, ']'), ',' ORDER BY c), '}}}}') AS payload FROM s JOIN reg USING (e) GROUP BY s.e, reg.region")
def ref_e15_site_json(spark, sf_dir):
    d = get_dense(spark, sf_dir).groupBy("e", "c").agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("s"))
    h = d.groupBy("e").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("c", F.transform("s", lambda s: F.round(s["y"]).cast("bigint")).alias("v"))))).alias("hist"))
    return h.join(get_regions(spark, sf_dir), "e").select("e", "region", F.to_json(F.struct("hist"), {"ignoreNullFields": "false"}).alias("payload"))


@REG.add()
def ref_g19_cluster_bootstrap(spark, sf_dir):
    """Confidence interval of a mean difference by Poisson bootstrap over territories: sums per territory, then 500 hash-drawn weights each."""
    p = metrics.paired(get_protocol(spark, sf_dir), "naive", "seasonal_naive")
    per = p.groupBy("category", "territory_id").agg(F.sum(F.col("ae_b") - F.col("ae_a")).alias("s"), F.count(F.lit(1)).alias("n"))
    u = (F.pmod(F.xxhash64("territory_id", "b"), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    weight = sum((u > q).cast("int") for q in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941))
    draws = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(500))).alias("b")).withColumn("w", weight)
    means = draws.groupBy("category", "b").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    return means.groupBy("category").agg(F.percentile("m", 0.025).alias("low"), F.avg("m").alias("mean"), F.percentile("m", 0.975).alias("high"))


@REG.add(f"WITH {PROTOCOL}, s AS (SELECT DISTINCT territory_id, CASE WHEN is_capital = '1' THEN 'capital' WHEN is_capital = '0' THEN 'other' ELSE 'unknown' END AS part FROM territory_static) SELECT part, model, CAST(horizon AS INT) AS horizon, {METRICS} FROM pr JOIN s USING (territory_id) WHERE y_pred IS NOT NULL GROUP BY 1, 2, 3", METRIC_NAMES)
def ref_e10_subgroups(spark, sf_dir):
    part = F.when(F.col("is_capital") == "1", "capital").when(F.col("is_capital") == "0", "other").otherwise("unknown")
    s = read_table(spark, sf_dir, "territory_static").select("territory_id", part.alias("part")).distinct()
    return metrics.metric_table(get_protocol(spark, sf_dir).join(s, "territory_id"), ["part", "model", "horizon"])


@REG.add(f"WITH {DENSE}, ev AS (SELECT DISTINCT territory_id AS e, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS t FROM top_shocks_news WHERE \"уровень\" = 'шок') SELECT d.e, d.c, d.t, d.y FROM dense d SEMI JOIN ev ON d.e = ev.e AND d.t = ev.t + 1 WHERE d.y IS NOT NULL", "y")
def ref_j15_month_after_event(spark, sf_dir):
    ev = read_table(spark, sf_dir, "top_shocks_news").where(F.col("уровень") == "шок").select(F.col("territory_id").alias("e"), (month_number(F.col("month")) + 1).alias("t")).distinct()
    return get_dense(spark, sf_dir).where("y is not null").join(ev, ["e", "t"], "left_semi").select("e", "c", "t", "y")


@REG.add("SELECT territory_id, string_agg(month, '|' ORDER BY month) AS months, count(*) AS n FROM (SELECT DISTINCT territory_id, month FROM top_shocks_news) GROUP BY territory_id")
def ref_g11_joined_months(spark, sf_dir):
    s = read_table(spark, sf_dir, "top_shocks_news").select("territory_id", "month").distinct()
    return s.groupBy("territory_id").agg(F.array_join(F.array_sort(F.collect_list("month")), "|").alias("months"), F.count(F.lit(1)).alias("n"))


@REG.add(f"WITH {DENSE}, f AS (SELECT DISTINCT territory_id AS e, month FROM top_shocks_news WHERE \"уровень\" = 'шок'), w AS (SELECT DISTINCT territory_id AS e, month FROM top_shocks_news WHERE \"уровень\" = 'внимание') SELECT 'both' AS part, count(*) AS n FROM (SELECT e FROM f INTERSECT SELECT e FROM w) UNION ALL SELECT 'shock only', count(*) FROM (SELECT e FROM f EXCEPT SELECT e FROM w) UNION ALL SELECT 'watch only', count(*) FROM (SELECT e FROM w EXCEPT SELECT e FROM f)")
def ref_s02_sets_of_entities(spark, sf_dir):
    s = read_table(spark, sf_dir, "top_shocks_news").groupBy("territory_id").agg(F.max((F.col("уровень") == "шок").cast("int")).alias("f"), F.max((F.col("уровень") == "внимание").cast("int")).alias("w"))
    n = lambda c, name: F.struct(F.lit(name).alias("part"), F.count(F.when(c, 1)).alias("n"))
    f, w = F.coalesce("f", F.lit(0)) == 1, F.coalesce("w", F.lit(0)) == 1
    return s.agg(F.array(n(f & w, "both"), n(f & ~w, "shock only"), n(w & ~f, "watch only")).alias("x")).select(F.explode("x").alias("x")).select("x.part", "x.n")


@REG.add()
def ref_p06_season_clusters(spark, sf_dir):
    from panelmill.operators import models

    return models.season_clusters(get_dense(spark, sf_dir))


QUERIES, ORACLE = REG.queries, REG.oracle
