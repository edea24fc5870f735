"""Common table expressions of the SQL twins."""

PANEL = """
p0 AS (SELECT *, row_number() OVER (PARTITION BY territory_id, category, date ORDER BY loaded_at DESC) AS rn FROM consumption),
panel AS (SELECT territory_id AS e, category AS c, CAST(substr(date, 1, 4) AS INT) * 12 + CAST(substr(date, 6, 2) AS INT) - 1 AS t, CASE WHEN isfinite(value) THEN value END AS y FROM p0 WHERE rn = 1)"""
DENSE = (
    PANEL
    + """,
dense AS (SELECT g.e, g.c, g.t, p.y FROM (SELECT e, c, t FROM (SELECT DISTINCT e FROM panel), (SELECT DISTINCT c FROM panel), (SELECT DISTINCT t FROM panel)) g LEFT JOIN panel p ON g.e = p.e AND g.c = p.c AND g.t = p.t),
lg AS (SELECT *, CASE WHEN y > 0 THEN ln(y) END AS l, CASE WHEN y IS NOT NULL THEN ln(greatest(y, 1.0)) END AS lf FROM dense),
reg AS (SELECT DISTINCT territory_id AS e, region FROM territory_static)"""
)
GROWTH = (
    DENSE
    + """,
gr AS (SELECT *, l - lag(l) OVER (PARTITION BY c, e ORDER BY t) AS g, lf - lag(lf) OVER (PARTITION BY c, e ORDER BY t) AS gf, lag(y) OVER (PARTITION BY c, e ORDER BY t) AS level_prev FROM lg)"""
)
PEER = (
    GROWTH
    + """,
pr0 AS (SELECT gr.*, region, count(gf) OVER (PARTITION BY c, t, region) AS n, median(gf) OVER (PARTITION BY c, t, region) AS mr, median(gf) OVER (PARTITION BY c, t) AS ma FROM gr JOIN reg USING (e)),
peer AS (SELECT e, c, t, region, gf - CASE WHEN n >= 5 THEN mr ELSE ma END AS d, level_prev FROM pr0 WHERE gf IS NOT NULL AND CASE WHEN n >= 5 THEN mr ELSE ma END IS NOT NULL)"""
)
STANDARD = (
    PEER
    + """,
sd0 AS (SELECT *, row_number() OVER (PARTITION BY c, t ORDER BY level_prev ASC NULLS LAST, e) AS rn, count(level_prev) OVER (PARTITION BY c, t) AS n FROM peer),
sd1 AS (SELECT *, CASE WHEN level_prev IS NULL THEN NULL WHEN n <= 1 THEN 0 ELSE greatest(CAST(floor(((rn - 1) * 5 + n - 2) / (n - 1)) AS INT) - 1, 0) END AS q FROM sd0),
sd2 AS (SELECT *, median(d) OVER (PARTITION BY c, t, q) AS m FROM sd1),
sd3 AS (SELECT *, greatest(1.4826 * median(abs(d - m)) OVER (PARTITION BY c, t, q), 0.0001) AS s FROM sd2),
std AS (SELECT e, c, t, region, d, level_prev, CAST(q AS INT) AS q, (d - m) / s AS z FROM sd3)"""
)
SPLIT = (
    STANDARD
    + """,
sp0 AS (SELECT e, c, t, region, d, greatest(least(z, 8.0), -8.0) AS z FROM std),
spn AS (SELECT region, t, count(DISTINCT e) AS n FROM sp0 GROUP BY ALL),
sp1 AS (SELECT sp0.*, CASE WHEN n >= 5 THEN median(z) OVER (PARTITION BY region, t, c) ELSE 0.0 END AS z_reg FROM sp0 JOIN spn USING (region, t)),
split AS (SELECT *, z - z_reg AS z_loc FROM sp1)"""
)
FORECASTS = """
f0 AS (SELECT DISTINCT * FROM forecasts),
fc AS (SELECT run_id, model, category, territory_id, origin, step, month, CASE WHEN isfinite(y_true) THEN y_true END AS y_true, CASE WHEN isfinite(y_pred) THEN y_pred END AS y_pred, CASE WHEN isfinite(y_last) THEN y_last END AS y_last, q05, q95 FROM f0)"""
PROTOCOL = (
    FORECASTS
    + """,
pr AS (SELECT fc.*, h AS horizon FROM fc, (SELECT unnest([1, 3, 6, 12]) AS h) WHERE y_true IS NOT NULL AND y_last IS NOT NULL AND step <= h AND origin >= 12 AND origin <= 24 - h AND (origin - 12) % h = 0)"""
)
METRICS = """avg(abs(y_pred - y_true)) AS "MAE", sqrt(avg((y_pred - y_true) ** 2)) AS "RMSE", 100 * sum(abs(y_pred - y_true)) / nullif(sum(abs(y_true)), 0) AS "WAPE",
100 * avg(abs(y_pred - y_true) / nullif(abs(y_true), 0)) AS "MAPE", 100 * avg(2 * abs(y_pred - y_true) / nullif(abs(y_true) + abs(y_pred), 0)) AS "sMAPE", avg(y_pred - y_true) AS "ME",
1 - sum((y_pred - y_true) ** 2) / nullif(var_pop(y_true) * count(*), 0) AS "R2",
1 - sum(CASE WHEN y_true > 0 AND y_last > 0 THEN (ln(greatest(y_pred, 1e-9) / y_last) - ln(y_true / y_last)) ** 2 END) / nullif(var_pop(CASE WHEN y_true > 0 AND y_last > 0 THEN ln(y_true / y_last) END) * count(CASE WHEN y_true > 0 AND y_last > 0 THEN 1 END), 0) AS "R2_growth", count(*) AS n"""
METRIC_NAMES = "MAE RMSE WAPE MAPE sMAPE ME R2 R2_growth"
