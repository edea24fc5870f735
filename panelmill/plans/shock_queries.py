"""Queries of the shock operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions import month_number
from panelmill.operators import outliers, shocks
from panelmill.plans.evaluation import get_forecasts, get_shocked
from panelmill.plans.panels import get_dense, get_regions
from panelmill.plans.registry import Registry
from panelmill.plans.sql import DENSE, FORECASTS, PEER, SPLIT, STANDARD
from panelmill.sources.tables import durable, exact_rows, read_table

REG = Registry()


def get_peer(spark, sf_dir):
    return shocks.peer_deviations(get_dense(spark, sf_dir), get_regions(spark, sf_dir))


def get_standard(spark, sf_dir):
    return shocks.standardise(get_peer(spark, sf_dir))


def get_split(spark, sf_dir):
    return shocks.split_region(get_standard(spark, sf_dir))


@REG.add(f"WITH {PEER} SELECT * FROM peer", "d level_prev")
def ref_p25_peer_deviations(spark, sf_dir):
    return get_peer(spark, sf_dir)


@REG.add(f"WITH {FORECASTS} SELECT territory_id AS e, category AS c, month, model, ln(greatest(y_true, 1.0) / greatest(y_pred, 1.0)) AS d, y_last AS level_prev, y_pred AS expected FROM fc WHERE step = 1 AND y_true IS NOT NULL AND y_pred IS NOT NULL", "d level_prev expected")
def ref_p26_forecast_deviations(spark, sf_dir):
    return shocks.forecast_deviations(get_forecasts(spark, sf_dir))


@REG.add(f"WITH {STANDARD} SELECT * FROM std", "d level_prev z")
def ref_p23_standardise(spark, sf_dir):
    return get_standard(spark, sf_dir)


VOL_SQL = f"""WITH {STANDARD}, o AS (SELECT t, dense_rank() OVER (ORDER BY t) - 1 AS j FROM (SELECT DISTINCT t FROM std)), x AS (SELECT e, c, t, z, j FROM std JOIN o USING (t) WHERE z IS NOT NULL),
p AS (SELECT a.e, a.c, a.t, b.z, median(b.z) OVER (PARTITION BY a.e, a.c, a.t) AS m FROM x a JOIN x b ON a.e = b.e AND a.c = b.c AND b.j < greatest(a.j, {{warm}})),
v AS (SELECT e, c, t, count(*) AS n, greatest(1.4826 * median(abs(z - m)), 1.0) AS vol FROM p GROUP BY e, c, t)
SELECT x.e, x.c, x.t, CASE WHEN coalesce(n, 0) >= {{least}} THEN vol ELSE 1.0 END AS vol FROM x LEFT JOIN v ON x.e = v.e AND x.c = v.c AND x.t = v.t"""


@REG.add(VOL_SQL.format(warm=6, least=1), "vol")
def ref_p24_own_volatility(spark, sf_dir):
    return shocks.expanding_scale(get_standard(spark, sf_dir), 1, 6)


@REG.add(VOL_SQL.format(warm=0, least=3), "vol")
def ref_w08_adaptive_scale(spark, sf_dir):
    return shocks.expanding_scale(get_standard(spark, sf_dir), 3, None)


@REG.add(f"WITH {SPLIT} SELECT e, c, t, z, z_reg, z_loc FROM split", "z z_reg z_loc")
def ref_p28_region_split(spark, sf_dir):
    return get_split(spark, sf_dir).select("e", "c", "t", "z", "z_reg", "z_loc")


@REG.add(f"WITH {SPLIT} SELECT e, t, sqrt(sum(z_loc * z_loc) / 3) AS topk FROM (SELECT *, row_number() OVER (PARTITION BY e, t ORDER BY abs(z_loc) DESC, c) AS rn FROM split WHERE z_loc IS NOT NULL) WHERE rn <= 3 GROUP BY ALL", "topk")
def ref_t02_top_three(spark, sf_dir):
    return shocks.top_rms(get_split(spark, sf_dir), "z_loc")


COMBINE_SQL = f"""WITH {STANDARD}, z AS (SELECT e, c, t, region, greatest(least(z, 8.0), -8.0) AS z FROM std),
s AS (SELECT e, t, any_value(region) AS region, sqrt(avg(z * z)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY e, t ORDER BY abs(z) DESC, c) AS rn FROM z WHERE z IS NOT NULL) WHERE rn <= 3 GROUP BY e, t)
SELECT e, t, region, score, score >= 3 AS flag, avg(CASE WHEN score >= 3 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY region, t) >= 0.3 AND count(*) OVER (PARTITION BY region, t) >= 5 AS regional FROM s"""


@REG.add(COMBINE_SQL, "score")
def ref_p27_combine(spark, sf_dir):
    return shocks.combine(get_standard(spark, sf_dir)).select("e", "t", "region", "score", "flag", "regional")


@REG.add(f"WITH {SPLIT} SELECT a.e, a.c, a.t, (coalesce(a.z_loc, 0) + coalesce(b.z_loc, 0)) / sqrt(2) AS w FROM split a LEFT JOIN split b ON a.e = b.e AND a.c = b.c AND a.t = b.t + 1", "w")
def ref_w09_two_month_sum(spark, sf_dir):
    return shocks.window_sum(get_split(spark, sf_dir), "z_loc")


VECTOR = ["Все категории", "Продовольствие", "Здоровье", "Маркетплейсы", "Общественное питание", "Транспорт"]


def vectors(split):
    """(e, t, one column of local z per category)."""
    return split.groupBy("e", "t").agg(*[F.max(F.when(F.col("c") == c, F.col("z_loc"))).alias(f"v{i}") for i, c in enumerate(VECTOR)])


def all_scores(v):
    """(e, t, topk, mahal, iforest, combo) of written vectors."""
    names = [f"v{i}" for i in range(len(VECTOR))]
    zero = [F.coalesce(F.col(c), F.lit(0.0)) for c in names]
    top = F.slice(F.sort_array(F.array(*[x * x for x in zero]), asc=False), 1, 3)
    fit = outliers.robust_location(v, names)
    s = v.select("e", "t", F.sqrt(F.aggregate(top, F.lit(0.0), lambda a, b: a + b) / 3).alias("topk"), F.sqrt(F.greatest(fit.squared(names), F.lit(0.0))).alias("mahal"))
    s = durable(s.join(outliers.isolation_scores(v, ["e", "t"], names), ["e", "t"]), "scores")
    return shocks.combo(s, "topk", "mahal")


@REG.add()
def ref_p29_scores(spark, sf_dir):
    """All four scores of the local z: robust distance and isolation trees are fitted, so there is no SQL; tests compare them with NumPy."""
    return all_scores(durable(vectors(get_split(spark, sf_dir)), "vectors"))


def get_scores(spark, sf_dir):
    return exact_rows(read_table(spark, sf_dir, "top_shocks_news"), "shock_id", "territory_id", "month", "topk", "mahal").where("topk is not null and not isnan(topk) and mahal is not null and not isnan(mahal)")


SCORES = "sc AS (SELECT DISTINCT shock_id, territory_id, month, topk, mahal FROM top_shocks_news WHERE topk IS NOT NULL AND NOT isnan(topk) AND mahal IS NOT NULL AND NOT isnan(mahal))"
COMBO_SQL = f"WITH {SCORES}, c AS (SELECT *, greatest((rank() OVER (ORDER BY topk) + (count(*) OVER (PARTITION BY topk) - 1) / 2) / count(*) OVER (), (rank() OVER (ORDER BY mahal) + (count(*) OVER (PARTITION BY mahal) - 1) / 2) / count(*) OVER ()) AS combo FROM sc)"


@REG.add(f"{COMBO_SQL} SELECT shock_id, combo FROM c", "combo")
def ref_p29_combo_score(spark, sf_dir):
    return shocks.combo(get_scores(spark, sf_dir), "topk", "mahal").select("shock_id", "combo")


@REG.add(f"{COMBO_SQL}, q AS (SELECT quantile_cont(combo, [0.99, 0.97]) AS q FROM c) SELECT shock_id, CASE WHEN combo >= q[1] THEN 'shock' WHEN combo >= q[2] THEN 'watch' ELSE '' END AS level FROM c, q")
def ref_p30_levels(spark, sf_dir):
    scored = durable(shocks.combo(get_scores(spark, sf_dir), "topk", "mahal"), "combo")
    return shocks.levels(scored, "combo").select("shock_id", "level")


DRIVERS_SQL = f"""WITH {STANDARD}, r AS (SELECT *, row_number() OVER (PARTITION BY e, t ORDER BY round(abs(z), 9) DESC, c) AS rn, CAST(round((exp(d) - 1) * 100) AS BIGINT) AS pct FROM std WHERE z IS NOT NULL)
SELECT e, t, max(c) FILTER (WHERE rn = 1) AS main, coalesce(string_agg(CASE WHEN abs(z) >= 2 THEN concat(c, ' ', CASE WHEN pct >= 0 THEN '+' ELSE '' END, pct, '%') END, ', ' ORDER BY rn), '') AS drivers FROM r WHERE rn <= 3 GROUP BY e, t"""


@REG.add(DRIVERS_SQL)
def ref_t06_drivers(spark, sf_dir):
    return shocks.drivers(get_standard(spark, sf_dir))


@REG.add(
    f"""WITH {PEER}, n AS (SELECT e, c, t, lf, lead(lf) OVER w AS nx, lead(lf) OVER w - lf AS g FROM lg WINDOW w AS (PARTITION BY c, e ORDER BY t)), m AS (SELECT *, median(g) OVER (PARTITION BY c, t) AS common FROM n),
p AS (SELECT peer.e, peer.c, peer.t, d, (nx - (lf - d) - common) / nullif(d, 0) AS p FROM peer JOIN m USING (e, c, t))
SELECT e, c, t, d, p, CASE WHEN p IS NULL THEN NULL WHEN p >= 1.5 THEN 'escalating' WHEN p >= 0.5 THEN 'level shift' WHEN p > -0.5 THEN 'one-off' WHEN d < 0 THEN 'dip-rebound' ELSE 'spike-drop' END AS kind FROM p WHERE abs(d) > 0.01""",
    "d p",
)
def ref_p34_shock_type(spark, sf_dir):
    p = shocks.persistence(get_peer(spark, sf_dir), get_dense(spark, sf_dir)).where("abs(d) > 0.01")
    return p.withColumn("kind", shocks.shock_type(F.col("d"), F.col("p")))


REGIONAL_SQL = f"""WITH {SPLIT}, r AS (SELECT DISTINCT region, c, t, z_reg FROM split), k AS (SELECT region, t, sqrt(sum(z_reg * z_reg) / 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY region, t ORDER BY abs(z_reg) DESC, c) AS rn FROM r) WHERE rn <= 3 GROUP BY ALL)
SELECT region, t, score, score >= quantile_cont(score, 0.98) OVER () AS flag FROM k"""


@REG.add(REGIONAL_SQL, "score")
def ref_p35_regional_table(spark, sf_dir):
    r = get_split(spark, sf_dir).select(F.col("region").alias("e"), "c", "t", "z_reg").distinct()
    k = durable(shocks.top_rms(r, "z_reg").select(F.col("e").alias("region"), "t", F.col("topk").alias("score")), "regional")
    q = k.agg(F.percentile("score", 0.98)).first()[0]
    return k.withColumn("flag", F.col("score") >= F.lit(q))


def standard_sql(rows: str) -> str:
    """Common table expressions that standardise rows (e, c, t, d, level_prev) as `standardise` does: result zs."""
    return f"""z0 AS (SELECT *, row_number() OVER (PARTITION BY c, t ORDER BY level_prev ASC NULLS LAST, e) AS rn, count(level_prev) OVER (PARTITION BY c, t) AS n FROM {rows}),
z1 AS (SELECT *, CASE WHEN level_prev IS NULL THEN NULL WHEN n <= 1 THEN 0 ELSE greatest(CAST(floor(((rn - 1) * 5 + n - 2) / (n - 1)) AS INT) - 1, 0) END AS q FROM z0),
z2 AS (SELECT *, median(d) OVER (PARTITION BY c, t, q) AS m FROM z1), z3 AS (SELECT *, greatest(1.4826 * median(abs(d - m)) OVER (PARTITION BY c, t, q), 0.0001) AS s FROM z2),
zs AS (SELECT e, c, t, (d - m) / s AS z FROM z3)"""


@REG.add(f"WITH {PEER}, j AS (SELECT e, c, t, gf AS d, level_prev FROM gr WHERE gf IS NOT NULL), {standard_sql('j')} SELECT * FROM zs", "z")
def ref_p37_jump_detector(spark, sf_dir):
    return shocks.standardise(shocks.jump_deviations(get_dense(spark, sf_dir))).select("e", "c", "t", "z")


GAPS_SQL = f"{DENSE}, gp AS (SELECT e, c, t, region, lf - median(lf) OVER (PARTITION BY c, t, region) AS g FROM lg JOIN reg USING (e))"


LEVEL_SQL = f"""{DENSE}, mr AS (SELECT region, count(DISTINCT e) AS k FROM reg JOIN (SELECT DISTINCT e FROM dense) USING (e) GROUP BY region),
lv0 AS (SELECT e, c, t, y, lf - CASE WHEN k >= 5 THEN median(lf) OVER (PARTITION BY c, t, region) ELSE median(lf) OVER (PARTITION BY c, t) END AS r FROM lg JOIN reg USING (e) JOIN mr USING (region)),
lv1 AS (SELECT e, c, t, lag(y) OVER (PARTITION BY c, e ORDER BY t) AS level_prev, CASE WHEN count(r) OVER w >= 3 THEN r - avg(r) OVER w END AS d FROM lv0 WINDOW w AS (PARTITION BY c, e ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
lv AS (SELECT * FROM lv1 WHERE d IS NOT NULL AND level_prev IS NOT NULL)"""


@REG.add(f"WITH {LEVEL_SQL}, {standard_sql('lv')} SELECT * FROM zs", "z")
def ref_p37_level_detector(spark, sf_dir):
    return shocks.standardise(shocks.level_deviations(get_dense(spark, sf_dir), get_regions(spark, sf_dir))).select("e", "c", "t", "z")


@REG.add(
    f"""WITH {SPLIT}, u AS (SELECT e, c, t, z_loc, coalesce(z_loc, 0) AS a, coalesce(lag(z_loc) OVER w, 0) AS b, coalesce(lag(z_loc, 2) OVER w, 0) AS d, row_number() OVER w AS rn FROM split WINDOW w AS (PARTITION BY c, e ORDER BY t))
SELECT e, c, t, greatest(0, a - 0.5, -a - 0.5, CASE WHEN rn > 1 THEN a + b - 1.0 END, CASE WHEN rn > 1 THEN -a - b - 1.0 END, CASE WHEN rn > 2 THEN a + b + d - 1.5 END, CASE WHEN rn > 2 THEN -a - b - d - 1.5 END) AS cusum FROM u""",
    "cusum",
)
def ref_w20_cusum(spark, sf_dir):
    return shocks.cusum(get_split(spark, sf_dir), "z_loc").select("e", "c", "t", "cusum")


HIT_SQL = """hit AS (SELECT DISTINCT territory_id AS e, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS t FROM top_shocks_news WHERE "уровень" = 'шок')"""
PICK_SQL = "list_sort((SELECT list(DISTINCT c) FROM peer))[CAST((CAST(concat('0x', substr(md5(concat(e, '|', t)), 1, 16)) AS UBIGINT)::HUGEINT % 10000 * 1616 + CAST(concat('0x', substr(md5(concat(e, '|', t)), 17, 16)) AS UBIGINT)::HUGEINT % 10000) % 10000 AS INT) % (SELECT count(DISTINCT c) FROM peer) + 1]"
CASES_SQL = {k: ("CASE WHEN c = pick THEN -1.0 END" if m is None else "CASE c " + " ".join(f"WHEN '{c}' THEN {v!r}" for c, v in m.items()) + " END") for k, m in shocks.SCENARIOS.items()}


@REG.add(
    f"""WITH {PEER}, {HIT_SQL}, k AS (SELECT *, {PICK_SQL} AS pick FROM hit),
m AS ({" UNION ALL ".join(f"SELECT '{s}' AS scenario, p.*, CASE WHEN k.e IS NOT NULL THEN {case} END AS m FROM peer p LEFT JOIN k USING (e, t)" for s, case in CASES_SQL.items())})
SELECT scenario, x, e, c, t, d + coalesce(ln(1 + m * x), 0.0) AS d FROM m, (SELECT unnest([0.05, 0.1, 0.2, 0.3]) AS x)""",
    "d x",
)
def ref_p31_injection(spark, sf_dir):
    """Every scenario at every size, at the entity-months that are marked as shocks."""
    peer = durable(get_peer(spark, sf_dir), "peer")
    names = [r["c"] for r in peer.select("c").distinct().collect()]
    keys = get_shocked(spark, sf_dir).withColumn("pick", shocks.drawn_category(names, "e", "t"))
    parts = [shocks.inject(peer, keys, s, x).select(F.lit(s).alias("scenario"), F.lit(x).alias("x"), "e", "c", "t", "d") for s in shocks.SCENARIOS for x in shocks.SIZES]
    return reduce(DataFrame.unionByName, parts)


PATHS_SQL = f"""WITH {GAPS_SQL}, {HIT_SQL}, w AS (SELECT e, c, t, g, lag(g) OVER w AS b, """ + ", ".join(f"lead(g, {k}) OVER w AS g{k}" for k in range(1, 7)) + """ FROM gp WINDOW w AS (PARTITION BY c, e ORDER BY t)),
ms AS (SELECT DISTINCT territory_id AS e, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS t, "главная категория" AS c FROM top_shocks_news WHERE "уровень" = 'шок'),
ev AS (SELECT w.*, CASE WHEN ms.e IS NOT NULL THEN 'shock' ELSE 'jump' END AS kind FROM w LEFT JOIN ms USING (e, c, t) LEFT JOIN hit h ON h.e = w.e AND h.t = w.t WHERE abs(g - b) >= 0.05 AND (ms.e IS NOT NULL OR h.e IS NULL AND w.t >= (SELECT min(t) FROM hit))),
pa AS (""" + " UNION ALL ".join(f"SELECT kind, e, c, t, g - b AS size, {k} AS k, (g{k} - b) / (g - b) AS \"left\" FROM ev" for k in range(1, 7)) + ")"
MONTH_SQL = f"{PATHS_SQL}, mo AS (SELECT kind, e, c, t, any_value(size) AS size, CASE WHEN min(k) FILTER (WHERE abs(\"left\") < 1.0 / 3) IS NOT NULL THEN min(k) FILTER (WHERE abs(\"left\") < 1.0 / 3) WHEN max(\"left\") FILTER (WHERE k = 6) IS NOT NULL THEN 7 END AS month FROM pa GROUP BY kind, e, c, t)"


def get_paths(spark, sf_dir):
    """Recovery after marked shocks in their main category, and after equally large jumps of unmarked entity-months as control."""
    g = durable(shocks.gaps(get_dense(spark, sf_dir), get_regions(spark, sf_dir)), "gaps")
    hit = durable(get_shocked(spark, sf_dir), "hit")
    main = read_table(spark, sf_dir, "top_shocks_news").where(F.col("уровень") == "шок").select(F.col("territory_id").alias("e"), month_number(F.col("month")).alias("t"), F.col("главная категория").alias("c")).distinct()
    first = hit.agg(F.min("t")).first()[0]
    other = g.where(F.col("t") >= F.lit(first)).join(hit, ["e", "t"], "left_anti").select("e", "c", "t")
    return durable(shocks.recovery(g, main).withColumn("kind", F.lit("shock")).unionByName(shocks.recovery(g, other).withColumn("kind", F.lit("jump"))), "paths")


@REG.add(f"{PATHS_SQL} SELECT * FROM pa", "size left")
def ref_p38_recovery_paths(spark, sf_dir):
    return get_paths(spark, sf_dir)


@REG.add(f"{MONTH_SQL} SELECT kind, e, c, t, month FROM mo")
def ref_p38_recovery_month(spark, sf_dir):
    p = get_paths(spark, sf_dir)
    return shocks.recovery_month(p.where("kind = 'shock'")).withColumn("kind", F.lit("shock")).unionByName(shocks.recovery_month(p.where("kind = 'jump'")).withColumn("kind", F.lit("jump")))


@REG.add(f"{PATHS_SQL} SELECT kind, CASE WHEN abs(size) < 0.1 THEN 0 WHEN abs(size) < 0.2 THEN 1 WHEN abs(size) < 0.4 THEN 2 ELSE 3 END AS bin, k, median(\"left\") AS med, count(\"left\") AS n FROM pa GROUP BY ALL", "med")
def ref_p38_recovery_bins(spark, sf_dir):
    return get_paths(spark, sf_dir).groupBy("kind", shocks.size_class(F.col("size")).alias("bin"), "k").agg(F.median("left").alias("med"), F.count("left").alias("n"))


@REG.add(f"{MONTH_SQL} SELECT kind, c, 100 * avg(CASE WHEN month <= 1 THEN 1.0 ELSE 0.0 END) AS within_1, 100 * avg(CASE WHEN month <= 3 THEN 1.0 ELSE 0.0 END) AS within_3, 100 * avg(CASE WHEN month > 6 THEN 1.0 ELSE 0.0 END) AS not_in_6, count(*) AS n FROM mo WHERE month IS NOT NULL GROUP BY kind, c", "within_1 within_3 not_in_6")
def ref_p38_recovery_time(spark, sf_dir):
    m = ref_p38_recovery_month(spark, sf_dir).where("month is not null")
    part = lambda c: 100 * F.avg(c.cast("double"))
    return m.groupBy("kind", "c").agg(part(F.col("month") <= 1).alias("within_1"), part(F.col("month") <= 3).alias("within_3"), part(F.col("month") > 6).alias("not_in_6"), F.count(F.lit(1)).alias("n"))


DISAGREE_SQL = f"""WITH s AS (SELECT DISTINCT shock_id, topk, mahal FROM top_shocks_news WHERE isfinite(topk) AND isfinite(mahal)), q AS (SELECT quantile_cont(topk, 0.95) AS a, quantile_cont(mahal, 0.95) AS b FROM s), f AS (SELECT topk >= a AS x, mahal >= b AS y FROM s, q)
SELECT count(*) FILTER (WHERE x AND y) AS both_flags, count(*) FILTER (WHERE x AND NOT y) AS only_a, count(*) FILTER (WHERE y AND NOT x) AS only_b, count(*) FILTER (WHERE x AND y) / nullif(count(*) FILTER (WHERE x OR y), 0) AS jaccard FROM f"""


@REG.add(DISAGREE_SQL, "jaccard")
def ref_p47_disagreement(spark, sf_dir):
    inf = float("inf")
    s = durable(get_scores(spark, sf_dir).where((F.abs("topk") < inf) & (F.abs("mahal") < inf)), "scores")
    q = s.agg(F.percentile("topk", 0.95).alias("a"), F.percentile("mahal", 0.95).alias("b")).first()
    x, y = F.col("topk") >= F.lit(q["a"]), F.col("mahal") >= F.lit(q["b"])
    n = lambda c: F.count(F.when(c, 1))
    return s.agg(n(x & y).alias("both_flags"), n(x & ~y).alias("only_a"), n(y & ~x).alias("only_b"), (n(x & y) / F.nullif(n(x | y), F.lit(0))).alias("jaccard"))


@REG.add(
    f"""WITH {SPLIT}, s AS (SELECT e, t, c, coalesce(z_loc, 0) AS z FROM split), o AS (SELECT e, t + 12 AS t, c, z AS zo FROM s), j AS (SELECT s.*, zo FROM s JOIN o USING (e, t, c)), k AS (SELECT e, t, avg(z) AS a, avg(zo) AS b FROM j GROUP BY ALL)
SELECT j.e, j.t, sum((z - a) * (zo - b)) / (sqrt(sum((z - a) ** 2) * sum((zo - b) ** 2)) + 1e-12) AS r FROM j JOIN k USING (e, t) GROUP BY ALL""",
    "r",
)
def ref_g15_last_year_alignment(spark, sf_dir):
    s = get_split(spark, sf_dir).select("e", "t", "c", F.coalesce("z_loc", F.lit(0.0)).alias("z"))
    o = s.select("e", (F.col("t") + 12).alias("t"), "c", F.col("z").alias("zo"))
    j = s.join(o, ["e", "t", "c"])
    return j.groupBy("e", "t").agg((F.covar_pop("z", "zo") * F.count(F.lit(1)) / (F.sqrt(F.var_pop("z") * F.var_pop("zo")) * F.count(F.lit(1)) + 1e-12)).alias("r"))


@REG.add('SELECT month, "тип" AS kind, count(DISTINCT shock_id) AS n FROM top_shocks_news WHERE "уровень" = \'шок\' GROUP BY ALL')
def ref_e16_shocks_by_month(spark, sf_dir):
    return read_table(spark, sf_dir, "top_shocks_news").where(F.col("уровень") == "шок").groupBy("month", F.col("тип").alias("kind")).agg(F.countDistinct("shock_id").alias("n"))


@REG.add("""SELECT DISTINCT shock_id, sign(TRY_CAST(regexp_extract("главное", '([+-][0-9]+)%', 1) AS DOUBLE)) AS direction FROM top_shocks_news""", "direction")
def ref_e16_map_sign(spark, sf_dir):
    pct = F.regexp_extract("главное", r"([+-][0-9]+)%", 1).try_cast("double")
    return read_table(spark, sf_dir, "top_shocks_news").select("shock_id", F.signum(pct).alias("direction")).distinct()


QUERIES, ORACLE = REG.queries, REG.oracle
