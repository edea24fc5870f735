"""Queries of the sources, panel and feature operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelmill.functions import finite, hash_share, host_name, normalised_name
from panelmill.operators import external, panel
from panelmill.operators.asof import with_release
from panelmill.plans.registry import Registry
from panelmill.plans.sql import DENSE, GROWTH, PANEL
from panelmill.sources.tables import durable, exact_rows, read_table

REG = Registry()
TOTAL = "Все категории"


def get_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.load_panel(read_table(spark, sf_dir, "consumption"))


def get_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.densify(get_panel(spark, sf_dir))


def get_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the dense panel that have a reading, without a grid. Rows move once, by entity, so what follows by entity needs no exchange."""
    rows = read_table(spark, sf_dir, "consumption").repartition("territory_id")
    return panel.load_panel(rows).where("e is not null and c is not null and t is not null and y is not null")


def get_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "territory_static").select(F.col("territory_id").alias("e"), "region").distinct()


@REG.add(f"WITH {PANEL} SELECT * FROM panel", "y")
def ref_a01_consumption(spark, sf_dir):
    return get_panel(spark, sf_dir)


@REG.add(f"WITH {PANEL} SELECT e FROM panel WHERE y IS NOT NULL GROUP BY e HAVING count(*) = (SELECT count(DISTINCT t) * count(DISTINCT c) FROM panel)")
def ref_a02_complete_entities(spark, sf_dir):
    return panel.complete_entities(get_panel(spark, sf_dir))


@REG.add(f"WITH {DENSE} SELECT * FROM dense", "y")
def ref_a03_dense_panel(spark, sf_dir):
    return get_dense(spark, sf_dir)


@REG.add("SELECT s.territory_id, CASE WHEN NOT isnan(m.market_access) THEN m.market_access END AS market_access FROM (SELECT DISTINCT territory_id FROM territory_static) s LEFT JOIN (SELECT DISTINCT * FROM market_access) m USING (territory_id)", "market_access")
def ref_a04_market_access(spark, sf_dir):
    ids = read_table(spark, sf_dir, "territory_static").select("territory_id").distinct()
    values = exact_rows(read_table(spark, sf_dir, "market_access"), "territory_id", "market_access")
    return ids.join(values, "territory_id", "left").select("territory_id", F.nanvl("market_access", F.lit(None).cast("double")).alias("market_access"))


@REG.add(
    """WITH r AS (SELECT DISTINCT * FROM rosstat_quarterly), c AS (SELECT indicator, territory_id AS e, year * 4 + quarter - 1 AS q, avg(CASE WHEN isfinite(yoy_log) THEN yoy_log END) AS v FROM r GROUP BY ALL),
g AS (SELECT a.indicator, a.e, b.q FROM (SELECT DISTINCT indicator, e FROM c) a JOIN (SELECT DISTINCT indicator, q FROM c) b USING (indicator))
SELECT g.indicator, g.e, g.q, last_value(v IGNORE NULLS) OVER (PARTITION BY g.indicator, g.e ORDER BY g.q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM g LEFT JOIN c USING (indicator, e, q)""",
    "value",
)
def ref_a05_quarterly_forward_fill(spark, sf_dir):
    rows = exact_rows(read_table(spark, sf_dir, "rosstat_quarterly"), "quarterly_id", "indicator", "territory_id", "year", "quarter", "yoy_log")
    rows = rows.select("indicator", F.col("territory_id").alias("e"), (F.col("year") * 4 + F.col("quarter") - 1).alias("q"), finite("yoy_log").alias("v0"))
    return external.forward_filled(rows, "v0")


EDGES_SQL = """e0 AS (SELECT least(c_nationkey, s_nationkey) AS x, greatest(c_nationkey, s_nationkey) AS y, avg(l_extendedprice) AS distance FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
edges AS (SELECT *, CASE WHEN (x + y) % 2 = 0 THEN 'highway' ELSE 'railway' END AS type FROM e0)"""


def trade_edges(spark, sf_dir) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = j.groupBy(F.least("c_nationkey", "s_nationkey").alias("x"), F.greatest("c_nationkey", "s_nationkey").alias("y")).agg(F.avg("l_extendedprice").alias("distance"))
    return e.withColumn("type", F.when((F.col("x") + F.col("y")) % 2 == 0, "highway").otherwise("railway"))


@REG.add(
    f"""WITH {EDGES_SQL}, b AS (SELECT x AS e, y AS nbr, distance FROM edges WHERE type = 'highway' AND x <> y UNION ALL SELECT y, x, distance FROM edges WHERE type = 'highway' AND x <> y)
SELECT e, rank, nbr, distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY e ORDER BY distance, nbr) AS INT) AS rank FROM b) WHERE rank <= 5""",
    "distance",
)
def ref_a06_nearest_neighbours(spark, sf_dir):
    return external.nearest(trade_edges(spark, sf_dir).where("type = 'highway'"), 5)


REGION_SQL = f"WITH {DENSE}, rm AS (SELECT region, t, avg(y) AS v FROM dense JOIN reg USING (e) WHERE c = '{TOTAL}' AND y > 0 GROUP BY ALL), ri AS (SELECT *, v / lag(v) OVER (PARTITION BY region ORDER BY t) AS cpi FROM rm)"


def region_index(spark, sf_dir) -> DataFrame:
    m = get_dense(spark, sf_dir).where((F.col("c") == TOTAL) & (F.col("y") > 0)).join(get_regions(spark, sf_dir), "e").groupBy("region", "t").agg(F.avg("y").alias("v"))
    return m.withColumn("cpi", F.col("v") / F.lag("v", 1).over(Window.partitionBy("region").orderBy("t")))


@REG.add(f"{REGION_SQL} SELECT region, t, v, CASE WHEN count(cpi) OVER w = 12 THEN sum(ln(cpi)) OVER w END AS roll FROM ri WINDOW w AS (PARTITION BY region ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)", "v roll")
def ref_a08_rolling_inflation(spark, sf_dir):
    return external.rolling_log_sum(region_index(spark, sf_dir), ["region"], "cpi", 12).select("region", "t", "v", "roll")


@REG.add(f"{REGION_SQL}, m AS (SELECT region, t, CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END AS a FROM ri WINDOW w AS (PARTITION BY region ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT region, t, ln(a / lag(a, 12) OVER (PARTITION BY region ORDER BY t)) AS ratio3 FROM m", "ratio3")
def ref_a08_wage_ratio(spark, sf_dir):
    return external.rolling_ratio(region_index(spark, sf_dir), ["region"], "v", 3).select("region", "t", "ratio3")


@REG.add(
    """WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL), g AS (SELECT t, ln(v) - ln(lag(v) OVER (ORDER BY t)) AS g FROM m),
s AS (SELECT t % 12 AS moy, median(g) AS p FROM g WHERE g IS NOT NULL GROUP BY ALL), c AS (SELECT moy, p - avg(p) OVER () AS p FROM s), k AS (SELECT moy, sum(p) OVER (ORDER BY moy) AS s FROM c)
SELECT moy, s - avg(s) OVER () AS level FROM k""",
    "level",
)
def ref_a09_national_season(spark, sf_dir):
    m = read_table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("t")).agg(F.sum("o_totalprice").alias("v"))
    line, all_ = Window.partitionBy(F.lit(1)).orderBy("t"), Window.partitionBy(F.lit(1))
    p = m.withColumn("g", F.ln("v") - F.ln(F.lag("v", 1).over(line))).where("g is not null").groupBy((F.col("t") % 12).alias("moy")).agg(F.median("g").alias("p"))
    p = p.withColumn("p", F.col("p") - F.avg("p").over(all_)).withColumn("s", F.sum("p").over(all_.orderBy("moy")))
    return p.select("moy", (F.col("s") - F.avg("s").over(all_)).alias("level"))


@REG.add("SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE lang = 'ru' GROUP BY source")
def ref_a20_pruned_scan(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").where("lang = 'ru'").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@REG.add("SELECT regexp_replace(regexp_replace(lower(trim(source)), '^www[.]', ''), '^m[.]', '') AS host, pub_date, count(*) AS n FROM documents GROUP BY ALL")
def ref_a21_census(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").groupBy(host_name(F.col("source")).alias("host"), "pub_date").agg(F.count(F.lit(1)).alias("n"))


@REG.add("SELECT min(doc_id) AS doc_id, lower(trim(source)) AS host, pub_date, title FROM documents WHERE pub_date >= DATE '2023-06-01' AND pub_date < DATE '2024-07-01' GROUP BY 2, 3, 4")
def ref_a22_collect_distinct(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("pub_date >= date'2023-06-01' and pub_date < date'2024-07-01'")
    return d.groupBy(F.lower(F.trim("source")).alias("host"), "pub_date", "title").agg(F.min("doc_id").alias("doc_id"))


@REG.add("SELECT lower(trim(source)) AS host, " + ", ".join(f"count(*) FILTER (WHERE quarter(pub_date) = {q}) AS q{q}" for q in range(1, 5)) + ", count(*) AS total FROM documents WHERE pub_date IS NOT NULL GROUP BY 1")
def ref_a22_census_pivot(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("pub_date is not null").select(F.lower(F.trim("source")).alias("host"), F.concat(F.lit("q"), F.quarter("pub_date")).alias("q"))
    p = d.groupBy("host").pivot("q", ["q1", "q2", "q3", "q4"]).count().na.fill(0)
    return p.withColumn("total", F.col("q1") + F.col("q2") + F.col("q3") + F.col("q4"))


@REG.add("SELECT doc_id, CAST((CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 16)) AS UBIGINT)::HUGEINT % 10000 * 1616 + CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 17, 16)) AS UBIGINT)::HUGEINT % 10000) % 10000 AS INT) AS draw FROM documents")
def ref_a23_hash_draw(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", hash_share(F.col("doc_id").cast("string")).alias("draw"))


@REG.add("SELECT territory_id, indicator, value, revision FROM (SELECT *, row_number() OVER (PARTITION BY territory_id, indicator ORDER BY year DESC, quarter DESC, revision DESC, quarterly_id DESC) AS rn FROM (SELECT DISTINCT * FROM rosstat_quarterly)) WHERE rn = 1", "value")
def ref_a25_latest_version(spark, sf_dir):
    return external.latest_row(read_table(spark, sf_dir, "rosstat_quarterly"), ["territory_id", "indicator"], ["year", "quarter", "revision", "quarterly_id"], ["value", "revision"])


VERSIONS_SQL = """ver AS (SELECT DISTINCT s.territory_id, s.mo_type AS code, s.region AS stable, CAST(2021 + s.territory_id % 3 AS INT) AS year_from, CAST(CASE WHEN s.territory_id % 2 = 0 THEN 9999 ELSE 2024 END AS INT) AS year_to, CAST(s.territory_id AS VARCHAR) AS own FROM territory_static s),
fac AS (SELECT DISTINCT quarterly_id, CAST(territory_id AS VARCHAR) AS own, year FROM rosstat_quarterly)"""


def _versions(spark, sf_dir):
    s = read_table(spark, sf_dir, "territory_static").select("territory_id").distinct()
    v = s.select("territory_id", F.col("territory_id").cast("string").alias("own"), (2021 + F.col("territory_id") % 3).cast("int").alias("year_from"), F.when(F.col("territory_id") % 2 == 0, 9999).otherwise(2024).alias("year_to"))
    f = read_table(spark, sf_dir, "rosstat_quarterly").select("quarterly_id", F.col("territory_id").cast("string").alias("own"), "year").distinct()
    return f, v


@REG.add(f"WITH {VERSIONS_SQL} SELECT f.quarterly_id, f.year, v.territory_id FROM fac f LEFT JOIN (SELECT DISTINCT territory_id, own, year_from, year_to FROM ver) v ON f.own = v.own AND v.year_from <= least(f.year, 2023) AND v.year_to > least(f.year, 2023)")
def ref_j01_version_of_year(spark, sf_dir):
    f, v = _versions(spark, sf_dir)
    return external.attach_version(f, v, "own", "year", 2023).select("quarterly_id", "year", "territory_id")


@REG.add(f"WITH {VERSIONS_SQL}, u AS (SELECT own AS s, min(territory_id) AS t FROM ver GROUP BY own HAVING count(DISTINCT territory_id) = 1) SELECT f.quarterly_id, f.year, coalesce(v.territory_id, u.t) AS territory_id FROM fac f LEFT JOIN (SELECT DISTINCT territory_id, own, year_from, year_to FROM ver) v ON f.own = v.own AND v.year_from <= least(f.year, 2023) AND v.year_to > least(f.year, 2023) LEFT JOIN u ON f.own = u.s")
def ref_j02_stable_fallback(spark, sf_dir):
    f, v = _versions(spark, sf_dir)
    return external.attach_version(f, v, "own", "year", 2023, stable="own").select("quarterly_id", "year", "territory_id")


LATEST_Q = "lq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY territory_id, indicator, year, quarter ORDER BY revision DESC, quarterly_id DESC) AS rn FROM rosstat_quarterly) WHERE rn = 1)"


def latest_quarters(spark, sf_dir):
    return external.latest_row(read_table(spark, sf_dir, "rosstat_quarterly"), ["territory_id", "indicator", "year", "quarter"], ["revision", "quarterly_id"], ["value"])


@REG.add(f"WITH {LATEST_Q} SELECT a.territory_id, a.indicator, a.year, a.quarter, a.value, CASE WHEN a.value > 0 AND b.value > 0 THEN ln(a.value / b.value) END AS yoy FROM lq a LEFT JOIN lq b ON a.territory_id = b.territory_id AND a.indicator = b.indicator AND a.quarter = b.quarter AND a.year = b.year + 1", "value yoy")
def ref_j03_year_on_year(spark, sf_dir):
    return external.year_on_year(latest_quarters(spark, sf_dir), ["territory_id", "indicator", "quarter"], "value").select("territory_id", "indicator", "year", "quarter", "value", "yoy")


@REG.add(f"WITH {LATEST_Q} SELECT territory_id, indicator, year, quarter, value - coalesce(lag(value) OVER (PARTITION BY territory_id, indicator, year ORDER BY quarter), 0) AS flow FROM lq", "flow")
def ref_w14_cumulative_to_flow(spark, sf_dir):
    return external.cumulative_to_flow(latest_quarters(spark, sf_dir), ["territory_id", "indicator"], "value").select("territory_id", "indicator", "year", "quarter", "flow")


@REG.add(f"WITH {LATEST_Q}, fl AS (SELECT territory_id, indicator, year, quarter, value - coalesce(lag(value) OVER (PARTITION BY territory_id, indicator, year ORDER BY quarter), 0) AS flow FROM lq) SELECT a.territory_id, a.indicator, a.year, a.quarter, CASE WHEN a.flow > 0 AND b.flow > 0 THEN ln(a.flow / b.flow) END AS yoy FROM fl a JOIN fl b ON a.territory_id = b.territory_id AND a.indicator = b.indicator AND a.quarter = b.quarter AND a.year = b.year + 1", "yoy")
def ref_j04_flow_year_on_year(spark, sf_dir):
    flow = external.cumulative_to_flow(latest_quarters(spark, sf_dir), ["territory_id", "indicator"], "value")
    return external.year_on_year(flow, ["territory_id", "indicator", "quarter"], "flow", "inner").select("territory_id", "indicator", "year", "quarter", "yoy")


@REG.add(
    """WITH a AS (SELECT DISTINCT substr(regexp_replace(lower("регион"), '[^а-яa-z]', '', 'g'), 1, 12) AS k FROM top_shocks_news), b AS (SELECT substr(regexp_replace(replace(lower("регион"), 'ё', 'е'), '[^a-zа-я]', '', 'g'), 1, 12) AS k, count(DISTINCT shock_id) AS n FROM top_shocks_news GROUP BY 1) SELECT * FROM b""",
)
def ref_j05_normalised_key(spark, sf_dir):
    return read_table(spark, sf_dir, "top_shocks_news").groupBy(normalised_name(F.col("регион")).alias("k")).agg(F.countDistinct("shock_id").alias("n"))


@REG.add(
    f"""WITH {DENSE}, q AS (SELECT DISTINCT * FROM rosstat_quarterly WHERE isfinite(yoy_log)), k AS (SELECT q.*, year * 12 + quarter * 3 - 1 + l.lag_months AS lagged FROM q JOIN rosstat_lag l ON q.indicator = l.indicator AND q.year >= l.year_from AND q.year < l.year_to),
g AS (SELECT DISTINCT e, t FROM dense)
SELECT g.e, g.t, k.indicator, max_by(k.yoy_log, year * 4000 + quarter * 1000 + revision) AS ros FROM g JOIN k ON g.e = k.territory_id AND k.lagged <= g.t - 1 GROUP BY ALL""",
    "ros",
)
def ref_j10_published_quarter(spark, sf_dir):
    from panelmill.operators.asof import known_asof

    rows = with_release(read_table(spark, sf_dir, "rosstat_quarterly").where("yoy_log is not null and not isnan(yoy_log) and abs(yoy_log) < double('infinity')").withColumn("release_month", F.lit(None).cast("string")), read_table(spark, sf_dir, "rosstat_lag"))
    rows = rows.withColumnRenamed("territory_id", "e")
    grid = get_dense(spark, sf_dir).select("e", "t", (F.col("t") - 1).alias("at")).distinct()
    return known_asof(grid, rows, "e", "at", "_known", "indicator", ["year", "quarter", "revision"], ["yoy_log"]).select("e", "t", "indicator", F.col("yoy_log").alias("ros"))


FEATURES_SQL = f"""WITH {GROWTH}, f AS (SELECT e, c, t, y, l, CAST(t % 12 + 1 AS VARCHAR) AS month,
lag(l, 1) OVER w - lag(l, 2) OVER w AS dlog_1, lag(l, 2) OVER w - lag(l, 3) OVER w AS dlog_2, lag(l, 3) OVER w - lag(l, 4) OVER w AS dlog_3,
lag(y, 1) OVER w - lag(y, 2) OVER w AS diff_1, lag(y, 2) OVER w - lag(y, 3) OVER w AS diff_2, lag(y, 3) OVER w - lag(y, 4) OVER w AS diff_3,
lag(y, 1) OVER w AS level_1, lag(l, 1) OVER w AS log_level_1,
lag(l, 1) OVER w - avg(l) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS dev_log_mean3, lag(y, 1) OVER w - avg(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS dev_abs_mean3,
lag(l, 1) OVER w - avg(l) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS dev_log_mean6, lag(y, 1) OVER w - avg(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS dev_abs_mean6,
CASE WHEN row_number() OVER w > 3 THEN stddev_pop(g) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END AS vol_dlog_6,
lag(l, 12) OVER w - lag(l, 13) OVER w AS dlog_lag12, lag(y, 12) OVER w - lag(y, 13) OVER w AS diff_lag12,
lag(l, 12) OVER w - lag(l, 1) OVER w AS sn_gap_log, lag(y, 12) OVER w - lag(y, 1) OVER w AS sn_gap_abs, lag(l, 1) OVER w - lag(l, 13) OVER w AS yoy_log_1
FROM gr WINDOW w AS (PARTITION BY c, e ORDER BY t)),
feat AS (SELECT *, median(dlog_1) OVER (PARTITION BY c, t) AS common_dlog_1, median(dlog_lag12) OVER (PARTITION BY c, t) AS common_dlog_lag12 FROM f)"""
FEATURE_NAMES = "y l dlog_1 dlog_2 dlog_3 diff_1 diff_2 diff_3 level_1 log_level_1 dev_log_mean3 dev_abs_mean3 dev_log_mean6 dev_abs_mean6 vol_dlog_6 dlog_lag12 diff_lag12 sn_gap_log sn_gap_abs yoy_log_1 common_dlog_1 common_dlog_lag12"


@REG.add(f"{FEATURES_SQL} SELECT * FROM feat", FEATURE_NAMES)
def ref_p01_features(spark, sf_dir):
    return panel.features(get_dense(spark, sf_dir))


@REG.add(f"{FEATURES_SQL} SELECT e, c, t, " + ", ".join(f"median({x}) OVER (PARTITION BY c, t, region) AS region_{x}" for x in ("dlog_1", "dlog_lag12", "yoy_log_1")) + " FROM feat JOIN reg USING (e)", "region_dlog_1 region_dlog_lag12 region_yoy_log_1")
def ref_p02_regional_features(spark, sf_dir):
    cols = ["dlog_1", "dlog_lag12", "yoy_log_1"]
    return panel.group_features(panel.features(get_dense(spark, sf_dir)).join(get_regions(spark, sf_dir), "e"), "region", cols, "region").select("e", "c", "t", *[f"region_{x}" for x in cols])


NEIGHBOUR_SQL = "nb AS (SELECT e, nbr FROM (SELECT a.e, b.e AS nbr, row_number() OVER (PARTITION BY a.e ORDER BY b.e) AS rn FROM reg a JOIN reg b ON a.region = b.region AND b.e BETWEEN a.e + 1 AND a.e + 20))"


@REG.add(f"{FEATURES_SQL}, {NEIGHBOUR_SQL} SELECT feat.e, feat.c, feat.t, n.nbr_dlog_1 FROM feat LEFT JOIN (SELECT nb.e, o.c, o.t, avg(o.dlog_1) AS nbr_dlog_1 FROM nb JOIN feat o ON o.e = nb.nbr GROUP BY ALL) n ON feat.e = n.e AND feat.c = n.c AND feat.t = n.t", "nbr_dlog_1")
def ref_j13_neighbour_mean(spark, sf_dir):
    r = get_regions(spark, sf_dir)
    links = r.select("e", "region", F.explode(F.sequence(F.col("e") + 1, F.col("e") + 20)).alias("nbr")).join(r.select(F.col("e").alias("nbr"), "region"), ["nbr", "region"]).select("e", "nbr")
    return panel.neighbour_features(panel.features(get_dense(spark, sf_dir)), links, ["dlog_1"]).select("e", "c", "t", "nbr_dlog_1")


@REG.add(f"{FEATURES_SQL} SELECT e, c, t, " + ", ".join(f"{x} - median({x}) OVER (PARTITION BY c, t, region) AS rel_{x}" for x in ("dlog_1", "yoy_log_1", "log_level_1", "dev_log_mean6")) + " FROM feat JOIN reg USING (e)", "rel_dlog_1 rel_yoy_log_1 rel_log_level_1 rel_dev_log_mean6")
def ref_p03_relative_features(spark, sf_dir):
    cols = ["dlog_1", "yoy_log_1", "log_level_1", "dev_log_mean6"]
    return panel.relative_features(panel.features(get_dense(spark, sf_dir)).join(get_regions(spark, sf_dir), "e"), "region", cols).select("e", "c", "t", *[f"rel_{x}" for x in cols])


@REG.add(f"WITH {DENSE}, r AS (SELECT a.e, a.c, a.t, a.lf - b.lf AS r FROM lg a JOIN lg b ON a.e = b.e AND a.t = b.t AND b.c = '{TOTAL}' WHERE a.c <> '{TOTAL}') SELECT e, c, t, avg(r) OVER (PARTITION BY c, e ORDER BY t ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS share FROM r", "share")
def ref_p04_structure_features(spark, sf_dir):
    return panel.structure_features(get_dense(spark, sf_dir), TOTAL)


@REG.add(f"WITH {DENSE} SELECT e, c, t, lag(l, 1) OVER w - lag(l, 2) OVER w AS x_dlog, lag(l, 1) OVER w - CASE WHEN count(l) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 THEN avg(l) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS x_dev3 FROM lg WINDOW w AS (PARTITION BY c, e ORDER BY t)", "x_dlog x_dev3")
def ref_p05_cross_features(spark, sf_dir):
    return panel.cross_features(get_dense(spark, sf_dir))


SEASON_SQL = """sm AS (SELECT c, t, median(g) AS g FROM gr WHERE t < {end} GROUP BY ALL), sp AS (SELECT c, CAST(t % 12 AS INT) AS moy, avg(g) AS p FROM sm WHERE g IS NOT NULL GROUP BY ALL),
sg AS (SELECT c, CAST(moy AS INT) AS moy FROM (SELECT DISTINCT c FROM dense), (SELECT unnest(range(0, 12)) AS moy))"""
PROFILE_SQL = f"{SEASON_SQL.format(end=10**6)}, sd AS (SELECT sg.c, sg.moy, coalesce(p - avg(p) OVER (PARTITION BY sg.c), 0) AS ds FROM sg LEFT JOIN sp USING (c, moy)), sc AS (SELECT c, moy, sum(ds) OVER (PARTITION BY c ORDER BY moy) AS s FROM sd), pf AS (SELECT c, moy, s - avg(s) OVER (PARTITION BY c) AS level FROM sc)"
NATIONAL_SQL = """om AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS t, sum(o_totalprice) AS v FROM orders GROUP BY ALL), og AS (SELECT t, ln(v) - ln(lag(v) OVER (ORDER BY t)) AS g FROM om),
os AS (SELECT CAST(t % 12 AS INT) AS moy, median(g) AS p FROM og WHERE g IS NOT NULL GROUP BY ALL), oc AS (SELECT moy, p - avg(p) OVER () AS p FROM os), ok AS (SELECT moy, sum(p) OVER (ORDER BY moy) AS s FROM oc), nat AS (SELECT moy, s - avg(s) OVER () AS level FROM ok)"""


@REG.add(f"WITH {GROWTH}, {PROFILE_SQL} SELECT * FROM pf", "level")
def ref_p09_season_profile(spark, sf_dir):
    return panel.season_profile(get_dense(spark, sf_dir))


@REG.add(
    f"""WITH {GROWTH}, {SEASON_SQL.format(end=2024 * 12)}, {NATIONAL_SQL}, nd AS (SELECT moy, level - coalesce(lag(level) OVER (ORDER BY moy), (SELECT level FROM nat WHERE moy = 11)) AS nat FROM nat),
x AS (SELECT sg.c, sg.moy, p, nat FROM sg LEFT JOIN sp USING (c, moy) JOIN nd USING (moy)), m AS (SELECT *, (sum(p) OVER (PARTITION BY c) + coalesce(sum(CASE WHEN p IS NULL THEN nat END) OVER (PARTITION BY c), 0)) / count(p) OVER (PARTITION BY c) AS mu FROM x),
d AS (SELECT c, moy, 0.5 * coalesce(p - mu, nat) + 0.5 * nat AS ds FROM m), k AS (SELECT c, moy, sum(ds) OVER (PARTITION BY c ORDER BY moy) AS s FROM d) SELECT c, moy, s - avg(s) OVER (PARTITION BY c) AS level FROM k""",
    "level",
)
def ref_p09_blended_profile(spark, sf_dir):
    """One year of training: no growth into January is seen, so the other profile (orders) fills it; all growths are blended half and half."""
    d = get_dense(spark, sf_dir).where(F.col("t") < 2024 * 12)
    names = [F.lit(r["c"]) for r in d.select("c").distinct().collect()]
    return panel.season_profile(d, ref_a09_national_season(spark, sf_dir).withColumn("c", F.explode(F.array(*names).cast("array<string>"))), 0.5)


@REG.add(f"WITH {PANEL} SELECT DISTINCT t, CAST(day(last_day(make_date(t // 12, t % 12 + 1, 1))) AS INT) AS days FROM panel")
def ref_p10_days_in_month(spark, sf_dir):
    return get_panel(spark, sf_dir).select("t").distinct().select("t", F.day(F.last_day(F.make_date(F.floor(F.col("t") / 12).cast("int"), F.col("t") % 12 + 1, F.lit(1)))).alias("days"))


@REG.add(f"{REGION_SQL}, o AS (SELECT region, t + 1 AS t, ln(cpi) AS lagged FROM ri) SELECT d.e, d.t, o.lagged FROM (SELECT DISTINCT e, t FROM dense) d JOIN reg USING (e) LEFT JOIN o ON o.region = reg.region AND o.t = d.t", "lagged")
def ref_p11_macro_lag(spark, sf_dir):
    o = region_index(spark, sf_dir).select("region", (F.col("t") + 1).alias("t"), F.ln("cpi").alias("lagged"))
    return get_dense(spark, sf_dir).select("e", "t").distinct().join(get_regions(spark, sf_dir), "e").join(o, ["region", "t"], "left").select("e", "t", "lagged")


@REG.add(
    f"""WITH {DENSE}, a AS (SELECT e, c, t, y, lf AS l, lag(lf) OVER w AS p, lead(lf) OVER w AS n FROM lg WINDOW w AS (PARTITION BY c, e ORDER BY t)), b AS (SELECT *, (p + n) / 2 AS mid, l - (p + n) / 2 AS dev FROM a),
m AS (SELECT *, abs(dev - median(dev) OVER (PARTITION BY c, t)) AS off FROM b), s AS (SELECT *, median(off) OVER (PARTITION BY c, t) AS mad FROM m)
SELECT e, c, t, y, CASE WHEN off > 5 * 1.4826 * mad AND sign(l - p) <> sign(n - l) THEN exp(mid) ELSE greatest(y, 1.0) END AS clean FROM s""",
    "y clean",
)
def ref_p12_despike(spark, sf_dir):
    return panel.despike(get_dense(spark, sf_dir), 5.0)


SHIFTS_SQL = f"""WITH {DENSE}, r AS (SELECT e, c, t, r FROM (SELECT e, c, t, lf - median(lf) OVER (PARTITION BY c, t) AS r FROM lg) WHERE r IS NOT NULL),
b AS (SELECT min(t) AS a, max(t) AS b FROM dense), k AS (SELECT r.*, s FROM r, b, (SELECT DISTINCT t AS s FROM dense) WHERE s BETWEEN a + 3 AND b + 1 - 3 AND t >= s - 6),
g AS (SELECT e, c, s, median(r) FILTER (WHERE t >= s) - median(r) FILTER (WHERE t < s) AS step, median(r) FILTER (WHERE t >= s AND t < s + 3) - median(r) FILTER (WHERE t < s) AS start, sqrt((var_pop(r) FILTER (WHERE t < s) + var_pop(r) FILTER (WHERE t >= s)) / 2) AS sd FROM k GROUP BY ALL),
h AS (SELECT *, abs(step) / (sd + 0.01) AS score FROM g),
x AS (SELECT h.*, o.start AS old FROM h LEFT JOIN h o ON h.e = o.e AND h.c = o.c AND h.s = o.s + 12 WHERE abs(h.step) >= 0.15 AND h.score >= 4),
shift AS (SELECT e, c, s, step, score FROM (SELECT *, row_number() OVER (PARTITION BY e, c ORDER BY round(score, 9) DESC, s) AS rn FROM x WHERE old IS NULL OR NOT (sign(old) = sign(step) AND abs(old) > abs(step) / 2)) WHERE rn = 1)"""


@REG.add(f"{SHIFTS_SQL} SELECT * FROM shift", "step score")
def ref_p13_level_shifts(spark, sf_dir):
    return panel.level_shifts(get_dense(spark, sf_dir))


@REG.add(f"{SHIFTS_SQL} SELECT d.e, d.c, d.t, d.y, CASE WHEN d.t < s THEN y * exp(step) ELSE y END AS based FROM dense d LEFT JOIN shift x ON d.e = x.e AND d.c = x.c", "y based")
def ref_p14_rebase(spark, sf_dir):
    d = get_dense(spark, sf_dir)
    return panel.rebase(d, panel.level_shifts(d))


@REG.add(f"WITH {GROWTH}, q AS (SELECT c, t, quantile_cont(g, [0.05, 0.95]) AS q FROM gr WHERE g IS NOT NULL GROUP BY ALL) SELECT e, c, t, g, greatest(least(g, q[2]), q[1]) AS g_w FROM gr JOIN q USING (c, t) WHERE g IS NOT NULL", "g g_w")
def ref_p15_winsorise(spark, sf_dir):
    w = panel.series()
    g = get_dense(spark, sf_dir).withColumn("l", F.when(F.col("y") > 0, F.ln("y"))).withColumn("g", F.col("l") - F.lag("l", 1).over(w)).where("g is not null").select("e", "c", "t", "g")
    return panel.winsorise(g, "g", 0.05, "c", "t")


@REG.add(f"WITH {DENSE} SELECT e, c, t, l - lag(l) OVER w AS log_diff, y - lag(y) OVER w AS diff, (lead(l, 2) OVER w - lag(l) OVER w) / 3 AS growth_3, greatest(1.0, lag(y) OVER w * exp(l - lag(l) OVER w)) AS inverse FROM lg WINDOW w AS (PARTITION BY c, e ORDER BY t)", "log_diff diff growth_3 inverse")
def ref_p16_targets(spark, sf_dir):
    w = panel.series()
    d = get_dense(spark, sf_dir).withColumn("l", F.when(F.col("y") > 0, F.ln("y")))
    g = F.col("l") - F.lag("l", 1).over(w)
    return d.select("e", "c", "t", g.alias("log_diff"), (F.col("y") - F.lag("y", 1).over(w)).alias("diff"), ((F.lead("l", 2).over(w) - F.lag("l", 1).over(w)) / 3).alias("growth_3"), F.greatest(F.lit(1.0), F.lag("y", 1).over(w) * F.exp(g)).alias("inverse"))


@REG.add(f"WITH {DENSE} SELECT lg.e, lg.c, avg(l) AS log_mean_level, any_value(s.mo_type) AS mo_type FROM lg JOIN (SELECT DISTINCT * FROM territory_static) s ON s.territory_id = lg.e GROUP BY 1, 2", "log_mean_level")
def ref_p17_static_features(spark, sf_dir):
    s = exact_rows(read_table(spark, sf_dir, "territory_static"), "territory_id", "mo_type").withColumnRenamed("territory_id", "e")
    m = get_dense(spark, sf_dir).groupBy("e", "c").agg(F.avg(F.when(F.col("y") > 0, F.ln("y"))).alias("log_mean_level"))
    return m.join(s, "e").select("e", "c", "log_mean_level", "mo_type")


@REG.add(
    f"""WITH {DENSE}, a AS (SELECT e, c, t, l - median(l) OVER (PARTITION BY c, t) AS r, CAST(t AS DOUBLE) AS x FROM lg)
SELECT e, c, t, CASE WHEN count(r) OVER w = 6 THEN regr_slope(r, x) OVER w END AS trend_6 FROM a WINDOW w AS (PARTITION BY c, e ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
    "trend_6",
)
def ref_w17_trend(spark, sf_dir):
    return panel.trend(get_dense(spark, sf_dir), 6)


#: forecasts of the simple models from origins `o` (origin, steps): the series as lists, month 1 first
SIMPLE_SQL = """ser AS (SELECT e, c, min(t) AS a, list(y ORDER BY t) AS ys FROM dense GROUP BY e, c), so AS (SELECT ser.*, origin, CAST(step AS INT) AS step, least(3, origin - 12) AS m FROM ser, (SELECT origin, unnest(range(1, steps + 1)) AS step FROM o)),
sg AS (SELECT *, ys[origin - 11 + (step - 1) % 12] AS year, ys[origin - m + 1:origin] AS late, ys[origin - m - 11:origin - 12] AS early FROM so),
sh AS (SELECT *, CASE WHEN m < 1 THEN 1.0 WHEN len(list_filter(late, lambda x: x IS NOT NULL)) = m AND len(list_filter(early, lambda x: x IS NOT NULL)) = m THEN list_sum(late) / nullif(list_sum(early), 0) END AS growth FROM sg),
sf AS (SELECT e, c, origin, step, a, unnest([{'model': 'naive', 'y_pred': ys[origin]}, {'model': 'mean_3', 'y_pred': list_avg(ys[origin - 2:origin])}, {'model': 'mean_6', 'y_pred': list_avg(ys[origin - 5:origin])}, {'model': 'mean_12', 'y_pred': list_avg(ys[origin - 11:origin])},
 {'model': 'drift', 'y_pred': ys[origin] + (ys[origin] - ys[1]) / (origin - 1) * step}, {'model': 'seasonal_naive', 'y_pred': year}, {'model': 'seasonal_naive_growth', 'y_pred': year * growth}]) AS f FROM sh),
simple AS (SELECT e, c, CAST(origin AS INT) AS origin, step, CAST(a + origin + step - 1 AS INT) AS t, f.model AS model, f.y_pred AS y_pred FROM sf)"""
ORIGINS = (12, 13, 14, 15, 24)


@REG.add(f"WITH {DENSE}, o AS (SELECT unnest([12, 13, 14, 15, 24]) AS origin, 14 AS steps), {SIMPLE_SQL} SELECT e, c, origin, step, model, y_pred FROM simple", "y_pred")
def ref_m01_simple_models(spark, sf_dir):
    """The simple models after 12, 13, 14, 15 and 24 months, 14 months ahead."""
    d = durable(get_dense(spark, sf_dir), "dense")
    first = d.agg(F.min("t")).first()[0]
    return reduce(DataFrame.unionByName, [panel.simple_forecasts(d, first + o - 1, 14, first).withColumn("origin", F.lit(o)) for o in ORIGINS])


@REG.add(f"WITH {DENSE}, o AS (SELECT unnest([12, 13, 14, 15, 24]) AS origin, 3 AS steps), {SIMPLE_SQL} SELECT e, c, origin, step, y_pred FROM simple WHERE model = 'seasonal_naive_growth'", "y_pred")
def ref_m05_growth(spark, sf_dir):
    return ref_m01_simple_models(spark, sf_dir).where("model = 'seasonal_naive_growth' and step <= 3").drop("model")


@REG.add(
    f"""WITH {PANEL}, m AS (SELECT DISTINCT t, unnest([-1, 0, 1]) AS k FROM panel), d AS (SELECT t, k, make_date(CAST((t + k) // 12 AS INT), CAST((t + k) % 12 + 1 AS INT), 1) AS a, last_day(make_date(CAST((t + k) // 12 AS INT), CAST((t + k) % 12 + 1 AS INT), 1)) AS b FROM m),
f AS (SELECT * FROM (VALUES {", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in panel.FASTING.values())}) AS f(fa, fb)),
s AS (SELECT t, k, sum(greatest(0, date_diff('day', greatest(a, fa), least(b, fb)) + 1)) / day(any_value(b)) AS share FROM d, f GROUP BY t, k),
w AS (SELECT DISTINCT territory_id AS e, CASE region {" ".join(f"WHEN '{r}' THEN {v}" for r, v in panel.MUSLIM_SHARE.items())} ELSE 0.0 END AS w FROM territory_static)
SELECT e, t, max(share) FILTER (WHERE k = 0) * w AS ramadan_t, max(share) FILTER (WHERE k = -1) * w AS ramadan_prev, max(share) FILTER (WHERE k = 1) * w AS ramadan_next FROM w, s GROUP BY e, t, w""",
    "ramadan_t ramadan_prev ramadan_next",
)
def ref_f01_fasting_features(spark, sf_dir):
    months = [r["t"] for r in get_panel(spark, sf_dir).select("t").distinct().collect()]
    return panel.fasting_features(get_regions(spark, sf_dir), months)


QUERIES, ORACLE = REG.queries, REG.oracle
