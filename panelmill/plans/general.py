"""Queries of problems 4, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions import month_number, month_text
from panelmill.operators.asof import known_asof, with_release
from panelmill.operators.control import Chart, implausible, latest_valid
from panelmill.operators.impute import UNKNOWN_MARKS, impute_chained, masked_errors
from panelmill.sources.tables import exact_rows, read_table

# Usable ranges of the numeric fields.
NUMBERS = {"lat": (40.0, 75.0), "lon": (19.0, 180.0), "log_pop": (5.0, 16.0), "pop_growth": (-0.5, 0.5), "market_access": (0.0, 1000.0)}
TEXTS = ["mo_type", "is_capital", "is_zato", "shape"]
TOTAL = "Все категории"


def _territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = exact_rows(read_table(spark, sf_dir, "territory_static")).withColumn("_static", F.lit(True))
    access = exact_rows(read_table(spark, sf_dir, "market_access"), "territory_id", "market_access").withColumn("_access", F.lit(True))
    return static.join(access, "territory_id", "full")


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute_chained(_territories(spark, sf_dir), NUMBERS, TEXTS, "region", "territory_id")


def p4_masked_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known cells hidden and filled again: error of the drawn and of the fitted values against the mean of the region."""
    return masked_errors(_territories(spark, sf_dir), NUMBERS, TEXTS, "region", "territory_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _filled(spark, sf_dir)
    names = [c for c in [*TEXTS, *NUMBERS] if c != "market_access"]
    marks = F.array(
        *[F.struct(F.lit("territory_static").alias("src_table"), F.lit(c).alias("field"), (F.col(f"{c}_filled") & F.col("_static").isNotNull()).alias("m")) for c in names],
        F.struct(F.lit("market_access").alias("src_table"), F.lit("market_access").alias("field"), F.col("market_access_filled").alias("m")),
    )
    return done.select("territory_id", F.explode(marks).alias("x")).where("x.m").select("x.src_table", "territory_id", "x.field").distinct()


def p4_territory_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [c for c in [*TEXTS, *NUMBERS] if c != "market_access"]
    return _filled(spark, sf_dir).where("_static").select("territory_id", "region", *[x for c in names for x in (c, f"{c}_filled")]).distinct()


def p4_market_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).select("territory_id", "market_access", "market_access_filled").distinct()


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of p5_found with the reason for which each is marked."""
    key = ["territory_id", "category", "date"]
    panel = latest_valid(read_table(spark, sf_dir, "consumption").select(*key, "value", "loaded_at"), key, "value", "loaded_at").withColumn("t", month_number(F.col("date")))
    inf = float("inf")
    a = implausible(panel, ["territory_id", "category"], "t", "value", True, (F.col("value") <= 0) | (F.col("value") == inf), "category")
    z = read_table(spark, sf_dir, "top_shocks_news").select("territory_id", "month", F.col(f"`z: {TOTAL}`").alias("value"), "detected_at")
    z = latest_valid(z, ["territory_id", "month"], "value", "detected_at").withColumn("t", month_number(F.col("month"))).withColumn("category", F.lit(TOTAL))
    b = implausible(z, ["territory_id", "category"], "t", "value", False, F.abs("value") == inf, None, Chart(limit=9.0, prior=6.0))
    both = a.withColumn("src_table", F.lit("consumption")).unionByName(b.withColumn("src_table", F.lit("top_shocks_news")))
    return both.select("src_table", "territory_id", "category", month_text(F.col("t")).alias("month"), "reason")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_reasons(spark, sf_dir).drop("reason")


def p5_impossible_and_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p5_reasons that SQL can state: impossible readings and stuck runs."""
    return p5_reasons(spark, sf_dir).where("reason <> 'spike'")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shocks = read_table(spark, sf_dir, "top_shocks_news").select("shock_id", "territory_id", month_number(F.col("month")).alias("_at")).distinct()
    rows = read_table(spark, sf_dir, "rosstat_quarterly").where("yoy_log is not null and not isnan(yoy_log)")
    rows = with_release(rows, read_table(spark, sf_dir, "rosstat_lag"))
    found = known_asof(shocks, rows, "territory_id", "_at", "_known", "indicator", ["year", "quarter", "revision"], ["quarterly_id", "yoy_log"])
    return found.select("shock_id", "indicator", "quarterly_id")


QUERIES = {"p4_found": p4_found, "p4_territory_static": p4_territory_static, "p4_market_access": p4_market_access, "p4_masked_error": p4_masked_error, "p5_found": p5_found, "p5_reasons": p5_reasons, "p5_impossible_and_stuck": p5_impossible_and_stuck, "p6_found": p6_found}

_MARKS = ", ".join(f"'{m}'" for m in UNKNOWN_MARKS)


def _sql_gap(c: str) -> str:
    if c in NUMBERS:
        low, high = NUMBERS[c]
        return f"({c} IS NULL OR isnan({c}) OR {c} < {low} OR {c} > {high})"
    return f"({c} IS NULL OR lower(trim({c})) IN ({_MARKS}))"


ORACLE = {
    "p4_found": " UNION ".join(
        [f"SELECT 'territory_static' AS src_table, territory_id, '{c}' AS field FROM territory_static WHERE {_sql_gap(c)}" for c in [*TEXTS, *NUMBERS] if c != "market_access"]
        + [f"SELECT 'market_access' AS src_table, territory_id, 'market_access' AS field FROM (SELECT territory_id, market_access FROM territory_static FULL JOIN market_access USING (territory_id)) WHERE {_sql_gap('market_access')}"]
    ),
    "p5_impossible_and_stuck": f"""
WITH c AS (SELECT 'consumption' AS src_table, territory_id, category, date AS month, value AS v FROM (SELECT *, row_number() OVER (PARTITION BY territory_id, category, date ORDER BY loaded_at DESC NULLS LAST, value DESC) AS rn FROM consumption) WHERE rn = 1),
z AS (SELECT 'top_shocks_news' AS src_table, territory_id, '{TOTAL}' AS category, month, "z: {TOTAL}" AS v FROM (SELECT *, row_number() OVER (PARTITION BY territory_id, month ORDER BY detected_at DESC NULLS LAST, "z: {TOTAL}" DESC) AS rn FROM top_shocks_news) WHERE rn = 1),
a AS (SELECT *, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS t FROM (FROM c UNION ALL FROM z) WHERE v IS NOT NULL AND NOT isnan(v)),
g AS (SELECT *, t - row_number() OVER (PARTITION BY src_table, territory_id, category, v ORDER BY t) AS run FROM a),
n AS (SELECT *, count(*) OVER (PARTITION BY src_table, territory_id, category, v, run) AS n FROM g)
SELECT src_table, territory_id, category, month, CASE WHEN isinf(v) OR src_table = 'consumption' AND v <= 0 THEN 'impossible' ELSE 'stuck' END AS reason FROM n WHERE isinf(v) OR src_table = 'consumption' AND v <= 0 OR n >= 4""",
    "p6_found": """
WITH m AS (
  SELECT q.*, year * 12 + quarter * 3 - 1 AS qend, l.lag_months,
    CASE WHEN regexp_full_match(trim(release_month), '[0-9]{4}-[0-9]{2}') THEN CAST(substr(trim(release_month), 1, 4) AS INT) * 12 + CAST(substr(trim(release_month), 6, 2) AS INT) - 1
         WHEN regexp_full_match(trim(release_month), '[0-9]{2}[.][0-9]{4}') THEN CAST(substr(trim(release_month), 4, 4) AS INT) * 12 + CAST(substr(trim(release_month), 1, 2) AS INT) - 1 END AS said
  FROM (SELECT DISTINCT * FROM rosstat_quarterly WHERE yoy_log IS NOT NULL AND NOT isnan(yoy_log)) q
  LEFT JOIN rosstat_lag l ON q.indicator = l.indicator AND q.year >= l.year_from AND q.year < l.year_to),
k AS (SELECT *, CASE WHEN said >= qend THEN said ELSE qend + lag_months END AS known FROM m),
s AS (SELECT DISTINCT shock_id, territory_id, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS at FROM top_shocks_news)
SELECT shock_id, indicator, quarterly_id FROM (
  SELECT shock_id, k.indicator, quarterly_id, row_number() OVER (PARTITION BY shock_id, k.indicator ORDER BY year DESC, quarter DESC, revision DESC, quarterly_id DESC) AS rn
  FROM s JOIN k ON s.territory_id = k.territory_id AND k.known <= s.at) WHERE rn = 1""",
}
