"""Queries of the problems for training data, and their SQL where it can be given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import leakage, mixing, neardup, percentiles, ranking, subjects
from panelmill.sources.tables import durable, read_table, row_digest

PROBS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
HEADLINES = "заголовки"


REL_ERROR = 0.005


def _forecast_values(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Fields of problem 1, exact copies of a row once: grouped by the fields themselves and a digest of the whole row."""
    df = read_table(spark, sf_dir, "forecasts")
    return df.select(*keep, "y_true", "y_pred", row_digest(df)[0]).distinct().drop("_d1")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mergeable summaries per run_date, in parts, written to the shared folder."""
    df = read_table(spark, sf_dir, "forecasts")
    return durable(percentiles.distinct_summaries(df, row_digest(df)[0], ["run_date", "category", "step"], ["y_true", "y_pred"], REL_ERROR), "days")


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles(_daily(spark, sf_dir), ["category", "step"], PROBS).withColumn("value", F.round("value", 6))


def p1_daily_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.combine(_daily(spark, sf_dir), ["run_date", "category", "step"]).withColumn("value", F.round("value", 6))


def p1_percentiles_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = percentiles.summaries(_forecast_values(spark, sf_dir, "category", "step"), ["category", "step"], ["y_true", "y_pred"], 0.0)
    return percentiles.percentiles(cells, ["category", "step"], PROBS, per_octave=512)


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_walk(read_table(spark, sf_dir, "top_shocks_news"), "shock_id", ["topk", "mahal", "iforest", "combo"])


def _headlines(spark: SparkSession, sf_dir: str):
    df = read_table(spark, sf_dir, "top_shocks_news").select("shock_id", HEADLINES)
    members, classes = neardup.word_classes(df, "shock_id", neardup.words(F.col(HEADLINES)))
    return members, neardup.signed_classes(classes, bands=90, rows=6)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, signed = _headlines(spark, sf_dir)
    return neardup.near_pairs(members, neardup.similar_classes(signed, 0.6)).select(F.col("a").alias("shock_a"), F.col("b").alias("shock_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, signed = _headlines(spark, sf_dir)
    return neardup.near_groups(members, neardup.linking_pairs(signed, 0.6)).withColumnRenamed("item", "shock_id")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, signed = _headlines(spark, sf_dir)
    return neardup.link_counts(members, neardup.similar_classes(signed, 0.6)).withColumnRenamed("item", "shock_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).where("kind = 'passage'").select("doc_id", "item_id")


def _mixed(spark: SparkSession, sf_dir: str):
    docs = read_table(spark, sf_dir, "documents")
    docs = durable(docs.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens")), "tokens")
    targets = read_table(spark, sf_dir, "source_targets")
    return mixing.mix(docs, targets), docs, targets


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached(*_mixed(spark, sf_dir))


def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.classify(*[read_table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_subjects(spark, sf_dir).select("doc_id", "subject")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p9_subjects(spark, sf_dir)
    per = found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("sentences") / F.col("about")).alias("weight"))
    return per.select("subject", "documents", "weight")


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_daily_summaries": p1_daily_summaries,
    "p1_percentiles_exact": p1_percentiles_exact,
    "p2_ranking": p2_ranking,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p3_links": p3_links,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_subjects": p9_subjects,
    "p9_shares": p9_shares,
}


def _percentile_sql(rel_error: float) -> str:
    value = "x"
    if rel_error:
        g = repr((1 + rel_error) / (1 - rel_error))
        value = f"CASE WHEN x = 0 THEN 0.0 ELSE sign(x) * pow({g}, ceil(ln(abs(x)) / ln({g}))) * (2 / ({g} + 1)) END"
    probs = ", ".join(str(round(p * 10_000)) for p in PROBS)
    return f"""
WITH r AS (SELECT DISTINCT * FROM forecasts),
l AS (SELECT category, step, 'y_true' AS measure, y_true AS x FROM r UNION ALL SELECT category, step, 'y_pred', y_pred FROM r),
c AS (SELECT category, step, measure, count(*) FILTER (WHERE isfinite(x)) AS n, count(*) FILTER (WHERE x IS NULL) AS n_null, count(*) FILTER (WHERE isnan(x)) AS n_nan, count(*) FILTER (WHERE isinf(x)) AS n_inf FROM l GROUP BY ALL),
o AS (SELECT category, step, measure, {value} AS value, row_number() OVER (PARTITION BY category, step, measure ORDER BY x) AS rn FROM l WHERE isfinite(x)),
q AS (SELECT c.*, k FROM c, (SELECT unnest([{probs}]) AS k))
SELECT q.category, q.step, q.measure, q.k / 10000 AS p, o.value, q.n, q.n_null, q.n_nan, q.n_inf
FROM q LEFT JOIN o ON o.category = q.category AND o.step = q.step AND o.measure = q.measure AND o.rn = greatest((q.k * q.n + 9999) // 10000, 1)"""


def _daily_sql() -> str:
    g = repr((1 + REL_ERROR) / (1 - REL_ERROR))
    return f"""
WITH r AS (SELECT DISTINCT * FROM forecasts),
l AS (SELECT run_date, category, step, 'y_true' AS measure, y_true AS x FROM r UNION ALL SELECT run_date, category, step, 'y_pred', y_pred FROM r)
SELECT run_date, category, step, measure, CASE WHEN x IS NULL THEN 'null' WHEN isnan(x) THEN 'nan' WHEN isinf(x) THEN 'inf' ELSE 'value' END AS kind,
 round(CASE WHEN x IS NULL OR NOT isfinite(x) THEN NULL WHEN x = 0 THEN 0.0 ELSE sign(x) * pow({g}, ceil(ln(abs(x)) / ln({g}))) * (2 / ({g} + 1)) END, 6) AS value, count(*) AS n FROM l GROUP BY ALL"""


ORACLE = {
    "p1_percentiles": f"SELECT * REPLACE (round(value, 6) AS value) FROM ({_percentile_sql(REL_ERROR)}) AS result",
    "p1_daily_summaries": _daily_sql(),
    "p1_percentiles_exact": _percentile_sql(0.0),
    "p3_groups": f"""
WITH RECURSIVE h AS (SELECT DISTINCT shock_id, list_sort(list_distinct(regexp_extract_all(lower("{HEADLINES}"), '[\\p{{L}}\\p{{N}}]+'))) AS w FROM top_shocks_news WHERE "{HEADLINES}" IS NOT NULL AND "{HEADLINES}" <> ''),
m AS (SELECT shock_id, w, min(shock_id) OVER (PARTITION BY w) AS class_id FROM h WHERE len(w) > 0), k AS (SELECT shock_id AS id, w FROM m WHERE shock_id = class_id),
t AS (SELECT id, len(w) AS n, unnest(w) AS x FROM k), s AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM s WHERE c >= 0.6 * (na + nb - c)), e AS (FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT id AS node, id AS root FROM k UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node)
SELECT m.shock_id, m.class_id, g.group_id FROM m JOIN (SELECT node, min(root) AS group_id FROM reach GROUP BY node) g ON g.node = m.class_id""",
    "p3_links": f"""
WITH h AS (SELECT DISTINCT shock_id, list_sort(list_distinct(regexp_extract_all(lower("{HEADLINES}"), '[\\p{{L}}\\p{{N}}]+'))) AS w FROM top_shocks_news WHERE "{HEADLINES}" IS NOT NULL AND "{HEADLINES}" <> ''),
m AS (SELECT shock_id, w, min(shock_id) OVER (PARTITION BY w) AS class_id FROM h WHERE len(w) > 0), k AS (SELECT shock_id AS id, w FROM m WHERE shock_id = class_id),
t AS (SELECT id, len(w) AS n, unnest(w) AS x FROM k), s AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM s WHERE c >= 0.6 * (na + nb - c)), e AS (FROM l UNION ALL SELECT b, a FROM l)
SELECT m.shock_id, m.class_id, coalesce(n, 0) AS n_links FROM m LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) c ON c.a = m.class_id""",
    "p3_found": f"""
WITH h AS (SELECT DISTINCT shock_id, list_distinct(regexp_extract_all(lower("{HEADLINES}"), '[\\p{{L}}\\p{{N}}]+')) AS w FROM top_shocks_news WHERE "{HEADLINES}" IS NOT NULL AND "{HEADLINES}" <> ''),
t AS (SELECT shock_id, len(w) AS n, unnest(w) AS x FROM h),
s AS (SELECT a.shock_id AS shock_a, b.shock_id AS shock_b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.shock_id < b.shock_id GROUP BY ALL)
SELECT shock_a, shock_b FROM s WHERE c >= 0.6 * (na + nb - c)""",
}
