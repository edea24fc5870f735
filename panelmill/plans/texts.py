"""Queries of the news operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.operators import news
from panelmill.functions import month_number
from panelmill.plans.registry import Registry
from panelmill.sources.tables import durable, read_table

REG = Registry()
TEXT_SQL = "replace(lower(concat(coalesce(title, ''), ' ', coalesce(text, ''))), 'ё', 'е')"
TAGS_SQL = "tg AS (SELECT doc_id, territory_id, year(pub_date) * 12 + month(pub_date) - 1 AS t, " + ", ".join(f"regexp_matches({TEXT_SQL}, '{p}') AS {k}" for k, p in news.THEMES.items()) + " FROM documents)"
COUNTS_SQL = f"""{TAGS_SQL}, d AS (SELECT * FROM tg WHERE t IS NOT NULL), tot AS (SELECT t, count(*) AS n FROM d GROUP BY t), own AS (SELECT territory_id, t, sum(CAST(emerg AS INT)) AS emerg, sum(CAST(outage AS INT)) AS outage FROM d WHERE territory_id IS NOT NULL GROUP BY ALL),
b AS (SELECT min(t) AS a, max(t) AS z FROM d), g AS (SELECT territory_id, t FROM (SELECT DISTINCT territory_id FROM own), (SELECT CAST(unnest(range((SELECT a FROM b), (SELECT z + 1 FROM b))) AS INT) AS t)),
cn AS (SELECT g.territory_id, g.t, coalesce(emerg, 0) * 100000.0 / coalesce(tot.n, 1) AS n_emerg, coalesce(outage, 0) * 100000.0 / coalesce(tot.n, 1) AS n_outage FROM g LEFT JOIN own USING (territory_id, t) LEFT JOIN tot ON tot.t = g.t)"""


def get_tags(spark, sf_dir):
    return news.tag_themes(read_table(spark, sf_dir, "documents"))


def get_counts(spark, sf_dir):
    return news.monthly_counts(durable(get_tags(spark, sf_dir), "tags"), list(news.THEMES))


@REG.add(f"WITH {TAGS_SQL} SELECT doc_id, territory_id, CAST(t AS INT) AS t, emerg, outage FROM tg")
def ref_p45_theme_tags(spark, sf_dir):
    return get_tags(spark, sf_dir)


@REG.add(f"WITH {COUNTS_SQL} SELECT * FROM cn", "n_emerg n_outage")
def ref_a07_monthly_counts(spark, sf_dir):
    return get_counts(spark, sf_dir)


@REG.add(f"WITH {COUNTS_SQL} SELECT territory_id, t, n_emerg, ln((1 + n_emerg) / (1 + quantile_cont(n_emerg, 0.5) OVER (PARTITION BY territory_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS spike FROM cn", "n_emerg spike")
def ref_w06_spikes(spark, sf_dir):
    return news.spikes(get_counts(spark, sf_dir).select("territory_id", "t", "n_emerg"), "n_emerg", "spike")


@REG.add(f"WITH {COUNTS_SQL} SELECT a.territory_id, a.t, any_value(a.n_outage) AS n_outage, median(b.n_outage) AS others FROM cn a LEFT JOIN cn b ON a.territory_id = b.territory_id AND a.t <> b.t GROUP BY 1, 2", "n_outage others")
def ref_w18_leave_one_out(spark, sf_dir):
    return news.leave_one_out(get_counts(spark, sf_dir).select("territory_id", "t", "n_outage"), "n_outage")


@REG.add(f"WITH {COUNTS_SQL}, sp AS (SELECT territory_id, t, ln((1 + n_emerg) / (1 + quantile_cont(n_emerg, 0.5) OVER (PARTITION BY territory_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) AS s FROM cn), u AS (SELECT DISTINCT territory_id, CAST(substr(month, 1, 4) AS INT) * 12 + CAST(substr(month, 6, 2) AS INT) - 1 AS t FROM top_shocks_news) SELECT u.territory_id, u.t, k AS lag, CASE WHEN c.territory_id IS NULL THEN NULL WHEN u.t - k < (SELECT a FROM b) THEN NULL WHEN u.t - k > (SELECT z FROM b) THEN 0.0 ELSE sp.s END AS spike FROM u CROSS JOIN (SELECT unnest([1, 2]) AS k) LEFT JOIN (SELECT DISTINCT territory_id FROM cn) c ON c.territory_id = u.territory_id LEFT JOIN sp ON sp.territory_id = u.territory_id AND sp.t = u.t - k", "spike")
def ref_j12_news_lags(spark, sf_dir):
    sp = durable(news.spikes(get_counts(spark, sf_dir).select("territory_id", "t", "n_emerg"), "n_emerg", "s"), "spikes")
    ends = sp.agg(F.min("t").alias("a"), F.max("t").alias("z")).first()
    covered = sp.select("territory_id").distinct().withColumn("cov", F.lit(True))
    u = read_table(spark, sf_dir, "top_shocks_news").select("territory_id", month_number(F.col("month")).alias("t")).distinct().withColumn("lag", F.explode(F.array(F.lit(1), F.lit(2))))
    u = u.withColumn("at", F.col("t") - F.col("lag")).join(covered, "territory_id", "left").join(sp.select("territory_id", F.col("t").alias("at"), "s"), ["territory_id", "at"], "left")
    value = F.when(F.col("cov").isNull() | (F.col("at") < F.lit(ends["a"])), None).when(F.col("at") > F.lit(ends["z"]), 0.0).otherwise(F.col("s"))
    return u.select("territory_id", "t", "lag", value.alias("spike"))


PLACES_SQL = "pl AS (SELECT DISTINCT territory_id, regexp_extract(\"МО\", '^([А-ЯЁ][а-яё]+)', 1) AS name, \"регион\" AS region FROM top_shocks_news), pp AS (SELECT pl.*, p.pop FROM pl LEFT JOIN (SELECT territory_id, max(CASE WHEN log_pop BETWEEN 5 AND 16 THEN log_pop END) AS pop FROM territory_static GROUP BY 1) p USING (territory_id)), gz AS (SELECT territory_id, name FROM (SELECT *, min(region) OVER (PARTITION BY name) = max(region) OVER (PARTITION BY name) AS one, row_number() OVER (PARTITION BY name ORDER BY pop DESC NULLS LAST, territory_id) AS rn FROM pp WHERE length(name) >= 4) WHERE one AND rn = 1)"


def get_gazetteer(spark, sf_dir):
    s = read_table(spark, sf_dir, "top_shocks_news").select("territory_id", F.regexp_extract("МО", "^([А-ЯЁ][а-яё]+)", 1).alias("name"), F.col("регион").alias("region")).distinct()
    pop = read_table(spark, sf_dir, "territory_static").groupBy("territory_id").agg(F.max(F.when(F.col("log_pop").between(5, 16), F.col("log_pop"))).alias("pop"))
    return news.gazetteer(s.join(pop, "territory_id", "left"))


@REG.add(f"WITH {PLACES_SQL} SELECT * FROM gz")
def ref_p44_gazetteer(spark, sf_dir):
    return get_gazetteer(spark, sf_dir)


@REG.add(
    f"""WITH {PLACES_SQL}, n AS (SELECT territory_id, replace(lower(name), 'ё', 'е') AS n FROM gz), st AS (SELECT territory_id, left(n, length(n) - 2) AS stem FROM n),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[а-я]+')) AS w FROM documents WHERE text IS NOT NULL), k AS (SELECT DISTINCT doc_id, left(w, CAST(length(w) - k AS INT)) AS stem FROM w, (SELECT unnest(range(0, 5)) AS k) WHERE length(w) >= 4 AND length(w) - k >= 2)
SELECT DISTINCT doc_id, territory_id FROM k JOIN st USING (stem)""",
)
def ref_j17_place_mentions(spark, sf_dir):
    return news.mentions(read_table(spark, sf_dir, "documents"), get_gazetteer(spark, sf_dir))


EVENTS = {"flood": "паводк|подтопл|наводнен", "fire": "пожар|задымл|горящ", "crash": "авари|обрыв|взрыв", "storm": "ураган|ливн"}  # fixed values: word stems of event types
EVENT_SQL = "ev AS (SELECT DISTINCT shock_id, " + ", ".join(f"CAST(len(regexp_extract_all(replace(lower(coalesce(\"заголовки\", '')), 'ё', 'е'), '{p}')) AS INT) AS {k}" for k, p in EVENTS.items()) + " FROM top_shocks_news)"


@REG.add(f"WITH {EVENT_SQL} SELECT shock_id, CASE WHEN greatest({', '.join(EVENTS)}) < 1 THEN NULL " + " ".join(f"WHEN {k} = greatest({', '.join(EVENTS)}) THEN '{k}'" for k in EVENTS) + " END AS event FROM ev")
def ref_p46_event_type(spark, sf_dir):
    s = read_table(spark, sf_dir, "top_shocks_news").select("shock_id", news.plain_text(F.coalesce("заголовки", F.lit(""))).alias("x")).distinct()
    n = {k: F.size(F.regexp_extract_all("x", F.lit(f"({p})"), F.lit(1))) for k, p in EVENTS.items()}
    top = F.greatest(*n.values())
    kind = F.when(top < 1, None)
    for k, v in n.items():
        kind = kind.when(v == top, k)
    return s.select("shock_id", kind.alias("event"))


QUERIES, ORACLE = REG.queries, REG.oracle
