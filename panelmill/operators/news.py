"""News text: themes, mentions of places, monthly counts and spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import plain_text

#: Word stems of the themes; boundaries are written out so that both regex dialects agree.
THEMES = {
    "emerg": "(^|[^а-я])(пожар|паводк|наводнен|эвакуац|взрыв|ураган|подтопл)",
    "outage": "(^|[^а-я])(авари|отключ|обрыв|перекрыва|закрыва)",
}


def tag_themes(docs: DataFrame) -> DataFrame:
    """(doc_id, territory_id, t, <theme>...): whether the title and text touch each theme."""
    text = plain_text(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    t = F.year("pub_date") * 12 + F.month("pub_date") - 1
    return docs.select("doc_id", "territory_id", t.alias("t"), text.alias("_x")).select("doc_id", "territory_id", "t", *[F.col("_x").rlike(p).alias(k) for k, p in THEMES.items()])


def monthly_counts(tags: DataFrame, themes: list[str]) -> DataFrame:
    """(territory_id, t, n_<theme>...) on the dense grid of mentioned places and months, per 100,000 texts of the month."""
    dated = tags.where("t is not null")
    total = dated.groupBy("t").agg(F.count(F.lit(1)).alias("_total"))
    own = dated.where("territory_id is not null").groupBy("territory_id", "t").agg(*[F.sum(F.col(k).cast("int")).alias(k) for k in themes])
    span = dated.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if span["a"] is None:
        return own.select("territory_id", "t", *[F.lit(0.0).alias(f"n_{k}") for k in themes])
    grid = own.select("territory_id").distinct().select("territory_id", F.explode(F.sequence(F.lit(span["a"]), F.lit(span["b"]))).alias("t"))
    full = grid.join(own, ["territory_id", "t"], "left").join(total, "t", "left")
    return full.select("territory_id", "t", *[(F.coalesce(k, F.lit(0)) * 100_000.0 / F.coalesce("_total", F.lit(1))).alias(f"n_{k}") for k in themes])


def spikes(counts: DataFrame, n: str, out: str) -> DataFrame:
    """Adds out: ln((1 + n) / (1 + median of all earlier months)); null in the first month."""
    w = Window.partitionBy("territory_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.ln((1 + F.col(n)) / (1 + F.percentile(n, 0.5).over(w))))


def leave_one_out(counts: DataFrame, n: str) -> DataFrame:
    """Adds others: median of the other months of the same place (an array bounded by the calendar)."""
    w = Window.partitionBy("territory_id")
    x = counts.withColumn("_all", F.collect_list(F.struct("t", F.col(n).alias("n"))).over(w))
    rest = F.sort_array(F.transform(F.filter("_all", lambda s: s["t"] != F.col("t")), lambda s: s["n"]))
    x = x.withColumn("_r", rest)
    k = F.size("_r")
    mid = (F.try_element_at("_r", F.floor((k + 1) / 2).cast("int")) + F.try_element_at("_r", F.floor((k + 2) / 2).cast("int"))) / 2
    return x.withColumn("others", F.when(k > 0, mid)).drop("_all", "_r")


def gazetteer(places: DataFrame) -> DataFrame:
    """(territory_id, name): names of at least four letters that lie in one region only; of several in it the most populous counts."""
    p = places.where(F.length("name") >= 4)
    w = Window.partitionBy("name")
    one = F.min("region").over(w) == F.max("region").over(w)
    rn = F.row_number().over(w.orderBy(F.desc_nulls_last("pop"), "territory_id"))
    return p.withColumn("_one", one).withColumn("_rn", rn).where("_one and _rn = 1").select("territory_id", "name")


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, territory_id): documents whose text has a place's name with any ending, for one-word names.

    Texts are cut into words and joined on the stem (name without its last two letters), so
    no text is matched against every place; the full pattern is not checked on the matches.
    """
    stems = names.select("territory_id", plain_text(F.col("name")).alias("_n")).where(~F.col("_n").contains(" ")).withColumn("_stem", F.expr("left(_n, length(_n) - 2)"))
    tokens = docs.where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(plain_text(F.col("text")), F.lit("([а-я]+)"), F.lit(1)))).alias("_w"))
    cut = F.array(*[F.expr(f"left(_w, length(_w) - {k})") for k in range(0, 5)])
    parts = tokens.where("length(_w) >= 4").select("doc_id", F.explode(cut).alias("_stem")).where("length(_stem) >= 2")
    return parts.join(stems, "_stem").select("doc_id", "territory_id").distinct()
