"""External attributes: versions, fallbacks, year-on-year growth, forward fill, rolling sums, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_version(facts: DataFrame, versions: DataFrame, code: str, year: str, last: int, stable: str | None = None) -> DataFrame:
    """Adds territory_id: the version of `code` valid in least(year, last), [year_from, year_to).

    With `stable`, a fact without a version takes the territory that its stable code
    names, if that code belongs to exactly one territory over all versions.
    """
    y = F.least(F.col(year), F.lit(last))
    v = versions.select(F.col(code).alias("_c"), "territory_id", "year_from", "year_to")
    out = facts.join(v, (F.col(code) == F.col("_c")) & (F.col("year_from") <= y) & (F.col("year_to") > y), "left").drop("_c", "year_from", "year_to")
    if stable:
        single = versions.groupBy(F.col(stable).alias("_s")).agg(F.countDistinct("territory_id").alias("_n"), F.min("territory_id").alias("_t")).where("_n = 1").drop("_n")
        out = out.join(single, F.col(stable) == F.col("_s"), "left").withColumn("territory_id", F.coalesce("territory_id", "_t")).drop("_s", "_t")
    return out


def year_on_year(rows: DataFrame, key: Sequence[str], value: str, how: str = "left") -> DataFrame:
    """Adds yoy: ln of the value over that of the same key a year before; null if either is not positive."""
    old = rows.select(*key, (F.col("year") + 1).alias("year"), F.col(value).alias("_old"))
    ok = (F.col(value) > 0) & (F.col("_old") > 0)
    return rows.join(old, [*key, "year"], how).withColumn("yoy", F.when(ok, F.ln(F.col(value) / F.col("_old")))).drop("_old")


def cumulative_to_flow(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Adds flow: a value that is cumulative within the year as the part of its own quarter."""
    w = Window.partitionBy(*key, "year").orderBy("quarter")
    return rows.withColumn("flow", F.col(value) - F.coalesce(F.lag(value, 1).over(w), F.lit(0.0)))


def forward_filled(rows: DataFrame, value: str) -> DataFrame:
    """(indicator, entity, q, value): the mean of repeated cells on the grid of each entity and observed quarter ordinal q, filled forward."""
    cells = rows.groupBy("indicator", "e", "q").agg(F.avg(value).alias("v"))
    quarters = cells.groupBy("indicator").agg(F.sort_array(F.collect_set("q")).alias("_qs"))
    grid = cells.select("indicator", "e").distinct().join(quarters, "indicator").select("indicator", "e", F.explode("_qs").alias("q"))
    w = Window.partitionBy("indicator", "e").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(cells, ["indicator", "e", "q"], "left").select("indicator", "e", "q", F.last("v", ignorenulls=True).over(w).alias("value"))


def rolling_log_sum(monthly: DataFrame, key: Sequence[str], value: str, n: int) -> DataFrame:
    """Adds roll: sum of ln(value) over n months, null unless all n are there."""
    w = Window.partitionBy(*key).orderBy("t").rowsBetween(1 - n, 0)
    return monthly.withColumn("roll", F.when(F.count(value).over(w) == n, F.sum(F.ln(value)).over(w)))


def rolling_ratio(monthly: DataFrame, key: Sequence[str], value: str, n: int) -> DataFrame:
    """Adds ratio<n>: ln of the n-month mean over the same mean twelve months before; both need all n months."""
    w = Window.partitionBy(*key).orderBy("t")
    full = F.when(F.count(value).over(w.rowsBetween(1 - n, 0)) == n, F.avg(value).over(w.rowsBetween(1 - n, 0)))
    x = monthly.withColumn("_m", full)
    return x.withColumn(f"ratio{n}", F.ln(F.col("_m") / F.lag("_m", 12).over(w))).drop("_m")


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """(e, rank, nbr, distance): the k nearest neighbours, edges taken in both directions; ties by id."""
    ok = edges.where("x <> y and x is not null and y is not null")
    both = ok.select(F.col("x").alias("e"), F.col("y").alias("nbr"), "distance").unionByName(ok.select(F.col("y").alias("e"), F.col("x").alias("nbr"), "distance"))
    rn = F.row_number().over(Window.partitionBy("e").orderBy("distance", "nbr"))
    return both.withColumn("rank", rn).where(F.col("rank") <= k).select("e", "rank", "nbr", "distance")


def latest_row(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the row of each key that is last by `order`."""
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *[F.col(v).alias(f"_{v}") for v in values])).alias("_r")).select(*key, *[F.col(f"_r._{v}").alias(v) for v in values])
