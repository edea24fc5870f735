"""Attributes as known at event time: a sharded as-of merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.functions import month_number


def known_asof(
    events: DataFrame,
    versions: DataFrame,
    entity: str,
    event_time: str,
    known_from: str,
    attribute: str,
    order: list[str],
    payload: list[str],
    shard_months: int = 6,
) -> DataFrame:
    """For each event and attribute, the version with the greatest `order` among those known by then.

    Times are integers (month ordinals). A version is known at time M if `known_from` <= M.
    Among the known ones the greatest tuple (order..., payload...) wins, which is not
    always the one that became known last. Returns the columns of `events`, `attribute`,
    and `payload`; an event with nothing known gives no row; events with a null entity or
    time and versions with a null entity, attribute or time give none.

    How it scales: versions are first reduced to one maximum per (entity, attribute,
    time) with a map-side combine, events to their distinct (entity, time). The
    time line of every entity is cut into shards of `shard_months`; a shard's running
    maximum is computed alone, and what came before it enters as one carry-in row per
    shard, so a hot entity is spread over as many tasks as it has shards. Events meet
    the result in an equi-join in which the other side is unique per key, which AQE can split.
    Column names of `events` may clash with those of `versions`: only the named columns
    of `versions` are read.
    """
    picked = F.struct(*[F.col(f"`{c}`") for c in [*order, *payload]])
    best = (
        versions.where(F.col(entity).isNotNull() & F.col(attribute).isNotNull() & F.col(known_from).isNotNull())
        .groupBy(F.col(entity).alias("_e"), F.col(attribute).alias("_a"), F.col(known_from).alias("_t"))
        .agg(F.max(picked).alias("_v"))
    )
    kinds = best.select("_e", "_a").distinct()
    asked = events.select(F.col(entity).alias("_e"), F.col(event_time).alias("_t")).dropna().distinct()
    marks = asked.join(kinds, "_e").select("_e", "_a", "_t", F.lit(None).cast(best.schema["_v"].dataType).alias("_v"), F.lit(True).alias("_m"))
    line = best.withColumn("_m", F.lit(False)).unionByName(marks).withColumn("_s", F.floor(F.col("_t") / shard_months))
    shards = line.groupBy("_e", "_a", "_s").agg(F.max("_v").alias("_top"))
    before = Window.partitionBy("_e", "_a").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = shards.select("_e", "_a", "_s", F.max("_top").over(before).alias("_carry"))
    local = Window.partitionBy("_e", "_a", "_s").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    state = (
        line.withColumn("_run", F.max("_v").over(local))
        .where("_m")
        .join(carry, ["_e", "_a", "_s"], "left")
        .select("_e", "_a", "_t", _greater("_run", "_carry").alias("_best"))
        .where("_best is not null")
    )
    return (
        events.join(state, (F.col(f"`{entity}`") == F.col("_e")) & (F.col(f"`{event_time}`") == F.col("_t")))
        .select(*[F.col(f"`{c}`") for c in events.columns], F.col("_a").alias(attribute), *[F.col(f"_best.`{c}`").alias(c) for c in payload])
    )


def _greater(a: str, b: str) -> Column:
    return F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).when(F.col(a) >= F.col(b), F.col(a)).otherwise(F.col(b))


def with_release(quarterly: DataFrame, lags: DataFrame) -> DataFrame:
    """`_known`: the month ordinal in which each row of quarterly was released.

    release_month where it is a real month not before the last month of its quarter,
    else the last month of the quarter plus the lag valid for the indicator in that
    year. Null where neither exists. The lag table is small and fixed; AQE may broadcast it.
    """
    lag = lags.select(F.col("indicator").alias("_i"), "year_from", "year_to", "lag_months")
    end = F.col("year") * 12 + F.col("quarter") * 3 - 1
    said = month_number(F.col("release_month"))
    return (
        quarterly.join(lag, (F.col("indicator") == F.col("_i")) & (F.col("year") >= F.col("year_from")) & (F.col("year") < F.col("year_to")), "left")
        .withColumn("_known", F.when(said >= end, said).otherwise(end + F.col("lag_months")).cast("int"))
        .drop("_i", "year_from", "year_to", "lag_months")
    )
