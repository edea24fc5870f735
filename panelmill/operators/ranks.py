"""Running counts and ranks over whole tables, without a task that holds them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _range(v: Column, per_octave: int) -> Column:
    """Number of the range of v: per_octave ranges for each doubling of its size, in the order of v; infinite ones and NaN (above all) have ranges of their own."""
    x, log = v.cast("double"), F.floor(F.log2(F.abs(v)) * per_octave)
    ends = F.when(F.isnan(x), F.lit(60_000 * per_octave)).when(F.abs(x) == float("inf"), F.signum(x) * 40_000 * per_octave)
    return F.when(v == 0, F.lit(0)).otherwise(ends.otherwise(F.signum(v) * (log + 20_000 * per_octave))).cast("bigint")


def cumulate(cells: DataFrame, key: str, order: Sequence[str], n: str, per_octave: int = 16) -> DataFrame:
    """Adds before (rows of the key ordered strictly earlier), upto (before + own) and total.

    cells has one row per (key, order...) with n rows each; order[0] is a number. Cells are
    sorted within ranges of order[0] (per_octave ranges for each doubling of its size), and
    the totals of all earlier ranges are added as an offset: no task holds a whole key, and
    a range boundary depends on the value only, so a recomputed task agrees with the rest.
    """
    cells = cells.withColumn("_r", _range(F.col(order[0]), per_octave))
    ranges = cells.groupBy(key, "_r").agg(F.sum(n).alias("_n"))
    line = Window.partitionBy(key)
    ranges = ranges.select(F.col(key).alias("_k"), F.col("_r").alias("_rr"), F.coalesce(F.sum("_n").over(line.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_n").over(line).alias("total"))
    inside = Window.partitionBy(key, "_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("_run", F.sum(n).over(inside))
    out = run.join(ranges, (F.col(key) == F.col("_k")) & (F.col("_r") == F.col("_rr")))
    return out.withColumn("upto", F.col("_off") + F.col("_run")).withColumn("before", F.col("upto") - F.col(n)).drop("_r", "_k", "_rr", "_off", "_run")


def whole_rank(df: DataFrame, x: str, name: str = "rank", key: str | None = None) -> DataFrame:
    """Adds <name> (place of x over the whole table or its key, ties share the mean place) and <name>_n (rows with an x); null for null.

    Values are counted with map-side combine and ranked by `cumulate`, so no task holds the table.
    """
    k = F.col(key) if key else F.lit(0)
    cells = df.where(F.col(x).isNotNull()).groupBy(k.alias("_cell_key"), F.col(x).cast("double").alias("_cell_x")).agg(F.count(F.lit(1)).alias("_cell_n"))
    placed = cumulate(cells, "_cell_key", ["_cell_x"], "_cell_n").select("_cell_key", "_cell_x", (F.col("before") + (F.col("_cell_n") + 1) / 2).alias(name), F.col("total").alias(f"{name}_n"))
    return df.join(placed, (F.col(x).cast("double") == F.col("_cell_x")) & (k == F.col("_cell_key")), "left").drop("_cell_x", "_cell_key")


def whole_bins(df: DataFrame, x: str, bins: int, tie: str, name: str, key: str | None = None) -> DataFrame:
    """Adds <name>: bin 0..bins-1 by the edges of equal shares of the order of x over the whole table or its key, ties by the number `tie`; null for null.

    The bin of place i of n (from 0) is that of the edges i * bins / (n - 1), the lowest edge closed.
    """
    k = F.col(key) if key else F.lit(0)
    cells = df.where(F.col(x).isNotNull()).groupBy(k.alias("_cell_key"), F.col(x).cast("double").alias("_cell_x"), F.col(tie).alias("_cell_tie")).agg(F.count(F.lit(1)).alias("_cell_n"))
    n = F.col("total")
    place = F.when(n <= 1, F.lit(0)).otherwise(F.greatest(F.floor((F.col("before") * bins + n - 2) / (n - 1)) - 1, F.lit(0))).cast("int")
    placed = cumulate(cells, "_cell_key", ["_cell_x", "_cell_tie"], "_cell_n").select("_cell_key", "_cell_x", "_cell_tie", place.alias(name))
    return df.join(placed, (F.col(x).cast("double") == F.col("_cell_x")) & (F.col(tie) == F.col("_cell_tie")) & (k == F.col("_cell_key")), "left").drop("_cell_x", "_cell_tie", "_cell_key")


def whole_percentiles(df: DataFrame, x: str, shares: Sequence[float], key: str | None = None, per_octave: int = 256) -> DataFrame:
    """(key, q, n): the exact interpolated percentiles of x, one for each of `shares`, and the number of its values, over the whole table (no column key) or each key.

    Nulls of x and rows with a null key do not count. Values are counted by range first, map-side; only
    those of the ranges that hold a wanted place are then ordered, so no task holds a key. df is read twice.
    """
    cells = df.where(F.col(x).isNotNull()).select((F.col(key) if key else F.lit(0)).alias("_cell_key"), F.col(x).cast("double").alias("_cell_x")).withColumn("_r", _range(F.col("_cell_x"), per_octave))
    line = Window.partitionBy("_k").orderBy("_rr").rowsBetween(Window.unboundedPreceding, 0)
    ranges = cells.groupBy(F.col("_cell_key").alias("_k"), F.col("_r").alias("_rr")).agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.withColumn("_upto", F.sum("_n").over(line)).withColumn("_off", F.col("_upto") - F.col("_n")).withColumn("n", F.sum("_n").over(Window.partitionBy("_k")))
    places = [(F.col("n") - 1) * F.lit(float(p)) for p in shares]
    ends = [f(p).cast("bigint") for p in places for f in (F.floor, F.ceil)]
    wanted = ranges.where(reduce(lambda a, b: a | b, [(e >= F.col("_off")) & (e < F.col("_upto")) for e in ends]))
    near = cells.join(wanted.select("_k", "_rr", "_off", "n"), (F.col("_cell_key") == F.col("_k")) & (F.col("_r") == F.col("_rr")))
    near = near.groupBy("_cell_key", "_r", "_off", "n", "_cell_x").agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy("_cell_key", "_r").orderBy("_cell_x").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_upto", F.col("_off") + F.sum("_n").over(inside)).withColumn("_before", F.col("_upto") - F.col("_n"))
    found = [F.max(F.when((e >= F.col("_before")) & (e < F.col("_upto")), F.col("_cell_x"))).alias(f"_e{i}") for i, e in enumerate(ends)]
    out = near.groupBy("_cell_key", "n").agg(*found)
    low, high = [F.col(f"_e{2 * i}") for i in range(len(shares))], [F.col(f"_e{2 * i + 1}") for i in range(len(shares))]
    q = F.array(*[F.when(a == b, a).otherwise(a + (b - a) * (p - F.floor(p))) for a, b, p in zip(low, high, places)])
    return out.select(*([F.col("_cell_key").alias(key)] if key else []), q.alias("q"), "n")
