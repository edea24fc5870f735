"""Percentiles of very large columns from mergeable value counts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.ranks import cumulate
from panelmill.sources.tables import durable


_KINDS = ("null", "nan", "inf")  # numbers 0 to 2 of `cell_number`; 3 is the cell of 0
_SHARES = 16  # a group of more than 1 / (_SHARES * partitions) of the rows is split


def sketched(x: Column, rel_error: float) -> Column:
    """The representative of x: within rel_error * |x| of it, and the same for all values of a cell; x itself for rel_error 0.

    Cells are logarithmic, so a column of doubles has at most about 1420 / rel_error
    of them, whatever the number of rows.
    """
    if not rel_error:
        return x + F.lit(0.0)
    gamma = (1 + rel_error) / (1 - rel_error)
    size = F.abs(x)
    cell = F.ceil(F.ln(size) / math.log(gamma)).cast("double")
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * F.pow(F.lit(gamma), cell) * (2 / (gamma + 1)))


def _gamma(rel_error: float) -> float:
    return (1 + rel_error) / (1 - rel_error)


def _span(rel_error: float) -> int:
    """Logarithmic places of doubles lie between -span and span: their logarithms between -745 and 710."""
    return math.ceil(760 / math.log(_gamma(rel_error)))


def cell_bits(rel_error: float) -> int:
    """Bits that hold every `cell_number`: 19 for 0.005."""
    return (5 + 4 * _span(rel_error)).bit_length()


def cell_number(x: Column, rel_error: float) -> Column:
    """Cell of any double as a small integer from 0: what is no number, 0, then place and sign; equal for equal representatives only."""
    kind = kind_of(x)
    place = F.ceil(F.ln(F.abs(x)) / math.log(_gamma(rel_error))).cast("bigint") + _span(rel_error)
    number = F.when(x == 0, F.lit(3)).when(x > 0, place * 2 + 4).otherwise(place * 2 + 5)
    for i, k in enumerate(_KINDS):
        number = F.when(kind == k, F.lit(i)).otherwise(number)
    return number.cast("bigint")


def cell_value(cell: Column, rel_error: float) -> Column:
    """Representative of a cell of `cell_number`; null for what is no number."""
    gamma = _gamma(rel_error)
    place = F.shiftright(cell - 4, 1) - _span(rel_error)
    sign = F.when(cell % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return F.when(cell == 3, F.lit(0.0)).when(cell > 3, sign * F.pow(F.lit(gamma), place.cast("double")) * (2 / (gamma + 1)))


def kind_of(x: Column) -> Column:
    """'value', 'null', 'nan' or 'inf'."""
    return F.when(x.isNull(), "null").when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").otherwise("value")


def summaries(df: DataFrame, group: Sequence[str], measures: Sequence[str], rel_error: float = 0.005) -> DataFrame:
    """Mergeable summary: group columns, measure, kind, value, n.

    kind is 'value' (finite numbers, value holds the representative), 'null', 'nan' or
    'inf' (either sign; value is null for these three). Summaries of parts of the data
    are combined by `combine`, without loss against a summary of the whole. Null group
    values form groups of their own. An empty df gives an empty summary.
    """
    cells = [F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").cast("double").alias("x")) for m in measures]
    x = F.col("c.x")
    kind = kind_of(x)
    rows = df.select(*[F.col(f"`{g}`") for g in group], F.explode(F.array(*cells)).alias("c"))
    rows = rows.select(*[F.col(f"`{g}`") for g in group], "c.measure", kind.alias("kind"), F.when(kind == "value", sketched(x, rel_error)).alias("value"))
    return rows.groupBy(*[F.col(f"`{g}`") for g in group], "measure", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def crowded(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups that hold more than 1 / (_SHARES * partitions) of the rows: group columns, _shares (parts to split them into).

    These are at most about _SHARES groups a shuffle partition, however many groups and rows there are, so they can be broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(df.count() // (_SHARES * parts), 1)
    sizes = df.groupBy(*[F.col(f"`{g}`") for g in group]).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.where(F.col("_rows") > most).select(*[F.col(f"`{g}`") for g in group], F.ceil(F.col("_rows") / most).cast("int").alias("_shares"))


def distinct_summaries(df: DataFrame, digest: Column, group: Sequence[str], measures: Sequence[str], rel_error: float = 0.005) -> DataFrame:
    """`summaries` of df with exact copies (equal `digest`, group and cells) counted once, in parts: `combine` them for one row a cell.

    Rows become short before they move: a digest, the group, and the cells of all measures
    packed into as few integers as hold them. They move once, by group; a crowded group is
    split by the digest, so no group, however hot, meets in one task and copies still do.
    Each task counts its cells, and these counts are the summary of its part; only crowded
    groups have more than one part. df is read twice, at first for the sizes of the groups.
    """
    bits = cell_bits(rel_error)
    per_word = 63 // bits
    words = [measures[i : i + per_word] for i in range(0, len(measures), per_word)]
    packed = [reduce(lambda a, b: a + b, [F.shiftleft(cell_number(F.col(f"`{m}`").cast("double"), rel_error), bits * j) for j, m in enumerate(w)]).alias(f"_w_{k}") for k, w in enumerate(words)]
    keys = [F.col(f"`{g}`") for g in group]
    big = crowded(df, group).select(*[F.col(f"`{g}`").alias(f"_g_{g}") for g in group], "_shares")
    same = reduce(lambda a, b: a & b, [F.col(f"`{g}`").eqNullSafe(F.col(f"`_g_{g}`")) for g in group], F.lit(True))
    rows = df.select(*keys, digest.alias("_digest"), *packed).join(F.broadcast(big), same, "left")
    rows = rows.select(*keys, F.coalesce(F.pmod("_digest", "_shares"), F.lit(0)).cast("int").alias("_part"), "_digest", *[f"_w_{k}" for k in range(len(words))])
    rows = rows.repartition(*keys, "_part").distinct()  # one exchange serves the copies and the counts
    # measure and cell in one number
    cell = lambda i: F.shiftright(f"_w_{i // per_word}", bits * (i % per_word)).bitwiseAND(F.lit((1 << bits) - 1))
    long = rows.select(*keys, "_part", F.explode(F.array(*[cell(i) * len(measures) + i for i in range(len(measures))])).alias("_c"))
    counts = long.groupBy(*keys, "_part", "_c").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*keys, F.pmod("_c", F.lit(len(measures))).cast("int").alias("_i"), F.expr(f"_c div {len(measures)}").alias("_cell"), "n")
    kind = F.lit("value")
    for i, k in enumerate(_KINDS):
        kind = F.when(F.col("_cell") == i, k).otherwise(kind)
    name = F.element_at(F.array(*[F.lit(m) for m in measures]), F.col("_i") + 1)
    return counts.select(*keys, name.alias("measure"), kind.alias("kind"), cell_value(F.col("_cell"), rel_error).alias("value"), "n")


def combine(summary: DataFrame, group: Sequence[str]) -> DataFrame:
    """Summary by fewer group columns (or the union of several summaries) as one summary."""
    return summary.groupBy(*[F.col(f"`{g}`") for g in group], "measure", "kind", "value").agg(F.sum("n").alias("n"))


def percentiles(summary: DataFrame, group: Sequence[str], probs: Sequence[float], per_octave: int = 16) -> DataFrame:
    """Percentiles of combined summaries: group columns, measure, p, value, n, n_null, n_nan, n_inf.

    The percentile p of n finite values is the smallest value with at least ceil(p * n)
    values not above it (ties included); p is taken to four digits. With a summary of
    rel_error e, the value is within e of the exact one, relatively. A group without
    finite values has null percentiles and its counts.
    """
    packed = F.struct(*[F.col(f"`{g}`") for g in group], "measure")
    s = combine(summary.select(packed.alias("_g"), "measure", "kind", "value", "n"), ["_g"]).drop("measure")
    s = durable(s, "cells")
    count = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    counts = s.groupBy("_g").agg(count("value").alias("n"), count("null").alias("n_null"), count("nan").alias("n_nan"), count("inf").alias("n_inf"))
    steps = [round(p * 10_000) for p in probs]
    wanted = counts.withColumn("_p", F.explode(F.array(*[F.lit(k) for k in steps])))
    cells = cumulate(s.where("kind = 'value'").drop("kind"), "_g", ["value"], "n", per_octave)
    rank = lambda k: F.greatest(F.expr(f"({k}L * total + 9999L) div 10000L"), F.lit(1))
    hits = F.filter(F.array(*[F.when((F.col("upto") >= rank(k)) & (F.col("before") < rank(k)), F.lit(k)) for k in steps]), lambda k: k.isNotNull())
    picked = cells.select(F.col("_g").alias("_h"), "value", F.explode(hits).alias("_q"))
    out = wanted.join(picked, (F.col("_g") == F.col("_h")) & (F.col("_p") == F.col("_q")), "left")
    return out.select(*[F.col(f"_g.`{g}`").alias(g) for g in group], "_g.measure", (F.col("_p") / 10_000).alias("p"), "value", "n", "n_null", "n_nan", "n_inf")
