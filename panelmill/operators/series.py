"""Whole series at a time: one row a series, arrays in Arrow batches, one matrix per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 2_000_000  # numbers in one matrix: longer series come in smaller parts


def months_of(df: DataFrame) -> np.ndarray:
    """The months (ordinals) that occur, in order: a list bounded by the calendar, however many rows there are."""
    return np.array(sorted(r["t"] for r in df.select("t").where("t is not null").distinct().collect()), int)


def as_arrays(df: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row a series: key..., _t and one array per value, by month."""
    s = df.where("t is not null").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("t", *values))).alias("_s"))
    return s.select(*key, F.col("_s.t").alias("_t"), *[F.col(f"_s.{v}").alias(v) for v in values])


def matrices(pdf: pd.DataFrame, values: Sequence[str], months: np.ndarray) -> Iterator[tuple[pd.DataFrame, list[np.ndarray], np.ndarray]]:
    """Parts of a batch: its rows, one matrix (series x months, NaN for null and absent) per value, and which cells are there."""
    step = max(1, CELLS // max(len(months), 1))
    for lo in range(0, len(pdf), step):
        part = pdf.iloc[lo : lo + step]
        n = part["_t"].map(len).to_numpy()
        row, col = np.repeat(np.arange(len(part)), n), np.searchsorted(months, np.concatenate(part["_t"].to_numpy()).astype(int))
        there = np.zeros((len(part), len(months)), bool)
        there[row, col] = True
        out = []
        for v in values:
            m = np.full(there.shape, np.nan)
            m[row, col] = np.concatenate(part[v].to_numpy()).astype(float)
            out.append(m)
        yield part, out, there


def per_cell(df: DataFrame, key: Sequence[str], values: Sequence[str], out: str, f: Callable[..., np.ndarray]) -> DataFrame:
    """(key..., t, out): f turns the matrices of the values into one of the same shape; a row for every cell that df has.

    Series are gathered once; a series holds at most one cell a month. NaN in the result becomes null.
    """
    months = months_of(df)
    arrays = as_arrays(df, key, values)
    kinds = ", ".join(f"`{c}` {arrays.schema[c].dataType.simpleString()}" for c in key)

    def run(batches):
        for pdf in batches:
            for part, mats, there in matrices(pdf, values, months) if len(pdf) else ():
                at = np.argwhere(there)
                rows = part.iloc[at[:, 0]][list(key)].reset_index(drop=True)
                rows["t"] = months[at[:, 1]].astype("int32")
                rows[out] = f(*mats)[at[:, 0], at[:, 1]]
                yield rows

    done = arrays.mapInPandas(run, f"{kinds}, t int, `{out}` double")
    return done.withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def per_series(df: DataFrame, key: Sequence[str], values: Sequence[str], schema: str, f: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """(key..., schema): f gets the months and the matrices and returns one array per column, one entry a series, and optionally `keep`, a mask of series."""
    months = months_of(df)
    arrays = as_arrays(df, key, values)
    kinds = ", ".join(f"`{c}` {arrays.schema[c].dataType.simpleString()}" for c in key)

    def run(batches):
        for pdf in batches:
            for part, mats, _ in matrices(pdf, values, months) if len(pdf) else ():
                got = f(months, *mats)
                rows = part[list(key)].reset_index(drop=True).assign(**{k: v for k, v in got.items() if k != "keep"})
                yield rows[got["keep"]] if "keep" in got else rows

    return arrays.mapInPandas(run, f"{kinds}, {schema}")


def nan_median(a: np.ndarray) -> np.ndarray:
    """Row medians without NaN; NaN for a row of NaN."""
    if not a.shape[1]:
        return np.full(len(a), np.nan)
    s, n, r = np.sort(a, axis=1), np.isfinite(a).sum(1), np.arange(len(a))
    return np.where(n > 0, (s[r, np.maximum(n - 1, 0) // 2] + s[r, np.minimum(n // 2, a.shape[1] - 1)]) / 2, np.nan)


def nan_var(a: np.ndarray) -> np.ndarray:
    """Row variances (over n) without NaN; NaN for a row of NaN."""
    n = np.isfinite(a).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.nansum(a, 1) / n
        return np.nansum((a - mean[:, None]) ** 2, 1) / n
