"""Implausible readings: robust exponentially weighted control charts per source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions import array_median
from panelmill.operators.series import nan_median
from panelmill.sources.tables import durable


@dataclass(frozen=True)
class Chart:
    """Parameters of the control chart.

    weight: share of a new reading in the running mean. limit: scales of the source by which a
    reading is suspected. floor: least scale, in units of the charted value. longest: a
    deviation of more than so many neighbouring readings is a new level, not a spike.
    run: so many equal neighbouring readings are a stuck sensor. start: readings that set
    the first mean. shared: the common profile of n sources is taken away to the part
    (n - 1) / (n - 1 + shared), so that a lone source keeps its own course and many lose what
    they have in common. prior: the pooled scale (median over the sources) weighs as much as
    so many differences of readings when a source's own scale is drawn towards it, on
    logarithms; 0 leaves the scale as it is. drift: the running scale of a source may fall to
    its whole-series scale divided by drift, and rise to that times drift.
    """

    weight: float = 0.3
    limit: float = 7.0
    floor: float = 0.01
    longest: int = 2
    run: int = 4
    start: int = 5
    shared: float = 2.0
    prior: float = 0.0
    drift: float = 1.25


def latest_valid(df: DataFrame, key: list[str], value: str, version: str) -> DataFrame:
    """One row per key: the value of its latest version. A null version is the oldest; among equal versions the greatest value wins (NaN above all)."""
    return df.groupBy(*key).agg(F.max(F.struct(F.col(version).alias("_w"), F.col(value).alias("_x")))["_x"].alias(value))


def implausible(readings: DataFrame, source: list[str], step: str, value: str, log: bool, impossible: Column, season_by: str | None = None, chart: Chart = Chart()) -> DataFrame:
    """The readings that cannot be true for their source: source columns, step, reason.

    readings has one row per (source, step); step is an integer that counts calendar
    periods. reason is 'impossible' (the physical limit holds), 'stuck' (chart.run or more
    neighbouring steps, all present, with exactly one value) or 'spike' (at most
    chart.longest neighbouring readings outside the control limits of the source, judged
    forwards and backwards in time). Null and NaN are missing. A source with fewer than
    three usable readings has no spikes. An empty table gives none.

    season_by names the source column within which all sources share a seasonal and trend
    profile; it is removed before charting (median over sources of the deviation from the
    source's own median, for each step; of two middle values the one nearer to 0), as far as
    chart.shared says. With log=True the chart is on logarithms.

    How it scales: a source holds at most one reading per calendar step, so the array of
    a source is bounded by the calendar, not by the rows; the charts of all sources in an
    Arrow batch advance together, one reading at a time, in parts of bounded size. Only
    readings that are there take room, so a reading with an absurd date costs no more
    than any other. Profiles are aggregated with map-side combine and joined, not collected.
    """
    usable = F.col(value).isNotNull() & ~F.isnan(value)
    x = F.col(value).cast("double")
    good = usable & ~impossible & (F.abs(x) != float("inf"))
    level = F.ln(F.when(good & (x > 0), x)) if log else F.when(good, x)
    rows = readings.where(usable & F.col(step).isNotNull()).select(*source, F.col(step).cast("int").alias("_t"), x.alias("_x"), level.alias("_y"), impossible.alias("_bad"))
    series = rows.groupBy(*source).agg(F.sort_array(F.collect_list(F.struct("_t", "_x", "_y", "_bad"))).alias("_s"))
    if season_by or chart.prior:
        series = durable(series, "series")
    if season_by:
        own = series.withColumn("_med", array_median(F.filter(F.col("_s").getField("_y"), lambda y: y.isNotNull())))
        low, high = F.col("_q")[0], F.col("_q")[1]
        middle = F.when(low * high <= 0, F.lit(0.0)).when(F.abs(low) <= F.abs(high), low).otherwise(high)
        part = (F.col("_n") - 1) / (F.col("_n") - 1 + F.lit(chart.shared))
        profile = (
            own.select(F.col(season_by).alias("_c"), "_med", F.explode("_s").alias("_r"))
            .where("_r._y is not null")
            .groupBy("_c", F.col("_r._t").alias("_t"))
            .agg(F.percentile_approx(F.col("_r._y") - F.col("_med"), F.array(F.lit(0.5), F.lit(0.5 + 1e-9)), F.lit(2000)).alias("_q"), F.count(F.lit(1)).alias("_n"))
            .groupBy("_c")
            .agg(F.map_from_entries(F.collect_list(F.struct("_t", (part * middle).alias("_p")))).alias("_profile"))
        )
        series = series.join(profile, F.col(season_by).eqNullSafe(F.col("_c")), "left").drop("_c")
        series = series.withColumn("_s", F.transform("_s", lambda s: F.struct(s["_t"], s["_x"], (s["_y"] - F.coalesce(F.try_element_at("_profile", s["_t"]), F.lit(0.0))).alias("_y"), s["_bad"]))).drop("_profile")
    flat = series.select(*source, *[F.col("_s").getField(c).alias(c) for c in ("_t", "_x", "_y", "_bad")])
    kinds = ", ".join(f"`{c}` {flat.schema[c].dataType.simpleString()}" for c in source)

    def scales(batches):
        for pdf in batches:
            for part in _parts(pdf):
                t, x, y, _ = _table(part)
                y = np.where(stuck_runs(x, chart.run, t), np.nan, y)
                yield pd.DataFrame({"s": _scale(y, chart.floor)[np.isfinite(y).sum(1) >= 3]})

    pooled = flat.select("_t", "_x", "_y", "_bad").mapInPandas(scales, "s double").agg(F.percentile_approx("s", 0.5, 10_000)).first()[0] if chart.prior else None

    def run(batches):
        for pdf in batches:
            for part in _parts(pdf):
                yield _judge(part, source, step, chart, pooled)

    return flat.mapInPandas(run, f"{kinds}, `{step}` int, reason string")


def _parts(pdf: pd.DataFrame, cells: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """A batch in parts of sources of like length, so that a part's table has at most about `cells` cells (one source at least)."""
    if not len(pdf):
        return
    n = pdf["_t"].map(len).to_numpy()
    order = np.argsort(n, kind="stable")
    lo = 0
    while lo < len(order):
        hi = len(order)
        while hi - lo > 1 and (hi - lo) * n[order[hi - 1]] > cells:
            hi = lo + (hi - lo + 1) // 2
        yield pdf.iloc[order[lo:hi]]
        lo = hi


def _table(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps, readings, charted values and marks of the impossible: one row per source, its readings in order of time from the left, then nothing (step -1, NaN)."""
    n = pdf["_t"].map(len).to_numpy()
    row = np.repeat(np.arange(len(pdf)), n)
    col = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
    shape = (len(pdf), int(n.max()))
    t, x, y, bad = np.full(shape, -1), np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape, bool)
    t[row, col] = np.concatenate(pdf["_t"].to_numpy()).astype(int)
    x[row, col] = np.concatenate(pdf["_x"].to_numpy()).astype(float)
    y[row, col] = np.concatenate(pdf["_y"].to_numpy()).astype(float)
    bad[row, col] = np.concatenate(pdf["_bad"].to_numpy()).astype(bool)
    return t, x, y, bad


def _judge(pdf: pd.DataFrame, source: list[str], step: str, chart: Chart, pooled: float | None) -> pd.DataFrame:
    t, x, y, bad = _table(pdf)
    stuck = stuck_runs(x, chart.run, t)
    spike = chart_spikes(np.where(stuck, np.nan, y), chart, pooled)
    reason = np.select([bad, stuck, spike], ["impossible", "stuck", "spike"], "")
    at = np.argwhere(reason != "")
    out = pdf.iloc[at[:, 0]][source].reset_index(drop=True)
    out[step] = t[at[:, 0], at[:, 1]].astype("int32")
    out["reason"] = reason[at[:, 0], at[:, 1]]
    return out


def stuck_runs(x: np.ndarray, least: int, t: np.ndarray | None = None) -> np.ndarray:
    """Mask of the readings in runs of at least `least` equal readings of neighbouring steps (columns, or the steps in t); NaN breaks a run."""
    length = np.zeros(x.shape, int)
    same = np.zeros(x.shape, bool)
    same[:, 1:] = x[:, 1:] == x[:, :-1]
    if t is not None:
        same[:, 1:] &= t[:, 1:] == t[:, :-1] + 1
    for j in range(x.shape[1]):
        length[:, j] = np.where(np.isnan(x[:, j]), 0, np.where(same[:, j], length[:, j - 1], 0) + 1)
    for j in range(x.shape[1] - 2, -1, -1):
        length[:, j] = np.where(same[:, j + 1], length[:, j + 1], length[:, j])
    return length >= least


def chart_spikes(y: np.ndarray, chart: Chart, pooled: float | None = None) -> np.ndarray:
    """Mask of the readings that stand outside the limits in the forward and in the backward chart."""
    with np.errstate(invalid="ignore", divide="ignore"):
        scale = _scale(y, chart.floor)
        if chart.prior and pooled:
            scale = _shrunk(scale, np.isfinite(y).sum(1), pooled, chart.prior)
        forward, backward = _one_way(y, scale, chart), _one_way(y[:, ::-1], scale, chart)[:, ::-1]
    enough = np.isfinite(y).sum(1) >= 3
    return forward & backward & enough[:, None]


def _scale(y: np.ndarray, floor: float) -> np.ndarray:
    """Normal-equivalent scale of a source's noise from its successive differences: steps of level move few of them."""
    filled = y.copy()
    for j in range(1, y.shape[1]):
        filled[:, j] = np.where(np.isnan(y[:, j]), filled[:, j - 1], y[:, j])
    d = np.abs(np.diff(filled, axis=1))
    d[np.isnan(y[:, 1:])] = np.nan
    if not d.shape[1]:
        return np.full(len(y), np.inf)
    s = 1.4826 * nan_median(d) / np.sqrt(2)
    return np.where(np.isnan(s), np.inf, np.maximum(s, floor))


def _shrunk(scale: np.ndarray, readings: np.ndarray, pooled: float, prior: float) -> np.ndarray:
    """Scales drawn towards the pooled one, the more the fewer readings a source has; unknown (infinite) ones become the pooled one."""
    n = np.where(np.isfinite(scale), np.maximum(readings - 1, 0), 0)
    own = np.log(np.where(np.isfinite(scale), scale, pooled))
    return np.exp((n * own + prior * np.log(pooled)) / (n + prior))


def _one_way(y: np.ndarray, scale: np.ndarray, chart: Chart) -> np.ndarray:
    """One pass over time for all sources: mean and scale move by clipped readings only; a run counter tells new levels from spikes."""
    n, T = y.shape
    k = min(chart.start, T)
    order = np.where(np.isfinite(y), np.cumsum(np.isfinite(y), axis=1), T + 1)
    mean = nan_median(np.where(order <= k, y, np.nan))
    spread = scale.copy()
    counter, side = np.zeros(n, int), np.zeros(n)
    total, flagged = np.zeros(n), np.zeros((n, T), bool)
    for j in range(T):
        v = y[:, j]
        there = np.isfinite(v) & np.isfinite(mean)
        e = np.where(there, v - mean, 0.0)
        width = np.clip(spread, scale / chart.drift, chart.drift * scale)
        out = there & (np.abs(e) > chart.limit * width)
        # the suspects so far are a level if they agree on a side and outlast `longest`
        same = out & (np.sign(e) == side)
        counter = np.where(out, np.where(same, counter + 1, 1), np.where(there, 0, counter))
        total = np.where(out, np.where(same, total + v, v), total)
        side = np.where(out, np.sign(e), np.where(there, 0, side))
        level = counter > chart.longest
        if level.any():
            back = counter[level]
            idx = np.flatnonzero(level)
            for i, c in zip(idx, back):
                seen = np.flatnonzero(np.isfinite(y[i, : j + 1]))[-c:]
                flagged[i, seen] = False
            mean = np.where(level, total / np.maximum(counter, 1), mean)
            counter, side = np.where(level, 0, counter), np.where(level, 0, side)
        flagged[:, j] = out & ~level
        calm = np.clip(e, -2 * width, 2 * width)
        mean = np.where(there & ~out, mean + chart.weight * calm, mean)
        spread = np.where(there & ~out, np.sqrt((1 - chart.weight / 3) * spread**2 + chart.weight / 3 * calm**2), spread)
    return flagged
