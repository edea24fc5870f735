"""One ranking from several scores: a random walk over ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.operators.ranks import cumulate
from panelmill.sources.tables import durable, exact_rows


def rank_bin(higher: np.ndarray, exact: int, step: float) -> np.ndarray:
    """Bin of a position (number of items above): single positions up to `exact`, then bins that grow by `step`, relatively."""
    higher = np.asarray(higher, dtype=float)
    with np.errstate(divide="ignore"):
        tail = exact + np.floor(np.log(np.maximum(higher, 1) / exact) / math.log1p(step))
    return np.where(higher < exact, higher, tail).astype(np.int64)


def rank_walk(df: DataFrame, item: str, scores: Sequence[str], damping: float = 0.5, tol: float = 1e-7, exact: int = 2000, step: float = 0.002) -> DataFrame:
    """One order of all items: item, n_scores, stationarity, place (1 is the top; equals share a place).

    From an item the walk picks one of its scores at random and jumps, uniformly, to an
    item that this score puts strictly higher; an item on top of the score, and every
    walk with chance 1 - damping, restarts anywhere. Items are ordered by their share of
    the walk's time, then by mean percentile. Only ranks count, so no scale or outlier
    dominates. Null, NaN and infinite scores are missing; an item stands, in a score that
    it lacks, at the mean of its percentiles in the scores it has, so that lacking one is
    neither gain nor loss. Items without any score share the last place. Exact copies of
    a row count once; items that repeat with different scores stay separate rows. Equal
    values are ties: neither is higher. An empty table gives none.

    Positions within one bin (see rank_bin: exact for the first `exact`, 0.2 % wide
    below) count as equal to each other in the walk.

    Rounds go on until the mass moved in one is under tol; each shrinks it by the damping at
    least, so their number is bounded by ln(tol) / ln(damping).

    How it scales: each round is one scan of a table of k small integers a row (the bins, written
    once) that adds up the mass per (score, bin), with prefix sums over the bins. There are at most
    exact + ln(N / exact) / step bins a score (below 16,000 for 10**15 items), so what
    is collected and sent out each round is bounded; items are never shuffled.
    """
    k = len(scores)
    if not 0 < damping < 1:
        raise ValueError("damping lies between 0 and 1")
    clean = [F.when(~F.isnan(F.col(f"`{s}`")) & (F.abs(F.col(f"`{s}`")) != float("inf")), F.col(f"`{s}`").cast("double")).alias(f"_v{i}") for i, s in enumerate(scores)]
    rows = durable(exact_rows(df, item, *scores).select(F.col(f"`{item}`"), *clean), "scores")
    total = rows.count()
    if not total:
        return rows.select(item, F.lit(0).alias("n_scores"), F.lit(0.0).alias("stationarity"), F.lit(0).cast("bigint").alias("place"))
    values = rows.select(F.posexplode(F.array(*[f"_v{i}" for i in range(k)])).alias("_s", "_x")).where("_x is not null").groupBy("_s", "_x").agg(F.count(F.lit(1)).alias("_n"))
    ranked = cumulate(values, "_s", ["_x"], "_n").select("_s", "_x", "_n", (F.col("total") - F.col("upto")).alias("_h"))
    tail = F.lit(exact) + F.floor(F.ln(F.greatest(F.col("_h"), F.lit(1)) / exact) / math.log1p(step))
    edges = ranked.withColumn("_b", F.when(F.col("_h") < exact, F.col("_h")).otherwise(tail)).groupBy("_s", "_b").agg(F.min("_x").alias("low"), F.sum("_n").alias("n")).toPandas()
    cuts, shares = [], []
    for s in range(k):
        e = edges[edges["_s"] == s].sort_values("low")
        n = e["n"].to_numpy(dtype=float)
        above = n[::-1].cumsum()[::-1] - n
        cuts.append(e["low"].to_numpy())
        shares.append((above + n / 2) / max(n.sum(), 1))

    def place(batches):
        for pdf in batches:
            share = np.full((len(pdf), k), np.nan)
            for s in range(k):
                v = pdf[f"_v{s}"].to_numpy(dtype=float, na_value=np.nan)
                there = np.isfinite(v)
                share[there, s] = shares[s][np.searchsorted(cuts[s], v[there], side="right") - 1]
            had = np.isfinite(share).sum(1)
            mean = np.where(had > 0, np.nansum(share, 1) / np.maximum(had, 1), 1.0)
            share = np.where(np.isfinite(share), share, mean[:, None])
            b = rank_bin(np.floor(share * total), exact, step).astype(np.int32)
            yield pd.DataFrame({item: pdf[item], "n_scores": had.astype("int32"), "_mean": mean, **{f"_b{s}": b[:, s] for s in range(k)}})

    kind, names = rows.schema[item].dataType.simpleString(), [f"_b{s}" for s in range(k)]
    placed = durable(rows.mapInPandas(place, f"`{item}` {kind}, n_scores int, _mean double, " + ", ".join(f"{c} int" for c in names)), "placed")
    width = int(rank_bin(np.array([total]), exact, step)[0]) + 1

    def mass(g: np.ndarray | None, rest: float):
        """Sum of the items' mass by score and bin; with g None, their number."""

        def add(batches):
            c = np.zeros((k, width))
            for pdf in batches:
                b = [pdf[n].to_numpy() for n in names]
                x = np.ones(len(pdf)) if g is None else rest + damping * sum(g[s][b[s]] for s in range(k))
                for s in range(k):
                    c[s] += np.bincount(b[s], x, width)
            s, b = np.nonzero(c)
            yield pd.DataFrame({"s": s.astype("int32"), "b": b.astype("int32"), "v": c[s, b]})

        got = placed.select(*names).mapInPandas(add, "s int, b int, v double").groupBy("s", "b").agg(F.sum("v").alias("v")).toPandas()
        c = np.zeros((k, width))
        c[got["s"], got["b"]] = got["v"]
        return c

    size = mass(None, 0.0)
    above = size.cumsum(1) - size
    c, g, rest = size / total, np.zeros((k, width)), 0.0
    moved, left = 1.0, math.ceil(math.log(tol / 2) / math.log(damping)) + 5
    while moved >= tol:
        if not left:
            raise RuntimeError("the walk does not settle: the sums are not finite")
        left -= 1
        jump = np.divide(c, k * above, out=np.zeros_like(c), where=above > 0)
        g = jump[:, ::-1].cumsum(1)[:, ::-1] - jump
        rest = (1 - damping) / total + damping * float(c[above <= 0].sum()) / k / total
        new = mass(g, rest)
        moved = np.abs(new - c).sum() / k
        c = new

    def final(batches):
        for pdf in batches:
            x = rest + damping * sum(g[s][pdf[names[s]].to_numpy()] for s in range(k))
            yield pd.DataFrame({item: pdf[item], "n_scores": pdf["n_scores"], "stationarity": np.where(pdf["n_scores"] > 0, x, 0.0), "_low": np.float64(1.0) - pdf["_mean"]})

    out = durable(placed.mapInPandas(final, f"`{item}` {kind}, n_scores int, stationarity double, _low double"), "walk")
    cells = out.groupBy("stationarity", "_low").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(0))
    order = cumulate(cells, "_one", ["stationarity", "_low"], "_n", 256).select(F.col("stationarity").alias("_a"), F.col("_low").alias("_b"), (F.col("total") - F.col("upto") + 1).alias("place"))
    return out.join(order, (F.col("stationarity") == F.col("_a")) & (F.col("_low") == F.col("_b"))).select(item, "n_scores", "stationarity", "place")
