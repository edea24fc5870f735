"""Outlier scores of short vectors: robust Mahalanobis distance and isolation trees."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Location:
    """Centre and inverse scatter of a robust fit."""

    mean: np.ndarray
    inverse: np.ndarray

    def squared(self, columns: Sequence[str]) -> Column:
        """Squared distance of the vector in the columns (null counts as 0), as an expression."""
        d = [F.coalesce(F.col(c), F.lit(0.0)) - F.lit(float(m)) for c, m in zip(columns, self.mean)]
        total = F.lit(0.0)
        for i in range(len(d)):
            for j in range(i, len(d)):
                total = total + d[i] * d[j] * float(self.inverse[i, j] * (1 if i == j else 2))
        return total


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (over n) of the vectors: one pass of sums, nothing is collected but those."""
    x = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]
    k = len(x)
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    if not got["n"]:
        return 0.0, np.zeros(k), np.eye(k)
    cov = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return got["n"], np.array([got[f"m{i}"] for i in range(k)]), cov


def _inverse(cov: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(cov + 1e-12 * np.trace(cov) * np.eye(len(cov)))


def chi2_point(p: float, k: int) -> float:
    """The point p of the chi-square law with k degrees of freedom (bisection on the incomplete gamma series)."""

    def below(x: float) -> float:
        term = total = 1 / (k / 2)
        for i in range(1, 2000):
            term *= (x / 2) / (k / 2 + i)
            total += term
            if term < 1e-16 * total:
                break
        return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2)) if x > 0 else 0.0

    low, high = 0.0, 10.0 * k + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def robust_location(df: DataFrame, columns: Sequence[str], support: float = 0.9, steps: int = 30, tol: float = 1e-9) -> Location:
    """Minimum covariance determinant fit by concentration steps, from coordinate medians and scales.

    A step takes the `support` share of the rows that lie nearest (an exact percentile of
    the squared distance) and fits mean and covariance to them; the determinant falls until it stays.
    The scatter is made consistent by the median distance, and a last step drops rows beyond
    the 97.5 % point, as usual. Every step is two passes of sums over the rows. Nulls count
    as 0. An empty df gives the origin.
    """
    k = len(columns)
    x = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns}
    med = df.agg(*[F.median(x[c]).alias(c) for c in columns]).first()
    if med is None or med[0] is None:
        return Location(np.zeros(k), np.eye(k))
    mad = df.agg(*[F.median(F.abs(x[c] - F.lit(med[c]))).alias(c) for c in columns]).first()
    fit = Location(np.array([med[c] for c in columns]), np.diag([1 / max(1.4826 * mad[c], 1e-6) ** 2 for c in columns]))
    last = np.inf
    for _ in range(steps):
        cut = df.agg(F.percentile(fit.squared(columns), support)).first()[0]
        _, mean, cov = _moments(df.where(fit.squared(columns) <= F.lit(cut)), columns)
        fit, det = Location(mean, _inverse(cov)), np.linalg.slogdet(cov)[1]
        if last - det < tol:
            break
        last = det
    for last_step in (False, True):
        middle = df.agg(F.median(fit.squared(columns))).first()[0] or 1.0
        fit = Location(fit.mean, fit.inverse / (middle / chi2_point(0.5, k)))
        if not last_step:
            _, mean, cov = _moments(df.where(fit.squared(columns) < F.lit(chi2_point(0.975, k))), columns)
            fit = Location(mean, _inverse(cov))
    return fit


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points of a random binary tree."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Isolation trees as arrays: split column (-1: leaf), threshold, left child (the right one follows it), depth at leaves."""

    column: list[np.ndarray]
    threshold: list[np.ndarray]
    child: list[np.ndarray]
    depth: list[np.ndarray]
    size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean depth / expected depth): near 1 for outliers."""
        total = np.zeros(len(x))
        for column, threshold, child, depth in zip(self.column, self.threshold, self.child, self.depth):
            at = np.zeros(len(x), int)
            while True:
                open_ = np.flatnonzero(column[at] >= 0)
                if not len(open_):
                    break
                node = at[open_]
                at[open_] = child[node] + (x[open_, column[node]] > threshold[node])
            total += depth[at]
        return 2.0 ** (-total / len(self.column) / average_path(np.array([self.size]))[0])


def grow_forest(x: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    """Trees on random samples: random column, random threshold between its ends, down to the mean depth of a sample."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    forest = Forest([], [], [], [], size)
    limit = math.ceil(math.log2(max(size, 2)))
    for _ in range(trees):
        groups = [(0, x[rng.choice(len(x), size, replace=False)], 0)]
        column, threshold, child, depth = [-1], [0.0], [0], [0.0]
        while groups:
            at, part, level = groups.pop()
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 and level < limit else []
            if not len(spread):
                depth[at] = level + float(average_path(np.array([len(part)]))[0])
                continue
            c = int(rng.choice(spread))
            v = float(rng.uniform(part[:, c].min(), part[:, c].max()))
            column[at], threshold[at], child[at] = c, v, len(column)
            right = part[:, c] > v
            for side in (~right, right):
                groups.append((len(column), part[side], level + 1))
                column.append(-1)
                threshold.append(0.0)
                child.append(0)
                depth.append(0.0)
        forest.column.append(np.array(column))
        forest.threshold.append(np.array(threshold))
        forest.child.append(np.array(child))
        forest.depth.append(np.array(depth))
    return forest


def isolation_scores(df: DataFrame, key: Sequence[str], columns: Sequence[str], trees: int = 300, sample: int = 4096, bound: int = 40_000, seed: int = 0) -> DataFrame:
    """(key..., iforest): isolation score of every row; nulls count as 0.

    The trees are grown on samples of `sample` from at most `bound` rows (those first by a hash of the
    key: a bounded sample to fit on); every row is scored, in Arrow batches.
    """
    x = [F.coalesce(F.col(c), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(columns)]
    rows = df.select(*key, *x)
    names = [f"_x{i}" for i in range(len(columns))]
    few = rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(bound).select(*names).toPandas().to_numpy(float)
    forest = df.sparkSession.sparkContext.broadcast(grow_forest(few, trees, sample, seed) if len(few) else None)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[list(key)].assign(iforest=forest.value.score(pdf[names].to_numpy(float)))

    return rows.mapInPandas(run, f"{kinds}, iforest double")
