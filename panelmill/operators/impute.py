"""Filling gaps by chained equations whose regressions are fitted from distributed Gram matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.sources.tables import durable

# Marks that stand for "unknown" in text fields, after trimming and lower case.
UNKNOWN_MARKS = ["", "?", "-", "--", "—", "–", "n/a", "na", "nan", "none", "null", "unknown", "не указано", "нет данных", "неизвестно", "н/д", "нд"]
ROWS_A_TASK = 25_000


def usable_number(c: str, low: float, high: float) -> Column:
    """The number in column c, or null where it is null, NaN or outside [low, high]."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & x.between(low, high), x)


def usable_text(c: str) -> Column:
    """The trimmed text in column c, or null where it is null, blank or a mark for "unknown"."""
    t = F.regexp_replace(F.col(f"`{c}`"), r"^[\s ]+|[\s ]+$", "")
    return F.when(t.isNotNull() & ~F.lower(t).isin(UNKNOWN_MARKS), t)


def impute_chained(df: DataFrame, numeric: dict[str, tuple[float, float]], categorical: Sequence[str], group: str, row_id: str, rounds: int = 4, draw: bool = True, most_levels: int = 2000, seed: int = 1) -> DataFrame:
    """df with every unusable field filled, and a boolean `<field>_filled` beside each field.

    Chained equations: gaps start from the group (mean or commonest level). In each of
    `rounds` rounds the incomplete fields are taken one after the other: a field is fitted on the
    rows where it is present, from all other fields in their newest state and the means of
    its group, and its gaps are redrawn before the next field is fitted: numbers by a
    ridge regression plus a normal draw with the residual scale of the fit, clipped to the
    usable range; levels by a least-squares classifier of all levels from which one is
    drawn. With draw=False gaps get the fitted value or the likeliest level instead (for
    measuring the fit). Draws come from a hash of row_id, field and round, so a rerun gives the same.

    numeric maps a column to its usable range. Every level of a categorical column takes part
    and can be filled in; more than most_levels levels in all raise an error, as the fits grow
    with their square. A field without any usable value stays
    null and is marked. Repeated rows are all kept. An empty df stays empty. All other
    columns pass through unchanged. The names `<field>_filled` and those that begin with
    `_i_` are reserved.

    How it scales: one narrow pass over the coded rows for each field and round, and one that
    writes their state at the end of a round, so no pass repeats an earlier round. A pass
    turns each Arrow batch into one Gram matrix of fixed size (number of predictors squared),
    added up by map-side combine; only the sum reaches the driver. Group means are joined,
    not collected.
    """
    fields = [*numeric, *categorical]
    if not fields:
        return df
    clean = df.select("*", *[usable_number(c, *numeric[c]).alias(f"_i_{c}") for c in numeric], *[usable_text(c).alias(f"_i_{c}") for c in categorical], F.xxhash64(F.lit(seed), F.col(f"`{row_id}`")).alias("_i_hash"), F.monotonically_increasing_id().alias("_i_row"))
    clean = durable(clean, "impute")
    first = clean.agg(*[x for c in numeric for x in (F.avg(f"_i_{c}").alias(f"{c}|m"), F.stddev_pop(f"_i_{c}").alias(f"{c}|s"))], *[F.count(f"_i_{c}").alias(f"{c}|k") for c in fields], F.count(F.lit(1)).alias("n")).first()
    location = {c: (first[f"{c}|m"] or 0.0, first[f"{c}|s"] or 1.0) for c in numeric}
    levels: dict[str, list[str]] = {}
    for c in categorical:
        top = clean.where(F.col(f"_i_{c}").isNotNull()).groupBy(f"_i_{c}").count().orderBy(F.desc("count"), f"_i_{c}").limit(most_levels + 1).collect()
        levels[c] = [r[0] for r in top]
    if sum(map(len, levels.values())) > most_levels:
        raise ValueError(f"more than {most_levels} levels in {', '.join(categorical)}")

    # group profile: shrunk mean of each standardised number, shrunk share of each level
    z = {c: (F.col(f"_i_{c}") - location[c][0]) / location[c][1] for c in numeric}
    parts = [x for c in numeric for x in (F.sum(z[c]).alias(f"{c}|m"), F.count(z[c]).alias(f"{c}|n"))]
    parts += [F.sum((F.col(f"_i_{c}") == F.lit(v)).cast("double")).alias(f"{c}|{i}") for c in categorical for i, v in enumerate(levels[c])]
    parts += [F.count(f"_i_{c}").alias(f"{c}|n") for c in categorical]
    profile = clean.groupBy(F.col(f"`{group}`").alias("_i_g")).agg(*parts)
    shrink = 5.0
    totals = profile.agg(*[F.sum(f"`{c}|{i}`").alias(f"{c}|{i}") for c in categorical for i in range(len(levels[c]))], *[F.sum(f"`{c}|n`").alias(f"{c}|n") for c in categorical]).first() if categorical else {}
    share = {(c, i): ((totals[f"{c}|{i}"] or 0.0) / max(totals[f"{c}|n"] or 0, 1)) for c in categorical for i in range(len(levels[c]))}
    vector = [F.coalesce(F.col(f"`{c}|m`"), F.lit(0.0)) / (F.col(f"`{c}|n`") + shrink) for c in numeric]
    vector += [(F.coalesce(F.col(f"`{c}|{i}`"), F.lit(0.0)) + shrink * share[c, i]) / (F.col(f"`{c}|n`") + shrink) for c in categorical for i in range(len(levels[c]))]
    profile = profile.select("_i_g", F.array(*vector).cast("array<double>").alias("_i_profile"))

    plan = _Plan(list(numeric), list(categorical), location, levels, numeric, draw)
    codes = [*[z[c].alias(f"_n_{j}") for j, c in enumerate(numeric)], *[_code(c, levels[c]).cast("double").alias(f"_n_{len(numeric) + j}") for j, c in enumerate(categorical)]]
    rows = clean.join(profile, F.col(f"`{group}`").eqNullSafe(F.col("_i_g")), "left").select("_i_row", "_i_hash", "_i_profile", *codes)
    # few rows make few tasks: a pass over them is short, and starting a task is not
    state = durable(rows.coalesce(max(1, -(-first["n"] // ROWS_A_TASK))).mapInPandas(plan.start, plan.schema), "coded")
    # fields that lack nothing are never redrawn, so they need no fit; a field without any value has none
    open_fields = [c for c in fields if 0 < first[f"{c}|k"] < first["n"]]
    for r in range(rounds if open_fields else 0):
        fits: dict[str, tuple[np.ndarray, float]] = {}
        for c in open_fields:
            fits[c] = _fit(state, plan, c, fits, r)
        state = durable(state.mapInPandas(plan.replayed(fits, r), plan.schema), "coded", state)

    back = [F.when(F.lit(first[f"{c}|k"] > 0), F.greatest(F.least(F.col(f"_v_{j}") * location[c][1] + location[c][0], F.lit(float(numeric[c][1]))), F.lit(float(numeric[c][0])))).alias(f"_f_{c}") for j, c in enumerate(numeric)]
    back += [F.get(F.array(*[F.lit(v) for v in levels[c]]).cast("array<string>"), F.col(f"_v_{len(numeric) + j}").cast("int")).alias(f"_f_{c}") for j, c in enumerate(categorical)]
    done = clean.join(state.select(F.col("_i_row").alias("_r"), *back), F.col("_i_row") == F.col("_r"))
    value = {c: F.coalesce(F.col(f"_i_{c}"), F.col(f"_f_{c}")).alias(c) for c in fields}
    return done.select(*[value[c] if c in fields else F.col(f"`{c}`") for c in df.columns], *[F.col(f"_i_{c}").isNull().alias(f"{c}_filled") for c in fields])


def _code(c: str, levels: list[str]) -> Column:
    """Number of the level; null for a gap."""
    code = F.array_position(F.array(*[F.lit(v) for v in levels]).cast("array<string>"), F.col(f"_i_{c}")).cast("int") - 1
    return F.when(F.col(f"_i_{c}").isNotNull(), code)


class _Plan:
    """Layout of the coded rows (a value and a mark of presence per field) and of the predictors: intercept, numbers, levels of all categories, group profile."""

    def __init__(self, numeric, categorical, location, levels, ranges, draw):
        self.numeric, self.categorical, self.levels, self.draw = numeric, categorical, levels, draw
        self.fields = [*numeric, *categorical]
        self.low = [(ranges[c][0] - location[c][0]) / location[c][1] for c in numeric]
        self.high = [(ranges[c][1] - location[c][0]) / location[c][1] for c in numeric]
        self.at, k = {}, 1
        for c in numeric:
            self.at[c] = slice(k, k + 1)
            k += 1
        for c in categorical:
            self.at[c] = slice(k, k + len(levels[c]))
            k += len(levels[c])
        self.depth = len(numeric) + sum(len(levels[c]) for c in categorical)
        self.width = k + self.depth
        n = range(len(self.fields))
        self.schema = ", ".join(["_i_row long", "_i_hash long", "_i_profile array<double>", *[f"_v_{j} double" for j in n], *[f"_h_{j} boolean" for j in n]])

    def start(self, batches):
        """Coded rows whose gaps hold the mean or the commonest level of their group."""
        for pdf in batches:
            out, prof, k = pdf[["_i_row", "_i_hash", "_i_profile"]].copy(), self.profile(pdf), len(self.numeric)
            for j, c in enumerate(self.fields):
                v = pdf[f"_n_{j}"].to_numpy(dtype=float, na_value=np.nan)
                if c in self.numeric:
                    first = prof[:, j]
                else:
                    m = len(self.levels[c])
                    first = prof[:, k : k + m].argmax(1) if m else np.full(len(pdf), -1)
                    k += m
                out[f"_v_{j}"], out[f"_h_{j}"] = np.where(np.isfinite(v), v, first), np.isfinite(v)
            yield out[[x.split()[0] for x in self.schema.split(", ")]]

    def profile(self, pdf: pd.DataFrame) -> np.ndarray:
        return np.concatenate(pdf["_i_profile"].to_numpy()).reshape(len(pdf), self.depth) if len(pdf) and self.depth else np.zeros((len(pdf), self.depth))

    def values(self, pdf: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
        n = range(len(self.fields))
        return [pdf[f"_v_{j}"].to_numpy(dtype=float) for j in n], [pdf[f"_h_{j}"].to_numpy(dtype=bool) for j in n]

    def design(self, values: list[np.ndarray], prof: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(prof), 1)), *[v[:, None] for v in values[: len(self.numeric)]]]
        for j, c in enumerate(self.categorical):
            parts.append((values[len(self.numeric) + j][:, None] == np.arange(len(self.levels[c]))).astype(float))
        return np.hstack([*parts, prof])

    def others(self, c: str) -> np.ndarray:
        keep = np.ones(self.width, bool)
        keep[self.at[c]] = False
        return keep

    def apply(self, values: list[np.ndarray], had: list[np.ndarray], prof: np.ndarray, h: np.ndarray, fits: dict, r: int) -> None:
        """Redraw, one after the other, the gaps of the fields in fits."""
        for c, (beta, sd) in fits.items():
            j = self.fields.index(c)
            gap = ~had[j]
            if not gap.any() or beta is None:
                continue
            p = self.design([v[gap] for v in values], prof[gap])[:, self.others(c)] @ beta
            u, v = _uniform(h[gap], 2 * (r * 997 + j)), _uniform(h[gap], 2 * (r * 997 + j) + 1)
            if c in self.numeric:
                noise = sd * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v) if self.draw else 0.0
                values[j][gap] = np.clip(p[:, 0] + noise, self.low[j], self.high[j])
            else:
                q = np.clip(p, 1e-6, None)
                q = (q / q.sum(1, keepdims=True)).cumsum(1)
                values[j][gap] = np.minimum((u[:, None] > q).sum(1), q.shape[1] - 1) if self.draw else p.argmax(1)

    def replayed(self, fits: dict, r: int):
        def run(batches):
            for pdf in batches:
                values, had = self.values(pdf)
                values = [v.copy() for v in values]
                self.apply(values, had, self.profile(pdf), pdf["_i_hash"].to_numpy(dtype=np.int64).view(np.uint64), fits, r)
                yield pdf.assign(**{f"_v_{j}": v for j, v in enumerate(values)})

        return run


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    x = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2**-54


def _fit(state: DataFrame, plan: _Plan, c: str, fits: dict, r: int) -> tuple[np.ndarray | None, float]:
    """Coefficients and residual scale of field c on the rows that have it, the fields in fits being redrawn first."""
    k, before = plan.fields.index(c), dict(fits)

    def gram(batches):
        total = np.zeros((plan.width, plan.width))
        for pdf in batches:
            values, had = plan.values(pdf)
            if not had[k].any():
                continue
            values, prof = [v.copy() for v in values], plan.profile(pdf)
            plan.apply(values, had, prof, pdf["_i_hash"].to_numpy(dtype=np.int64).view(np.uint64), before, r)
            x = plan.design([v[had[k]] for v in values], prof[had[k]])
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pd.DataFrame({"at": (i * plan.width + j).astype("int32"), "v": total[i, j]})

    sums = state.mapInPandas(gram, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    g = np.zeros(plan.width * plan.width)
    g[sums["at"].to_numpy()] = sums["v"].to_numpy()
    g = g.reshape(plan.width, plan.width)
    n = g[0, 0]
    if n < 2:
        return None, 0.0
    keep, y = plan.others(c), plan.at[c]
    a = g[np.ix_(keep, keep)] + np.diag(np.full(keep.sum(), 1e-3 * n / 100 + 1e-6))
    b = g[keep][:, y]
    beta = np.linalg.solve(a, b)
    ss = g[y, y] - 2 * beta.T @ b + beta.T @ g[np.ix_(keep, keep)] @ beta
    return beta, float(np.sqrt(max(ss[0, 0], 0) / max(n - 1, 1))) if c in plan.numeric else 0.0


def masked_errors(df: DataFrame, numeric: dict[str, tuple[float, float]], categorical: Sequence[str], group: str, row_id: str, share: float = 0.1, seed: int = 17) -> DataFrame:
    """How well known cells are found again: (field, n, drawn_error, fitted_error, group_error).

    A `share` of the usable cells of every field (by a hash of row and field) is hidden and filled. Errors
    are root mean squares of numbers and shares of wrong levels: of the drawn values, of
    the fitted ones without a draw, and of the group's mean or commonest level of the cells
    that were not hidden (of all rows in groups without any).
    """
    known = {c: usable_number(c, *numeric[c]) for c in numeric} | {c: usable_text(c) for c in categorical}
    base = durable(df.select(F.col(f"`{row_id}`").alias("_id"), F.col(f"`{group}`").alias("_group"), *[known[c].alias(c) for c in known]).dropDuplicates(["_id"]), "masked")
    hidden = {c: F.pmod(F.xxhash64(F.lit(seed), F.lit(c), F.col("_id")), F.lit(1000)) < int(share * 1000) for c in known}
    open_ = base.select("_id", "_group", *[F.when(~hidden[c], F.col(c)).alias(c) for c in known])
    out = base
    for name, draw in (("d", True), ("f", False)):
        filled = impute_chained(open_, numeric, categorical, "_group", "_id", draw=draw)
        out = out.join(filled.select("_id", *[F.col(c).alias(f"_{name}_{c}") for c in known]), "_id")
    plain = lambda c: F.avg(c) if c in numeric else F.mode(c)
    groups = open_.groupBy("_group").agg(*[plain(c).alias(f"_g_{c}") for c in known]).withColumnRenamed("_group", "_gg")
    whole = open_.agg(*[plain(c).alias(f"_w_{c}") for c in known]).first()
    out = out.join(groups, F.col("_group").eqNullSafe(F.col("_gg")), "left")
    cells = []
    for c in known:
        guess = {"drawn": F.col(f"_d_{c}"), "fitted": F.col(f"_f_{c}"), "group": F.coalesce(F.col(f"_g_{c}"), F.lit(whole[f"_w_{c}"]))}
        wrong = {k: (F.pow(v - F.col(c), 2) if c in numeric else (v != F.col(c)).cast("double")) for k, v in guess.items()}
        cells.append(F.when(hidden[c] & F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), F.lit(c in numeric).alias("number"), *[v.alias(k) for k, v in wrong.items()])))
    long = out.select(F.explode(F.array(*cells)).alias("x")).where("x is not null").select("x.*")
    root = lambda k: F.when(F.first("number"), F.sqrt(F.avg(k))).otherwise(F.avg(k)).alias(f"{k}_error")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), root("drawn"), root("fitted"), root("group"))
