"""Registering a query together with its SQL twin, doubles rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS, NUDGE = 6, 3.1e-9  # the nudge keeps exact halves, as in means of two, on one side in both engines


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`") + NUDGE, DIGITS) + 0.0).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


class Registry:
    """queries and oracle: name -> function and name -> SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None, floats: str = "") -> Callable:
        def register(f):
            @wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return rounded(f(spark, sf_dir))

            self.queries[f.__name__] = run
            if sql:
                cols = ", ".join(f'round("{c}" + {NUDGE}, {DIGITS}) + 0.0 AS "{c}"' for c in floats.split())
                self.oracle[f.__name__] = f"SELECT * {f'REPLACE ({cols})' if cols else ''} FROM ({sql}) AS result"
            return f

        return register
