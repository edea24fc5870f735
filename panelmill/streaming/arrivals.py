"""Late versions of readings as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_versions(stream: DataFrame, key: list[str], value: str, version: str, lateness: str = "90 days", period: str = "1 day") -> DataFrame:
    """Running table of the latest version of each key per period of arrival: key..., window, value.

    Exact repeats within the watermark are dropped. The state of a period is given up once
    the watermark has passed it; use output mode 'update' or 'append'.
    """
    seen = stream.withWatermark(version, lateness).dropDuplicatesWithinWatermark([*key, version, value])
    top = F.max(F.struct(F.col(version).alias("w"), F.col(value).alias("v")))
    return seen.groupBy(*key, F.window(version, period)).agg(top["v"].alias(value))
