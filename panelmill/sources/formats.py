"""Readers of published file formats, into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Russian month names in the nominative case.
MONTHS = ["январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь"]


def read_semicolon_csv(spark: SparkSession, path: str, numbers: list[str], level: str | None = None, contains: str | None = None) -> DataFrame:
    """CSV with ';' and a header, all text but `numbers`, which are null where they are no numbers (comma or point); rows whose `level` has the text `contains`."""
    df = spark.read.option("sep", ";").option("header", True).csv(path)
    df = df.where(F.col(level).contains(contains)) if level and contains else df
    return df.withColumns({c: decimal(F.col(c)) for c in numbers})


def decimal(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def read_api_json(spark: SparkSession, path: str) -> DataFrame:
    """(month, value...) of a JSON object with `fields` (names) and `data` (rows of texts); field `period` is a UTC instant that is shifted by three hours."""
    raw = spark.read.option("multiLine", True).schema("fields array<string>, data array<array<string>>").json(path)
    rows = raw.select("fields", F.explode("data").alias("r")).select(F.map_from_arrays("fields", "r").alias("m"))
    names = raw.select("fields").first()[0]
    month = F.date_format(F.try_to_timestamp(F.element_at("m", F.lit("period"))) + F.expr("interval 3 hours"), "yyyy-MM")
    return rows.select(month.alias("month"), *[F.element_at("m", F.lit(n)).try_cast("double").alias(n) for n in names if n != "period"])


def read_series_xml(spark: SparkSession, path: str) -> DataFrame:
    """(region, period, value) of SDMX-like XML: Series with a region attribute and Obs with time and value (decimal comma)."""
    schema = "_region string, Obs array<struct<_time: string, _value: string>>"
    rows = spark.read.format("xml").option("rowTag", "Series").schema(schema).load(path)
    return rows.select(F.col("_region").alias("region"), F.explode("Obs").alias("o")).select("region", F.col("o._time").alias("period"), decimal(F.col("o._value")).alias("value"))


def russian_month(name: Column, year: Column) -> Column:
    """'YYYY-MM' of a Russian month name and a year; null for another name."""
    k = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.trim(name)))
    return F.when(k > 0, F.format_string("%04d-%02d", year.cast("int"), k.cast("int")))


def sheet_month(sheet: Column) -> Column:
    """'YYYY-MM' of a sheet name 'MM(YYYY)', else null."""
    p = r"^(0[1-9]|1[0-2])\((\d{4})\)$"
    return F.when(sheet.rlike(p), F.concat_ws("-", F.regexp_extract(sheet, p, 2), F.regexp_extract(sheet, p, 1)))


def markdown(df: DataFrame, columns: list[str], rows: int = 50) -> str:
    """A report table of the first rows (a top report: the limit is the feature)."""
    head = [f"| {' | '.join(columns)} |", f"|{'|'.join('---' for _ in columns)}|"]
    return "\n".join(head + [f"| {' | '.join('' if r[c] is None else str(r[c]) for c in columns)} |" for r in df.select(*columns).limit(rows).collect()])
