"""Column functions that all operators share: numbers, months, names, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: str | Column) -> Column:
    """The number, or null for null, NaN and infinite ones."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def array_median(a: str | Column) -> Column:
    """Median of an array of numbers; null for an empty one."""
    s, n = F.sort_array(F.col(a) if isinstance(a, str) else a), F.size(a)
    return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2)


def month_number(text: Column) -> Column:
    """Month ordinal (12 * year + month - 1) of 'YYYY-MM' or 'MM.YYYY'; null for anything else or a month outside 1..12."""
    t = F.trim(text)
    iso, dot = F.regexp_extract(t, r"^(\d{4})-(\d{2})$", 0) != "", F.regexp_extract(t, r"^(\d{2})\.(\d{4})$", 0) != ""
    y = F.when(iso, F.substring(t, 1, 4)).when(dot, F.substring(t, 4, 4)).cast("int")
    m = F.when(iso, F.substring(t, 6, 2)).when(dot, F.substring(t, 1, 2)).cast("int")
    return F.when(m.between(1, 12), y * 12 + m - 1)


def month_text(ordinal: Column) -> Column:
    """'YYYY-MM' of a month ordinal."""
    return F.format_string("%04d-%02d", F.floor(ordinal / 12).cast("int"), (ordinal % 12 + 1).cast("int"))


def plain_text(c: Column) -> Column:
    """Lower case with е for ё."""
    return F.translate(F.lower(c), "ё", "е")


def normalised_name(c: Column) -> Column:
    """Key for names: lower case, ё as е, letters only, twelve of them."""
    return F.substring(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"[^a-zа-я]", ""), 1, 12)


def host_name(c: Column) -> Column:
    """Host in lower case without leading www. and then m."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^www\.", ""), r"^m\.", "")


def hash_share(path: Column) -> Column:
    """The 128-bit md5 of a text modulo 10000: a stable draw for sampling."""
    half = lambda a: F.conv(F.substring(F.md5(path), a, 16), 16, 10).cast("decimal(20,0)")
    return ((half(1) % 10_000 * (2**64 % 10_000) + half(17) % 10_000) % 10_000).cast("int")
