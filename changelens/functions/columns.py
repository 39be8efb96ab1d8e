"""Column expressions that the operators share; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes and rules beyond so many are looked up instead of tried one by one.
LONG_LIST = 100
CHANGES = "rev string, author string, date string, entity string, added long, deleted long"
FILE_DIFFS = (
    "rev string, path string, symbols_new array<struct<name: string, start_line: long, end_line: long>>, "
    "symbols_old array<struct<name: string, start_line: long, end_line: long>>, "
    "hunks array<struct<old_start: long, old_count: long, new_start: long, new_count: long>>"
)


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it; nothing lies under ''."""
    return (path == prefix) | path.startswith(prefix + "/") if prefix else F.lit(False)


def ancestors(path: Column) -> Column:
    """The path and all that it is below: as many as it has parts."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def under_any(path: Column, prefixes: list[str]) -> Column:
    """Whether a path lies under one of the prefixes. Of a long list they are looked up in
    a set by ancestor, so no row meets every prefix."""
    if len(prefixes) > LONG_LIST:
        known = [p for p in prefixes if p]
        return F.coalesce(F.exists(ancestors(path), lambda a: a.isin(known)), F.lit(False))
    return reduce(lambda a, b: a | b, (under(path, p) for p in prefixes), F.lit(False))


def logical_rev(period: str | None) -> Column:
    """The commit of a row; by day, all commits of one author on one date are one."""
    return F.concat(F.lit("day:"), "date", F.lit(":"), "author") if period == "day" else F.col("rev")


def percent(part: Column, whole: Column) -> Column:
    """part * 100 / whole, and 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * F.lit(100.0) / F.nullif(whole, F.lit(0)))


def cell(x: Column) -> Column:
    """Two fraction digits of the exact binary value, ties to even."""
    return F.call_function("format_number", x, F.lit("0.00"))


def is_rust(path: Column) -> Column:
    """Whether the path's extension is rs, in any case; a bare ``.rs`` has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)) == "rs"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def valid_date(text: Column) -> Column:
    """Whether a text is a day of the calendar; parts needn't be padded."""
    number = r"([0-9]{1,9})"
    whole = F.when(text.rlike(f"^{number}-{number}-{number}$"), F.split(text, "-"))

    def known(part: Column) -> Column:
        year, month, day = (F.get(part, F.lit(k)) for k in range(3))
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
        return F.coalesce(month.between(1, 12) & (day >= 1) & (day <= days), F.lit(False))

    return let(F.transform(whole, lambda p: p.try_cast("int")), known)


def day_number(text: Column) -> Column:
    """A valid date text as a date, for differences in days."""
    part = [F.regexp_extract(text, r"^([0-9]+)-([0-9]+)-([0-9]+)$", k).cast("int") for k in (1, 2, 3)]
    return F.make_date(*part)


def hunks(diff: Column) -> Column:
    """The (old_start, old_count, new_start, new_count) of each hunk header of a diff."""
    pattern = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"

    def number(x: Column, k: int, missing: int | None = None) -> Column:
        found = F.regexp_extract(x, pattern, k)
        return F.when(found == "", F.lit(missing)).otherwise(F.nullif(found, F.lit(""))).cast("long")

    return F.transform(
        F.regexp_extract_all(diff, F.lit(pattern), F.lit(0)),
        lambda x: F.struct(number(x, 1).alias("old_start"), number(x, 2, 1).alias("old_count"), number(x, 3).alias("new_start"), number(x, 4, 1).alias("new_count")),
    )
