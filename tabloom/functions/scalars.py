"""Scalar functions as Column expressions; everything stays in generated JVM code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__MISSING__"
PRESENT = "__PRESENT__"
VALUE = "__VALUE__"

#: The spellings that a CSV reader takes for a missing cell.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
TIME = r"^\d{2}:\d{2}$"


def col(name: str) -> Column:
    """A column by its literal name: dots, colons and brackets are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def to_double(c: Column) -> Column:
    """The finite number that a cell spells, else null."""
    text = c.cast("string")
    value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def is_number(c: Column) -> Column:
    return F.coalesce(to_double(c).isNotNull(), F.lit(False))


def strip(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def na_to_null(c: Column) -> Column:
    """Null for a missing cell in any of its spellings."""
    return F.when(~c.isin(*NA_TOKENS), c)


def half_even(c: Column) -> Column:
    """Rounded to the nearest whole number, halves to the even one, never -0.0."""
    return F.rint(c) + F.lit(0.0)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def to_date(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.rlike(DATE), F.try_to_date(text, "yyyy-MM-dd"))


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def offset_date(base: Column, days: Column) -> Column:
    """The date, as text, that lies a rounded number of days after a date; null if either is null."""
    return date_text(F.date_add(to_date(base), half_even(to_double(days)).cast("int")))


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of a date in text, as a double."""
    return F.unix_date(to_date(c)).cast("double") * 86400.0


def epoch_to_date(c: Column) -> Column:
    """The date of seconds since 1970, as text."""
    return date_text(F.date_from_unix_date(F.floor(c / 86400.0).cast("int")))


def day_difference(a: Column, b: Column) -> Column:
    return (epoch_seconds(a) - epoch_seconds(b)) / 86400.0


def hhmm_seconds(c: Column) -> Column:
    """Seconds of an HH:MM text; null without a colon."""
    parts = F.split(c.cast("string"), ":")
    return to_double(F.get(parts, F.lit(0))) * 3600.0 + to_double(F.get(parts, F.lit(1))) * 60.0


def seconds_hhmm(c: Column) -> Column:
    """HH:MM of seconds; hours are held in 0..23 and minutes in 0..59."""
    whole = half_even(c)
    hours = clip(F.floor(whole / 3600.0).cast("double"), 0, 23).cast("int")
    minutes = clip(F.floor((whole - F.floor(whole / 3600.0) * 3600.0) / 60.0).cast("double"), 0, 59).cast("int")
    return F.when(c.isNotNull(), F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0")))


def bmi(weight: Column, height_cm: Column) -> Column:
    """Weight over squared height in metres; null for a height of 0."""
    return F.try_divide(to_double(weight), F.pow(to_double(height_cm) / 100.0, 2.0))


def squash(c: Column) -> Column:
    return c / (c + 1.0)


def normalised(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def missingness(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(MISSING)).otherwise(F.lit(PRESENT))


def row_key(columns: Sequence[str]) -> Column:
    """The cells of a row, printed and joined by bars, with a token for null."""
    return F.concat_ws("|", *[normalised(col(c)) for c in columns])


def level_code(c: Column, levels: Sequence) -> Column:
    """The place of a value in a list from 0; -1 if it isn't there, null stays null."""
    if not levels:
        return F.when(c.isNotNull(), F.lit(-1.0))
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), c) - 1
    return F.when(c.isNotNull(), place.cast("double"))


def level_value(code: Column, levels: Sequence) -> Column:
    """The level at a rounded code; null outside the list."""
    if not levels:
        return F.lit(None).cast("string")
    at = half_even(code).cast("int")
    return F.when((at >= 0) & (at < len(levels)), F.get(F.array(*[F.lit(v) for v in levels]), at))


def snap(c: Column, support: Sequence[float]) -> Column:
    """The nearest of the support's values, the lower on ties."""
    if not support:
        return c
    near = F.transform(F.array(*[F.lit(float(v)) for v in sorted(support)]), lambda x: F.struct(F.abs(c - x).alias("d"), x.alias("v")))
    return F.when(c.isNotNull(), F.array_min(near)["v"])


def pick_interval(u: Column, upper: Sequence[float], values: Sequence) -> Column:
    """The value whose cumulative interval holds u: the first with u below its upper bound, else the last."""
    last = len(values) - 1
    found = F.lit(values[last])
    for bound, value in zip(reversed(upper[:last]), reversed(values[:last])):
        found = F.when(u < float(bound), F.lit(value)).otherwise(found)
    return F.when(u.isNotNull(), found)


def scaled_quota(count: Column, total: Column, target: Column) -> Column:
    """A count scaled to a target, between 1 and the target; 0 where any of the three is."""
    scaled = half_even(count / F.nullif(total.cast("double"), F.lit(0.0)) * target).cast("long")
    some = (count > 0) & (total > 0) & (target > 0)
    return F.when(some, F.greatest(F.lit(1).cast("long"), F.least(target.cast("long"), scaled))).otherwise(F.lit(0).cast("long"))
