"""Columns that mix numbers with tokens: split into a value and a state, snapped to observed values, restored."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scalars import MISSING, VALUE, col, epoch_seconds, epoch_to_date, hhmm_seconds, seconds_hhmm, snap, strip, to_double

#: Fixed value: supports of more distinct numbers are not kept.
SUPPORT = 64


@dataclass
class MixedEncoding:
    name: str
    kind: str = "numeric"
    support: list[float] = field(default_factory=list)
    spellings: list[str] = field(default_factory=list)

    @property
    def value_column(self) -> str:
        return f"{self.name}__value"

    @property
    def state_column(self) -> str:
        return f"{self.name}__state"


def as_number(c: Column, kind: str) -> Column:
    """A cell as a number by kind: dates and times of day as seconds."""
    return epoch_seconds(c) if kind == "datetime" else hhmm_seconds(c) if kind == "time" else to_double(c)


def from_number(c: Column, kind: str) -> Column:
    return epoch_to_date(c) if kind == "datetime" else seconds_hhmm(c) if kind == "time" else c.cast("string")


def state(c: Column, kind: str = "numeric") -> Column:
    """MISSING, VALUE, or the stripped token."""
    return F.when(c.isNull(), MISSING).when(as_number(c, kind).isNotNull(), VALUE).otherwise(strip(c))


def split(df: DataFrame, encoding: MixedEncoding) -> DataFrame:
    """df with the value and state columns of a mixed column."""
    c = col(encoding.name)
    return df.withColumns({encoding.value_column: as_number(c, encoding.kind), encoding.state_column: state(c, encoding.kind)})


def spellings(df: DataFrame, name: str) -> DataFrame:
    """(number, spelling): each number's most frequent spelling, the first in order on ties."""
    real = df.select(strip(col(name)).alias("spelling"), to_double(col(name)).alias("number")).where("number IS NOT NULL")
    counts = real.groupBy("number", "spelling").agg(F.count("*").alias("n"))
    best = Window.partitionBy("number").orderBy(F.desc("n"), "spelling")
    return counts.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("number", "spelling")


def fit(df: DataFrame, name: str, kind: str = "numeric", most: int = SUPPORT) -> MixedEncoding:
    """The encoding with the observed numbers and spellings, if there are at most ``most``."""
    encoding = MixedEncoding(name, kind)
    if kind == "numeric":
        rows = spellings(df, name).limit(most + 1).collect()
        if len(rows) <= most:
            rows = sorted(rows, key=lambda r: r.number)
            encoding.support, encoding.spellings = [r.number for r in rows], [r.spelling for r in rows]
    return encoding


def support(df: DataFrame, name: str, most: int = SUPPORT) -> list[float]:
    """The sorted distinct numbers of a column, or nothing if there are more than ``most``."""
    rows = df.select(to_double(col(name)).alias("v")).where("v IS NOT NULL").distinct().limit(most + 1).collect()
    return sorted(r.v for r in rows) if len(rows) <= most else []


def spelled(c: Column, numbers: Sequence[float], texts: Sequence[str]) -> Column:
    """A number as the spelling of the nearest observed number."""
    if not numbers:
        return c.cast("string")
    near = snap(c, numbers)
    found = F.lit(None).cast("string")
    for number, text in zip(numbers, texts):
        found = F.when(near == F.lit(float(number)), F.lit(text)).otherwise(found)
    return found


def restore(value: Column, state_of: Column, encoding: MixedEncoding) -> Column:
    """The cell that a value and a state make."""
    if encoding.kind == "numeric":
        text = spelled(value, encoding.support, encoding.spellings)
    else:
        text = from_number(value, encoding.kind)
    return F.when(state_of == MISSING, F.lit(None).cast("string")).when(state_of == VALUE, text).otherwise(state_of)


