"""Conforming synthetic rows to the source's schema: order, types, and tokens in the source's proportion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scalars import col, is_number, to_double
from tabloom.operators.profile import Schema
from tabloom.plans.ordering import numbered, running, spread
from tabloom.session import checkpoint

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_numeric(kind: str) -> bool:
    return kind.startswith(NUMERIC)


def reindex(df: DataFrame, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """The columns in order; absent ones are null, others go."""
    there = set(df.columns)
    return df.select([col(c).alias(c) if c in there else F.lit(None).cast((types or {}).get(c, "string")).alias(c) for c in columns])


def apportion(counts: DataFrame, places: Column, order: str = "first") -> DataFrame:
    """counts (value, n, first) with ``share``: ``places`` dealt out in proportion by largest remainders, the earlier value
    on ties.  The frame holds a row a distinct value."""
    total = F.sum("n").over(Window.partitionBy())
    raw = F.col("n").cast("double") / total.cast("double") * places
    base = F.floor(raw)
    rest = (places - F.sum(base).over(Window.partitionBy())).cast("long")
    based = counts.withColumn("__raw", raw).withColumn("__base", base).withColumn("__rest", rest)
    place = F.row_number().over(Window.orderBy(F.desc(F.col("__raw") - F.col("__base")), order))
    share = F.col("__base").cast("long") + F.when(place <= F.col("__rest"), 1).otherwise(0)
    return based.withColumn("share", share.cast("long")).drop("__raw", "__base", "__rest")


def _dealt(shares: DataFrame, order: str = "first") -> DataFrame:
    """(value, low, high): each value's places, numbered from 1."""
    return running(shares, order, F.col("share"), "high").select(F.col("value").alias("__v"), (F.col("high") - F.col("share")).alias("__low"), F.col("high").alias("__high"))


def fill_places(df: DataFrame, order: str, name: str, candidate: Column, tier: Column, count: int, counts: DataFrame) -> DataFrame:
    """``count`` of the candidates, evenly spread over them by tier and row order, get values dealt out as in ``counts``."""
    if count <= 0:
        return df
    marked = df.withColumn("__cand", candidate).withColumn("__tier", tier)
    by_tier = numbered(marked, order, "__in", by=["__cand", "__tier"])
    sizes = marked.where("__cand").groupBy("__tier").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__tier").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__tier", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__total"))
    placed = by_tier.join(F.broadcast(offsets), "__tier", "left").crossJoin(F.broadcast(total))
    position = F.col("__off") + F.col("__in") - 1
    picked = F.col("__cand") & spread(F.lit(count), F.col("__total"), position)
    placed = placed.withColumn("__pick", F.coalesce(picked, F.lit(False))).withColumn("__pos", F.coalesce(position, F.lit(-1)))
    nth = numbered(placed, "__pos", "__nth", by=["__pick"])
    dealt = _dealt(apportion(counts, F.least(F.lit(count), F.lit(count))))
    joined = nth.join(F.broadcast(dealt), F.col("__pick") & (F.col("__nth") > F.col("__low")) & (F.col("__nth") <= F.col("__high")), "left")
    return joined.withColumn(name, F.when(F.col("__pick") & F.col("__v").isNotNull(), F.col("__v")).otherwise(col(name))).select(df.columns)


def value_counts(df: DataFrame, name: str, order: str, only: Column | None = None) -> DataFrame:
    """(value, n, first) of non-null cells."""
    rows = df.where(col(name).isNotNull() & (F.lit(True) if only is None else only))
    return rows.groupBy(col(name).cast("string").alias("value")).agg(F.count("*").alias("n"), F.min(col(order)).alias("first"))


def quota(observed: int, total: int, target: int) -> int:
    if observed <= 0 or total <= 0 or target <= 0:
        return 0
    return max(1, min(target, round(observed / total * target)))


def coerce_text(df: DataFrame, real: DataFrame, name: str, order: str, mixed: bool) -> DataFrame:
    """A text column brought in line with the source's: a column that lost all its values gets the most frequent one in its
    first row (mixed columns: their share of observed values), and a mixed column gets its share of tokens back, first in
    nulls, then in numbers, then anywhere."""
    c = col(name)
    token = c.isNotNull() & ~is_number(c)
    ours = df.agg(F.count("*").alias("n"), F.count(c).alias("k"), F.count_if(token).alias("t")).first()
    theirs = real.agg(F.count("*").alias("n"), F.count(c).alias("k"), F.count_if(token).alias("t"), F.mode(c.cast("string"), True).alias("mode")).first()
    if not theirs.k or not ours.n:
        return df
    if not mixed:
        if ours.k:
            return df
        first = df.agg(F.min(col(order)).alias("__first"))
        return df.crossJoin(F.broadcast(first)).withColumn(name, F.when(col(order) == F.col("__first"), F.lit(theirs.mode)).otherwise(c)).select(df.columns)
    if not ours.k:
        return fill_places(df, order, name, F.lit(True), F.lit(0), quota(theirs.k, theirs.n, ours.n), value_counts(real, name, order))
    deficit = quota(theirs.t, theirs.n, ours.n) - ours.t if theirs.t else 0
    nulls, numbers = ours.n - ours.k, ours.k - ours.t
    tier = F.when(c.isNull(), 0).when(is_number(c), 1).otherwise(2)
    most = 0 if nulls >= deficit else 1 if nulls + numbers >= deficit else 2
    return fill_places(df, order, name, tier <= most, tier, deficit, value_counts(real, name, order, token))


def conform(df: DataFrame, real: DataFrame, schema: Schema, order: str) -> DataFrame:
    """df with the source's columns in order and numbers where it has numbers; text columns by :func:`coerce_text`."""
    out = reindex(df, [order, *schema.order], schema.types | {order: "bigint"})
    for c in schema.columns:
        if is_numeric(schema.types.get(c.name, "string")):
            out = out.withColumn(c.name, to_double(col(c.name)))
        else:
            done = coerce_text(out, real, c.name, order, bool(c.mixed_value_kind))
            out = out if done is out else checkpoint(done)
    return out.select(order, *[col(c) for c in schema.order])


