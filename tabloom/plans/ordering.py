"""Global order without a single task: numbering and running sums in two levels.

A window without PARTITION BY moves all rows to one task.  Here rows are cut into BUCKETS buckets of about as many rows each,
at approximate quantiles of the ordering number, so an outlier or a skewed distribution doesn't fill one bucket (rows of one
same number stay together); a bucket's total comes from an aggregate that combines before the shuffle, the totals' running sum is
taken over at most BUCKETS rows (a group), and inside a bucket a window runs in parallel.  The quantiles are checkpointed:
approximate ones may differ when they are taken again, and every reader must see the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import checkpoint

BUCKETS = 1024
#: Quantiles of at most so many groups are broadcast (8 KB a group).
GROUPS = 1000


def _bucketed(df: DataFrame, order: Column, by: Sequence[str], buckets: int) -> DataFrame:
    """df with ``__bucket``, how many quantiles are below the number (null is in bucket 0), by a binary search whose steps are
    columns of their own."""
    steps = [1 << k for k in reversed(range((buckets - 1).bit_length()))]
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = checkpoint(df.groupBy(*by).agg(F.sort_array(F.percentile_approx(order.cast("double"), shares, 10_000)).alias("__bounds")))
    sent = F.broadcast(bounds) if not by or bounds.count() <= GROUPS else bounds
    joined = df.join(sent, list(by)) if by else df.crossJoin(sent)
    joined = joined.withColumn("__bucket", F.lit(0))
    for step in steps:
        bound = F.get("__bounds", F.col("__bucket") + F.lit(step - 1))
        joined = joined.withColumn("__bucket", F.when(bound < order.cast("double"), F.col("__bucket") + step).otherwise(F.col("__bucket")))
    return joined.drop("__bounds")


def running(df: DataFrame, order: str, measure: Column, name: str, by: Sequence[str] = (), buckets: int = BUCKETS, ties: Sequence[str] = ()) -> DataFrame:
    """df with the running sum of ``measure`` in ascending ``order`` (a number, with ``ties`` after it), within ``by``."""
    cut = _bucketed(df.withColumn("__measure", measure), F.col(f"`{order}`"), by, buckets)
    keys = [*by, "__bucket"]
    totals = cut.groupBy(*keys).agg(F.sum("__measure").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.join(offsets if by else F.broadcast(offsets), keys)
    return joined.withColumn(name, F.col("__before") + F.sum("__measure").over(inside)).drop("__measure", "__bucket", "__before")


def numbered(df: DataFrame, order: str, name: str = "rn", by: Sequence[str] = (), buckets: int = BUCKETS, ties: Sequence[str] = ()) -> DataFrame:
    """df with the number from 1 of each row in ascending ``order`` (a number; ties must be broken by ``ties``)."""
    return running(df, order, F.lit(1).cast("long"), name, by, buckets, ties)


def spread(count: Column, total: Column, position: Column) -> Column:
    """Whether a position from 0 is among ``count`` positions spread evenly over 0..total-1, ends included: all
    if there are no more, and the first alone for one.  The step is a double made first, as linspace makes it."""
    step = (total - 1).cast("double") / F.nullif((count - 1).cast("double"), F.lit(0.0))
    near = F.floor(position.cast("double") / step).cast("long")

    def hit(k: Column) -> Column:
        return (k >= 0) & (k < count - 1) & (F.floor(k.cast("double") * step).cast("long") == position)

    many = hit(near) | hit(near + 1) | hit(near - 1) | (position == total - 1)
    return F.when(count <= 0, False).when(count >= total, True).when(count == 1, position == 0).otherwise(F.coalesce(many, F.lit(False)))


def spread_sql(count: str, total: str, position: str) -> str:
    step = f"(({total} - 1)::DOUBLE / nullif(({count} - 1)::DOUBLE, 0))"
    near = f"floor({position}::DOUBLE / {step})::BIGINT"
    hits = " OR ".join(f"(({near} + {d}) >= 0 AND ({near} + {d}) < {count} - 1 AND floor(({near} + {d})::DOUBLE * {step})::BIGINT = {position})" for d in (-1, 0, 1))
    return f"(CASE WHEN {count} <= 0 THEN false WHEN {count} >= {total} THEN true WHEN {count} = 1 THEN {position} = 0 ELSE coalesce({hits} OR {position} = {total} - 1, false) END)"
