"""Privacy of synthetic rows: exact copies, duplicates, distance to the nearest source row.

Exact matches are null-safe joins on typed columns.  Distances go to at most MAX_ROWS source rows, a bounded sample by
seeded hash, so the matrix that workers hold has a proven bound; every synthetic row is compared with it in Arrow
batches by one matrix product.  Where all source rows count, they go to the workers in blocks of that size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import col, row_key, squash
from tabloom.operators.encode import for_distance
from tabloom.operators.profile import Schema, distinct_rows

#: Fixed value: source rows that distances are taken to.
MAX_ROWS = 2000


def hash_sample(df: DataFrame, order: str, rows: int, seed: int = 42) -> DataFrame:
    """An exact number of rows, the first by a seeded hash of their numbers."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), col(order).cast("string"))), col(order)).limit(rows)


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in columns:
        same = same & a[f"`{c}`"].eqNullSafe(b[f"`{c}`"])
    return same


def without_matches(syn: DataFrame, real: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Synthetic rows that equal no source row; nulls equal each other."""
    known = real.select([col(c).alias(f"__r{i}") for i, c in enumerate(columns)])
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & col(c).eqNullSafe(F.col(f"__r{i}"))
    return syn.join(known, same, "left_anti")


def without_keys(syn: DataFrame, real: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same on printed cells joined by bars."""
    keys = real.select(row_key(columns).alias("__key")).distinct()
    return syn.withColumn("__key", row_key(columns)).join(keys, "__key", "left_anti").select(syn.columns)


def exact_match_rate(syn: DataFrame, real: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the share of synthetic rows that equal a source row."""
    rest = without_matches(syn, real, columns).agg(F.count("*").alias("rest"))
    return syn.agg(F.count("*").alias("n")).crossJoin(rest).select(F.coalesce((F.col("n") - F.col("rest")) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("exact_match_rate"))


def duplicate_rate(syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the share of rows that repeat an earlier one."""
    sizes = syn.groupBy(*[col(c) for c in columns]).agg(F.count("*").alias("n"))
    got = sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("kinds"))
    return got.select(F.coalesce((F.col("rows") - F.col("kinds")) / F.nullif(F.col("rows"), F.lit(0)), F.lit(0.0)).alias("duplicate_rate"))


def _least(keys: pd.Series, vectors: pd.Series, ids: np.ndarray, matrix: np.ndarray, other: bool) -> np.ndarray:
    """The distance of each vector to the nearest row of the matrix, NaN without one; with ``other`` not to that of its key."""
    out = np.full(len(keys), np.nan)
    for at in range(0, len(keys) if len(ids) else 0, 256):
        rows = np.stack(vectors.iloc[at : at + 256].to_numpy()).astype(np.float64)
        square = (rows * rows).sum(1)[:, None] + (matrix * matrix).sum(1) - 2 * rows @ matrix.T
        if other:
            square[keys.iloc[at : at + 256].to_numpy()[:, None] == ids] = np.inf
        best = square.argmin(1)
        gap = rows - matrix[best]  # the product only ranks; the distance is taken directly
        found = np.sqrt((gap * gap).sum(1))
        out[at : at + len(rows)] = np.where(np.isinf(square[np.arange(len(rows)), best]), np.nan, found)
    return out


def nearest(queries: DataFrame, key: str, vector: str, source: Sequence[tuple[int, Sequence[float]]], other: bool = False) -> DataFrame:
    """(key, distance): the Euclidean distance of each array column to the nearest source vector; with ``other`` the
    source vector with the same key doesn't count.  The source is a list of at most MAX_ROWS (key, vector)."""
    ids = np.array([k for k, _ in source], np.int64)
    matrix = np.array([v for _, v in source], np.float64).reshape(len(source), -1)
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "distance": _least(batch[key], batch[vector], ids, matrix, other)})

    rows = queries.select(col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    return rows.mapInPandas(run, f"`{key}` long, distance double").withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))


def nearest_of_all(queries: DataFrame, key: str, vector: str, source: DataFrame, other: bool = False) -> DataFrame:
    """The same for a source frame of any size with these columns and unique keys on both sides: every block of some
    MAX_ROWS source rows meets every block of some MAX_ROWS queries in a worker."""
    columns = [col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)]
    asked, known = queries.select(columns), source.select(columns)
    n, m = (1 + df.count() // MAX_ROWS for df in (asked, known))
    asked = asked.withColumn("__a", F.pmod(F.xxhash64(col(key)), F.lit(n))).withColumn("__b", F.explode(F.expr(f"sequence(0L, {m - 1}L)")))
    known = known.withColumn("__b", F.pmod(F.xxhash64(col(key)), F.lit(m))).withColumn("__a", F.explode(F.expr(f"sequence(0L, {n - 1}L)")))

    def run(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(theirs[vector].to_numpy()).astype(np.float64) if len(theirs) else np.zeros((0, 0))
        return pd.DataFrame({key: ours[key], "distance": _least(ours[key], ours[vector], theirs[key].to_numpy(), matrix, other)})

    met = asked.groupBy("__a", "__b").cogroup(known.groupBy("__a", "__b")).applyInPandas(run, f"`{key}` long, distance double")
    return met.groupBy(col(key)).agg(F.min(F.nanvl("distance", F.lit(None).cast("double"))).alias("distance"))


def summary(distances: DataFrame) -> DataFrame:
    """One row: mean, median and 5 % quantile (0 without rows)."""
    d = F.col("distance")
    found = {"mean_distance": F.avg(d), "median_distance": F.median(d), "p05_distance": F.percentile(d, 0.05)}
    return distances.agg(*[F.coalesce(e, F.lit(0.0)).alias(name) for name, e in found.items()])


def _vectors(df: DataFrame, names: Sequence[str]) -> Column:
    return F.array(*[F.col(n) for n in names]) if names else F.array().cast("array<double>")


def _collected(df: DataFrame, order: str) -> list[tuple[int, list[float]]]:
    return [(r[0], r[1]) for r in df.select(col(order).cast("long"), "vector").collect()]


def real_distances(real: DataFrame, schema: Schema, order: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(order, distance) of a sample of source rows to the nearest other one."""
    flat, features = for_distance(hash_sample(real, order, max_rows), schema, order)
    vectors = flat.select(col(order), _vectors(flat, [f"f{i}" for i in range(len(features))]).alias("vector"))
    return nearest(vectors, order, "vector", _collected(vectors, order), other=True)


def source_distances(real: DataFrame, syn: DataFrame, schema: Schema, order: str, max_rows: int = MAX_ROWS, syn_rows: int | None = MAX_ROWS) -> DataFrame:
    """(order, distance) of synthetic rows (all, or a sample) to the nearest of a sample of source rows, encoded together."""
    columns = [order, *schema.order]
    ours = hash_sample(syn, order, syn_rows) if syn_rows else syn
    both = hash_sample(real, order, max_rows).select(columns).withColumn("__real", F.lit(True)).unionByName(ours.select(columns).withColumn("__real", F.lit(False)))
    flat, features = for_distance(both, schema, order, keep=["__real"])
    vectors = flat.select(col(order), "__real", _vectors(flat, [f"f{i}" for i in range(len(features))]).alias("vector"))
    return nearest(vectors.where("NOT __real"), order, "vector", _collected(vectors.where("__real"), order))


def threshold(distances: DataFrame, least: float = 0.0, quantile: float | None = None) -> DataFrame:
    """One row: the greater of a distance and a quantile of the source rows' own distances; a quantile of none or 0 is off."""
    if quantile is None or quantile <= 0:
        return distances.sparkSession.range(1).select(F.lit(float(least)).alias("min_distance"))
    q = F.coalesce(F.percentile("distance", min(1.0, quantile)), F.lit(0.0))
    return distances.agg(F.greatest(F.lit(float(least)), q).alias("min_distance"))


def privacy_score(exact: Column, duplicates: Column, median: Column) -> Column:
    score = (1.0 - exact) * (1.0 - duplicates) * squash(median)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def filter_violations(real: DataFrame, syn: DataFrame, schema: Schema, order: str, least: float = 0.0, quantile: float | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Synthetic rows without duplicates, without copies of source rows, and without rows too near to one."""
    kept = without_matches(distinct_rows(syn, order), real, schema.order)
    bound = least
    if quantile is not None and quantile > 0:
        bound = threshold(real_distances(real, schema, order, max_rows), least, quantile).first()[0]
    if bound <= 0:
        return kept
    far = source_distances(real, kept, schema, order, max_rows, None).where(F.col("distance") >= bound)
    return kept.join(far.select(order), order, "left_semi")
