"""Selection of target rows from candidates: the first ones, or those that balance the source's distributions."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import normal
from tabloom.functions.scalars import col, missingness, normalised
from tabloom.operators import mixed
from tabloom.operators.profile import LOW, Schema
from tabloom.plans.ordering import numbered

MISSINGNESS_WEIGHT = 0.35
DEFICIT_BIAS = 1.5


def features(schema: Schema, most: int = LOW, missing_weight: float = MISSINGNESS_WEIGHT) -> list[tuple[str, Column, float, bool]]:
    """(name, value, weight, protected): states of mixed columns, values of columns of few values, else missingness."""
    out = []
    for c in schema.columns:
        if c.mixed_value_kind:
            out.append((f"{c.name}__state", mixed.state(col(c.name), c.mixed_value_kind), 1.0, True))
        elif c.kind in ("categorical", "binary", "id_like") and c.unique_count <= most:
            out.append((c.name, normalised(col(c.name)), 1.0, True))
        elif missing_weight > 0 and 0 < c.missing_rate < 1:
            out.append((f"{c.name}__missing", missingness(col(c.name)), missing_weight, False))
    return out


def long_features(df: DataFrame, order: str, found: list[tuple[str, Column, float, bool]]) -> DataFrame:
    """(ord, feature, value, weight, protected): a row a feature of a row."""
    cells = [F.struct(F.lit(n).alias("feature"), v.alias("value"), F.lit(w).alias("weight"), F.lit(p).alias("protected")) for n, v, w, p in found]
    return df.select(col(order).alias("ord"), F.explode(F.array(*cells)).alias("c")).select("ord", "c.*")


def value_scores(real: DataFrame, pool: DataFrame, bias: float = DEFICIT_BIAS) -> DataFrame:
    """(feature, value, real_share, pool_share, score): the weighted surplus of a value in the pool less its biased deficit;
    from two long frames, by a full outer join of their frequency tables."""

    def shares(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy("feature", "value").agg(F.count("*").alias("n"), F.max("weight").alias(f"w_{name}"))
        totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
        return counts.join(F.broadcast(totals), "feature").select("feature", "value", f"w_{name}", (F.col("n") / F.col("total")).alias(name), F.col("n").alias(f"n_{name}"))

    joined = shares(real, "real").join(shares(pool, "pool"), ["feature", "value"], "full_outer")
    r, p = F.coalesce("real", F.lit(0.0)), F.coalesce("pool", F.lit(0.0))
    weight = F.coalesce("w_pool", "w_real")
    surplus = F.when(p > 0, F.greatest(p - r, F.lit(0.0)) / p).otherwise(F.lit(0.0))
    deficit = F.when(r > 0, F.greatest(r - p, F.lit(0.0)) / r).otherwise(F.lit(0.0))
    return joined.select("feature", "value", r.alias("real_share"), p.alias("pool_share"), (weight * surplus - weight * bias * deficit).alias("score"), F.coalesce("n_pool", F.lit(0)).alias("n_pool"))


def row_scores(pool_long: DataFrame, scores: DataFrame, seed: int | None = 42) -> DataFrame:
    """(ord, score): the sum of a row's value scores; with a seed a jitter of 1e-9 standard deviations breaks ties."""
    joined = pool_long.join(scores.select("feature", "value", "score"), ["feature", "value"])
    total = joined.groupBy("ord").agg(F.sum("score").alias("score"))
    if seed is None:
        return total
    drawn = normal.drawn(total, {"__jitter": "__jitter"}, seed, "ord")
    return drawn.select("ord", (F.col("score") + F.col("__jitter") * 1e-9).alias("score"))


def balanced(pool: DataFrame, real: DataFrame, schema: Schema, order: str, rows: int, most: int = LOW, missing_weight: float = MISSINGNESS_WEIGHT, bias: float = DEFICIT_BIAS, seed: int | None = 42) -> DataFrame:
    """``rows`` of the pool: those of the highest scores go first, but never the last carrier of a protected value while
    others can go.  The drop is sequential, so it runs as one group, on the rows that matter alone: rows whose protected
    values all occur more often than the excess can't be a last carrier, and of them only the ``excess`` that would go
    first are needed."""
    found = features(schema, most, missing_weight)
    n = pool.count()
    if n <= rows or not found:
        return first_rows(pool, order, rows)
    excess = n - rows
    ours = long_features(pool, order, found)
    scores = value_scores(long_features(real, order, found), ours, bias)
    rank = row_scores(ours, scores, seed)
    marked = ours.where("protected").join(scores.select("feature", "value", "n_pool"), ["feature", "value"])
    carried = marked.groupBy("ord").agg(F.min("n_pool").alias("rarest"), F.collect_list(F.when(F.col("n_pool") <= excess + 1, F.struct("feature", "value", "n_pool"))).alias("rare"))
    ready = rank.join(carried, "ord", "left").withColumn("safe", F.coalesce(F.col("rarest") > excess + 1, F.lit(True)))
    first_safe = ready.where("safe").orderBy(F.desc("score"), "ord").limit(excess)
    needed = first_safe.unionByName(ready.where("NOT safe"))

    def drop(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "ord"], ascending=[False, True], kind="stable")
        left: dict[tuple, int] = {}
        gone, kept = [], []
        for row, rare in zip(group["ord"], group["rare"]):
            values = [((v["feature"], v["value"]), v["n_pool"]) for v in (rare if rare is not None else [])]
            if len(gone) < excess and all(left.get(k, count) > 1 for k, count in values):
                for k, count in values:
                    left[k] = left.get(k, count) - 1
                gone.append(row)
            else:
                kept.append(row)
        gone += kept[: excess - len(gone)]
        return pd.DataFrame({"ord": gone})

    dropped = needed.select("ord", "score", "rare").groupBy().applyInPandas(drop, "ord long")
    return pool.join(dropped, col(order) == F.col("ord"), "left_anti")


def first_rows(df: DataFrame, order: str, rows: int) -> DataFrame:
    """The first rows by a numeric order, in parallel, however many: a limit would gather them in one task."""
    return numbered(df, order, "__at").where(F.col("__at") <= rows).drop("__at")


def select_rows(pool: DataFrame, real: DataFrame, schema: Schema, order: str, rows: int, strategy: str = "head", **options) -> DataFrame:
    """``head``: the first rows in order; ``balanced``: see there; anything else is an error."""
    kind = (strategy or "head").lower()
    if kind == "head":
        return first_rows(pool, order, rows)
    if kind != "balanced":
        raise ValueError(f"Unknown selection strategy: {strategy}")
    return balanced(pool, real, schema, order, rows, **options)


def ranked(scores: DataFrame) -> DataFrame:
    """The place of each row in the order in which rows are dropped."""
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "ord")))


