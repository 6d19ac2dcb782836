"""Validation of synthetic tables: format, plausibility, similarity of distributions, and a composite score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import bmi, col, to_double
from tabloom.operators.conform import is_numeric
from tabloom.operators.copula import correlation
from tabloom.plans.ordering import running

#: The weights of the composite score, and the clinical columns and their bounds.
WEIGHTS = {"marginal": 0.30, "dependency": 0.30, "discriminator": 0.20, "privacy": 0.15, "logic": 0.05}
AGE, WEIGHT, HEIGHT, BMI, GENDER = "Age::40", "Preoperative body weight (kg)::20", "Height (cm)::23", "BMI::24", "Gender::5"
AGES, BMI_TOLERANCE, BMI_SHARE, GENDERS = (18, 110), 2.0, 0.90, ("Male", "Female", "Unknown")


def check_columns(real: DataFrame, syn: DataFrame) -> list[str]:
    """Errors of the number of columns (which ends the check) and of names by position."""
    ours, theirs = syn.columns, real.columns
    if len(ours) != len(theirs):
        errors = [f"Column count differs: expected {len(theirs)}, got {len(ours)}"]
        missing, extra = sorted(set(theirs) - set(ours)), sorted(set(ours) - set(theirs))
        errors += [f"Missing columns: {missing}"] if missing else []
        return errors + ([f"Extra columns: {extra}"] if extra else [])
    return [f"Column {i}: expected '{a}', got '{b}'" for i, (a, b) in enumerate(zip(theirs, ours)) if a != b]


def check_types(real: DataFrame, syn: DataFrame) -> list[str]:
    kinds = dict(syn.dtypes)
    found = []
    for name, kind in real.dtypes:
        if name in kinds and kinds[name] != kind and not (is_numeric(kind) and is_numeric(kinds[name])):
            found.append(f"Column '{name}': expected type {kind}, got {kinds[name]}")
    return found


def check_format(real: DataFrame, syn: DataFrame, early: bool = True) -> list[str]:
    """Errors of columns, types and the number of rows; with ``early`` a wrong number of columns is all that is told."""
    errors = check_columns(real, syn)
    if early and len(real.columns) != len(syn.columns):
        return errors
    if not early and errors:
        errors = ["Column names or their order differ from the source."]
    n, m = real.count(), syn.count()
    return errors + check_types(real, syn) + ([f"Too few rows: expected at least {n}, got {m}"] if m < n else [])


def plausible_range(c: Column, low: float, high: float) -> Column:
    """Whether all numbers lie in a range; null without a number."""
    return F.bool_and(to_double(c).between(low, high))


def plausible_ratio(weight: Column, height: Column, actual: Column, tolerance: float = BMI_TOLERANCE, share: float = BMI_SHARE) -> Column:
    """Whether more than a share of rows with all three numbers is near weight over squared height; null without such."""
    usable = (to_double(height) > 0) & to_double(weight).isNotNull() & to_double(actual).isNotNull()
    return F.avg(F.when(usable, (F.abs(to_double(actual) - bmi(weight, height)) < tolerance).cast("double"))) > share


def plausible_values(c: Column, values: Sequence[str]) -> Column:
    """Whether every cell is one of the values; null is not."""
    return F.bool_and(F.coalesce(c.isin(*values), F.lit(False)))


def sanity(df: DataFrame) -> dict[str, bool]:
    """The clinical checks that the table has columns for."""
    there, checks = set(df.columns), {}
    if AGE in there:
        checks["Age Within Range (18-110)"] = plausible_range(col(AGE), *AGES)
    if {WEIGHT, HEIGHT, BMI} <= there:
        checks["BMI-Weight-Height Logic"] = plausible_ratio(col(WEIGHT), col(HEIGHT), col(BMI))
    if GENDER in there:
        checks["Valid Gender Categories"] = plausible_values(col(GENDER), GENDERS)
    if not checks:
        return {}
    row = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(checks.values())]).first()
    return {name: v for name, v in zip(checks, row) if v is not None}


def ks_similarity(pairs: DataFrame) -> DataFrame:
    """(name, similarity) from (name, value, is_real) rows: 1 less the greatest gap between the two distribution functions,
    to 3 digits; null without real numbers.  Running sums over distinct values are taken in two levels."""
    counts = pairs.where("value IS NOT NULL").groupBy("name", "value").agg(F.count_if("is_real").alias("r"), F.count_if(~F.col("is_real")).alias("s"))
    both = running(running(counts, "value", F.col("r"), "cr", ["name"]), "value", F.col("s"), "cs", ["name"])
    totals = counts.groupBy("name").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))
    gap = F.abs(F.col("cr") / F.nullif(F.col("tr"), F.lit(0)) - F.coalesce(F.col("cs") / F.nullif(F.col("ts"), F.lit(0)), F.lit(0.0)))
    found = both.join(F.broadcast(totals), "name").groupBy("name").agg(F.round(1.0 - F.max(gap), 3).alias("similarity"))
    return pairs.select("name").distinct().join(found, "name", "left")


def numeric_pairs(real: DataFrame, syn: DataFrame) -> DataFrame:
    """(name, value, is_real) of the columns that both frames have."""
    shared = sorted(set(real.columns) & set(syn.columns))

    def long(df: DataFrame, flag: bool) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("name"), to_double(col(c)).alias("value")) for c in shared]
        return df.select(F.explode(F.array(*cells)).alias("c"), F.lit(flag).alias("is_real")).select("c.*", "is_real")

    return long(real, True).unionByName(long(syn, False))


def changes(before: DataFrame, after: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """One row: cells and rows that differ, nulls equal to each other."""
    other = after.select(col(order).alias("__ord"), *[col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    differ = [(~col(c).eqNullSafe(F.col(f"__c{i}"))).cast("long") for i, c in enumerate(columns)]
    cells, some = differ[0], differ[0]
    for d in differ[1:]:
        cells, some = cells + d, F.greatest(some, d)
    return before.join(other, col(order) == F.col("__ord")).agg(F.sum(cells).alias("cells"), F.sum(some).alias("rows"))


def marginal_score(real: DataFrame, syn: DataFrame) -> float:
    """The mean similarity of numeric columns (our definition; the weights alone are given)."""
    got = ks_similarity(numeric_pairs(real, syn)).agg(F.avg("similarity")).first()[0]
    return 0.0 if got is None else float(got)


def dependency_score(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> float:
    """1 less half the mean absolute difference of the correlations of numeric columns (our definition)."""
    import numpy as np

    if len(columns) < 2:
        return 1.0
    as_numbers = lambda df: df.select([F.coalesce(to_double(col(c)), F.lit(0.0)).alias(c) for c in columns])
    a, b = np.nan_to_num(correlation(as_numbers(real), columns)), np.nan_to_num(correlation(as_numbers(syn), columns))
    upper = np.triu_indices(len(columns), 1)
    return float(1.0 - np.abs(a - b)[upper].mean() / 2.0)


def discriminator_score(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> float:
    """1 less how far a logistic regression tells the two tables apart: 1 at an area of 0.5 under its curve (our definition)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    if not columns:
        return 1.0
    as_numbers = lambda df, y: df.select([F.coalesce(to_double(col(c)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)] + [F.lit(y).alias("label")])
    rows = VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="features").transform(as_numbers(real, 1.0).unionByName(as_numbers(syn, 0.0)))
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(rows)
    area = BinaryClassificationEvaluator().evaluate(model.transform(rows))
    return float(1.0 - 2.0 * abs(area - 0.5))


def total_score(parts: dict[str, float], weights: dict[str, float] | None = None) -> float:
    weights = WEIGHTS | (weights or {})
    return sum(weights[k] * parts.get(k, 0.0) for k in WEIGHTS)


def top_adjustments(summary: DataFrame, rows: int = 15) -> DataFrame:
    """The adjustments that blanked most rows."""
    return summary.orderBy(F.desc("blanked_rows"), "parent", "child").limit(rows)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(col(order)).limit(n)


