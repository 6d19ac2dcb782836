"""Feature encoding for models and distances: medians, level codes, one-hot flags, population scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import MISSING, col, level_code, level_value, to_double
from tabloom.operators import mixed
from tabloom.operators.profile import Schema, frequencies, levels, long_form


@dataclass
class Preprocessor:
    """What the encoder learned: fill values of numbers, levels of categories, by column."""

    schema: Schema
    fills: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    state_levels: dict[str, list[str]] = field(default_factory=dict)
    encodings: dict[str, mixed.MixedEncoding] = field(default_factory=dict)


def _number(c: Column, kind: str) -> Column:
    return mixed.as_number(c, kind if kind in ("datetime", "time") else "numeric")


def fit(df: DataFrame, schema: Schema, order: str) -> Preprocessor:
    """Medians by one aggregate, levels in the order of first appearance by one frequency table."""
    p = Preprocessor(schema)
    numbers = {c.name: c.kind for c in schema.columns if c.kind in ("numeric", "datetime", "time") and not c.mixed_value_kind}
    states = [c.name for c in schema.columns if c.mixed_value_kind]
    numbers |= {name: schema.get(name).mixed_value_kind for name in states}
    if numbers:
        got = df.agg(*[F.coalesce(F.median(_number(col(c), kind)), F.lit(0.0)).alias(f"m{i}") for i, (c, kind) in enumerate(numbers.items())]).first()
        p.fills = {c: got[f"m{i}"] for i, c in enumerate(numbers)}
    categories = [c.name for c in schema.columns if c.kind in ("categorical", "binary", "id_like") and not c.mixed_value_kind]
    wanted = df.select(col(order).alias("__ord"), *[col(c).cast("string").alias(c) for c in categories], *[mixed.state(col(c), schema.get(c).mixed_value_kind).alias(c) for c in states])
    if categories or states:
        rows = levels(frequencies(long_form(wanted, "__ord", [*categories, *states]))).collect()
        found = {r.name: r.levels for r in rows}
        p.levels = {c: found.get(c, []) for c in categories}
        p.state_levels = {c: found.get(c, []) for c in states}
    p.encodings = {c: mixed.MixedEncoding(c, schema.get(c).mixed_value_kind) for c in states}
    return p


def encoded(p: Preprocessor) -> dict[str, Column]:
    """Encoded columns by name: numbers with their fill, codes from 0 (-1 unseen, null for null)."""
    out: dict[str, Column] = {}
    for c in p.schema.columns:
        if c.mixed_value_kind:
            e = p.encodings[c.name]
            out[e.value_column] = F.coalesce(mixed.as_number(col(c.name), e.kind), F.lit(p.fills[c.name]))
            out[e.state_column] = level_code(mixed.state(col(c.name), e.kind), p.state_levels[c.name])
        elif c.kind in ("numeric", "datetime", "time"):
            out[c.name] = F.coalesce(_number(col(c.name), c.kind), F.lit(p.fills[c.name]))
        else:
            out[c.name] = level_code(col(c.name).cast("string"), p.levels.get(c.name, []))
    return out


def transform(df: DataFrame, p: Preprocessor, order: str) -> DataFrame:
    return df.select(col(order), *[e.alias(name) for name, e in encoded(p).items()])


def one_hot(p: Preprocessor) -> dict[str, Column]:
    """Numbers as they are, then one 0/1 column a level seen (MISSING is one)."""
    numbers, flags = {}, {}
    for c in p.schema.columns:
        if c.mixed_value_kind:
            e = p.encodings[c.name]
            numbers[e.value_column] = F.coalesce(mixed.as_number(col(c.name), e.kind), F.lit(p.fills[c.name]))
            for level in p.state_levels[c.name]:
                flags[f"{e.state_column}={level}"] = (mixed.state(col(c.name), e.kind) == F.lit(level)).cast("double")
        elif c.kind in ("numeric", "datetime", "time"):
            numbers[c.name] = F.coalesce(_number(col(c.name), c.kind), F.lit(p.fills[c.name]))
        else:
            text = F.coalesce(col(c.name).cast("string"), F.lit(MISSING))
            for level in [*p.levels.get(c.name, []), MISSING]:
                flags[f"{c.name}={level}"] = (text == F.lit(level)).cast("double")
    return numbers | flags


def decode(df: DataFrame, p: Preprocessor, order: str) -> DataFrame:
    """The columns that encoded ones stand for; numbers are not rounded, codes outside the levels become null."""
    out = []
    for c in p.schema.columns:
        if c.mixed_value_kind:
            e = p.encodings[c.name]
            out.append(mixed.restore(col(e.value_column), level_value(col(e.state_column), p.state_levels[c.name]), e).alias(c.name))
        elif c.kind in ("numeric", "datetime", "time"):
            made = col(c.name) if c.kind == "numeric" else mixed.from_number(col(c.name), c.kind)
            out.append(made.alias(c.name))
        else:
            out.append(level_value(col(c.name), p.levels.get(c.name, [])).alias(c.name))
    return df.select(col(order), *out)


def scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of 0 and 1 untouched (nulls as 0), others centred on the mean (nulls there) over the population's standard
    deviation unless it is next to nothing; all-null columns are 0.  One aggregate, whose row is joined to all."""
    stats = []
    for i, c in enumerate(columns):
        x = col(c)
        stats += [F.avg(x).alias(f"__m{i}"), F.stddev_pop(x).alias(f"__s{i}"), F.coalesce(F.bool_and(x.isin(0.0, 1.0)), F.lit(False)).alias(f"__b{i}")]
    joined = df.crossJoin(F.broadcast(df.agg(*stats)))
    out = {}
    for i, c in enumerate(columns):
        x, m, s = col(c), F.col(f"__m{i}"), F.col(f"__s{i}")
        centred = F.coalesce(x, m) - m
        out[c] = F.when(m.isNull(), 0.0).when(F.col(f"__b{i}"), F.coalesce(x, F.lit(0.0))).when(s > 1e-12, centred / s).otherwise(centred)
    return joined.withColumns(out).select(df.columns)


def for_distance(df: DataFrame, schema: Schema, order: str, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The scaled one-hot frame (order, kept columns, f0, f1, ...) and what the features stand for."""
    p = fit(df, schema, order)
    features = one_hot(p)
    flat = df.select(col(order), *[col(k) for k in keep], *[e.alias(f"f{i}") for i, e in enumerate(features.values())])
    names = [f"f{i}" for i in range(len(features))]
    return scaled(flat, names), list(features)


def to_number_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_double(col(c)) for c in columns})
