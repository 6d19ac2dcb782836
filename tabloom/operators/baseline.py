"""The baseline synthesizer: independent columns, by bootstrap of observed cells or uniformly between their bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import normal
from tabloom.functions.scalars import col, half_even, to_double
from tabloom.operators.profile import Schema
from tabloom.plans.ordering import numbered


def bootstrap(df: DataFrame, name: str, order: str, rows: DataFrame, row: str, seed: int, value: str | None = None) -> DataFrame:
    """(row, value): a non-null observed cell for each row number, drawn with replacement: a uniform picks an ordinal, and
    the ordinal is joined."""
    real = numbered(df.where(col(name).isNotNull()).select(col(order).alias("__ord"), col(name).alias("__cell")), "__ord", "__rn")
    total = df.agg(F.count(col(name)).alias("__total"))
    drawn = rows.select(row).crossJoin(F.broadcast(total)).withColumn("__rn", F.floor(normal.uniform(seed, F.col(row), name) * F.col("__total")).cast("long") + 1)
    return drawn.join(real.select("__rn", "__cell"), "__rn", "left").select(row, F.col("__cell").alias(value or name))


class IndependentBaseline:
    """fit(df, schema, order, config) then sample(spark, rows); observed cells stay in the source frame."""

    name = "baseline"

    def __init__(self, seed: int = 42):
        self.seed = seed

    def fit(self, df: DataFrame, schema: Schema, order: str, config: dict | None = None) -> IndependentBaseline:
        self.df, self.schema, self.order = df, schema, order
        self.strategy = (config or {}).get("numeric_strategy", "bootstrap")
        numeric = [c.name for c in schema.columns if c.kind == "numeric"]
        whole = [F.coalesce(F.bool_and(to_double(col(c)) == F.rint(to_double(col(c)))), F.lit(False)).alias(f"w{i}") for i, c in enumerate(numeric)]
        got = df.agg(F.lit(1), *whole).first()
        self.whole = {c: got[f"w{i}"] for i, c in enumerate(numeric)}
        return self

    def sample(self, spark: SparkSession, rows: int, start: int = 0, order: str = "_row_id") -> DataFrame:
        made = spark.range(start, start + rows).withColumnRenamed("id", order)
        base = made
        for c in self.schema.columns:
            if c.kind == "numeric" and self.strategy == "uniform" and c.min_value is not None:
                value = F.lit(c.min_value) + normal.uniform(self.seed, F.col(order), c.name) * (c.max_value - c.min_value)
                made = made.withColumn(c.name, half_even(value) if self.whole[c.name] else value)
            else:
                made = made.join(bootstrap(self.df, c.name, self.order, base, order, self.seed), order)
            keep = normal.uniform(self.seed + 1, F.col(order), c.name) >= c.missing_rate
            made = made.withColumn(c.name, F.when(keep, col(c.name)))
        return made.select(order, *[col(c) for c in self.schema.order])

    def to_dict(self) -> dict:
        """All but the observed cells, which are stored as a table beside it."""
        return {"model": self.name, "seed": self.seed, "schema": self.schema.to_dict(), "order": self.order, "strategy": self.strategy, "whole": self.whole}

    @classmethod
    def from_dict(cls, data: dict, df: DataFrame) -> IndependentBaseline:
        model = cls(data["seed"])
        model.df, model.schema, model.order = df, Schema.from_dict(data["schema"]), data["order"]
        model.strategy, model.whole = data["strategy"], data["whole"]
        return model
