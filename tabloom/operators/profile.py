"""Profiles: the semantic kind and statistics of every column, from one frequency table.

The frame is turned into (name, value, ord) rows and aggregated by name and value; that table holds all that a profile
needs, so no column costs a job of its own and no exact distinct count expands the input.  ``ord`` is the row's number
in file order: a frame's ``_row_id``, or any key column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scalars import DATE, TIME, col, is_number, to_double
from tabloom.plans.ordering import _bucketed

#: Limits and name patterns that decide kinds.
SNIFFED, LOW, LISTED, TOKENS = 200, 12, 100, 100
DATE_NAME = r"(?i)(yyyy-mm-dd|date)"
ID_NAME = r"(?i)(^id$|_id$|patient id|identifier)"
MEASURE_NAME = r"(?i)(age|bmi|weight|height|duration|time|length|stay|score|dose|volume|fluid|blood|days?|nights?|kg|cm|ml)"


@dataclass
class ColumnProfile:
    name: str
    kind: str
    nullable: bool
    unique_count: int
    missing_rate: float
    numeric_like: bool
    low_cardinality: bool
    id_like: bool
    min_value: float | None
    max_value: float | None
    allowed_values: list[str]
    mixed_value_kind: str | None
    mixed_token_values: list[str]


@dataclass
class Schema:
    """The profile on the driver: a row a column, in file order."""

    columns: list[ColumnProfile]
    row_count: int = 0
    types: dict[str, str] = field(default_factory=dict)

    @property
    def order(self) -> list[str]:
        return [c.name for c in self.columns]

    def get(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    def of_kind(self, *kinds: str) -> list[str]:
        return [c.name for c in self.columns if c.kind in kinds]

    @property
    def mixed(self) -> list[str]:
        return [c.name for c in self.columns if c.mixed_value_kind]

    @property
    def modeled(self) -> list[str]:
        return [c.name for c in self.columns if c.kind != "constant"]

    def to_dict(self) -> dict:
        return {"columns": [asdict(c) for c in self.columns], "row_count": self.row_count, "types": self.types}

    @classmethod
    def from_dict(cls, data: dict) -> Schema:
        return cls([ColumnProfile(**c) for c in data["columns"]], data["row_count"], data.get("types", {}))


def long_form(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """(name, pos, value, ord): a row a cell, values as text."""
    cells = [F.struct(F.lit(c).alias("name"), F.lit(i).alias("pos"), col(c).cast("string").alias("value")) for i, c in enumerate(columns)]
    return df.select(F.explode(F.array(*cells)).alias("c"), col(order).cast("long").alias("ord")).select("c.*", "ord")


def frequencies(cells: DataFrame) -> DataFrame:
    """(name, pos, value, n, first): how often each value occurs, and where first; nulls are one value."""
    return cells.groupBy("name", "pos", "value").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def missing_mask(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select([col(c).isNull().alias(c) for c in columns])


def levels(table: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Non-null values in the order of their first appearance, as an array."""
    return table.where("value IS NOT NULL").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("first", "value")))["value"].alias("levels"))


def monotonic(cells: DataFrame) -> DataFrame:
    """(name, monotonic): whether all values are numbers that never fall in file order; tested inside ranges of rows in
    parallel, then between neighbouring ranges."""
    real = cells.where("value IS NOT NULL").select("name", "ord", to_double(F.col("value")).alias("v"))
    cut = _bucketed(real, F.col("ord"), ["name"], 256)
    inside = Window.partitionBy("name", "__bucket").orderBy("ord")
    steps = cut.withColumn("ok", F.col("v").isNotNull() & F.coalesce(F.col("v") >= F.lag("v").over(inside), F.lit(True)))
    ends = steps.groupBy("name", "__bucket").agg(F.bool_and("ok").alias("ok"), F.min_by("v", "ord").alias("a"), F.max_by("v", "ord").alias("z"))
    across = Window.partitionBy("name").orderBy("__bucket")
    return ends.withColumn("ok", F.col("ok") & F.coalesce(F.col("a") >= F.lag("z").over(across), F.lit(True))).groupBy("name").agg(F.bool_and("ok").alias("monotonic"))


def sniffed(cells: DataFrame) -> DataFrame:
    """(name, dates, times): shares of the first SNIFFED values that look like dates and times of day."""
    first = Window.partitionBy("name").orderBy("ord")
    head = cells.where("value IS NOT NULL").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= SNIFFED)
    share = lambda pattern: F.avg(F.col("value").rlike(pattern).cast("double"))
    return head.groupBy("name").agg(share(DATE).alias("dates"), share(TIME).alias("times"))


def profile(df: DataFrame, order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A row a column: position, kind and statistics."""
    columns = list(columns or df.columns)
    cells = long_form(df, order, columns)
    table = frequencies(cells)
    number, real = to_double(F.col("value")), F.col("value").isNotNull()
    spells = is_number(F.col("value"))
    stats = table.groupBy("name", "pos").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("present"),
        F.count_if(real).alias("unique_count"),
        F.coalesce(F.sum(F.when(spells, F.col("n"))), F.lit(0)).alias("numeric"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
    )
    listed = levels(table.join(F.broadcast(stats.select("name", "unique_count")), "name").where(F.col("unique_count") <= LISTED))
    first = Window.partitionBy("name").orderBy("first")
    tokens = table.where(real & ~spells).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= TOKENS)
    tokens = levels(tokens).withColumnRenamed("levels", "tokens")
    ready = stats.join(monotonic(cells), "name", "left").join(sniffed(cells), "name", "left").join(listed, "name", "left").join(tokens, "name", "left")

    ratio = F.when(F.col("present") > 0, F.col("numeric") / F.col("present")).otherwise(F.lit(0.0))
    unique, share = F.col("unique_count"), F.col("unique_count") / F.greatest(F.col("rows"), F.lit(1))
    has_tokens = (F.col("numeric") > 0) & (F.col("numeric") < F.col("present"))
    id_like = (F.col("present") > 0) & ((share >= 0.98) | F.coalesce("monotonic", F.lit(False)) | F.col("name").rlike(ID_NAME))
    numeric_like = (ratio >= 0.80) | ((ratio >= 0.50) & (unique >= 10))
    two = unique <= 2
    kind = (
        F.when(unique <= 1, "constant")
        .when(F.col("name").rlike(DATE_NAME) | (F.col("dates") >= 0.95), "datetime")
        .when(F.col("times") >= 0.95, "time")
        .when(id_like, "id_like")
        .when(has_tokens, F.when(two, "binary").otherwise("categorical"))
        .when(numeric_like, F.when(two, "binary").otherwise("numeric"))
        .otherwise(F.when(two, "binary").otherwise("categorical"))
    )
    mixed = F.when(has_tokens & ((ratio >= 0.50) | ((ratio >= 0.20) & (unique >= 10) & F.col("name").rlike(MEASURE_NAME))), "numeric")
    found = ready.withColumn("kind", kind).withColumn("mixed_value_kind", mixed)
    is_numeric, none = F.col("kind") == "numeric", F.array().cast("array<string>")
    return found.select(
        "pos",
        "name",
        "kind",
        (F.col("present") < F.col("rows")).alias("nullable"),
        "unique_count",
        ((F.col("rows") - F.col("present")) / F.greatest(F.col("rows"), F.lit(1))).alias("missing_rate"),
        numeric_like.alias("numeric_like"),
        unique.between(1, LOW).alias("low_cardinality"),
        id_like.alias("id_like"),
        F.when(is_numeric, F.col("low") + 0.0).alias("min_value"),
        F.when(is_numeric, F.col("high") + 0.0).alias("max_value"),
        F.when(F.col("kind").isin("categorical", "binary", "id_like") & (unique <= LISTED), F.coalesce("levels", none)).otherwise(none).alias("allowed_values"),
        "mixed_value_kind",
        F.when(F.col("mixed_value_kind").isNotNull(), F.coalesce("tokens", none)).otherwise(none).alias("mixed_token_values"),
        F.col("rows").alias("row_count"),
    )


def infer_schema(df: DataFrame, order: str, columns: Sequence[str] | None = None) -> Schema:
    """The profile collected: a row a column reaches the driver."""
    columns = list(columns or [c for c in df.columns if c != order])
    rows = sorted(profile(df, order, columns).collect(), key=lambda r: r.pos)
    types = dict(df.dtypes)
    if not rows:  # an empty frame has no cells
        return Schema([ColumnProfile(c, "constant", False, 0, 0.0, False, False, False, None, None, [], None, []) for c in columns], 0, {c: types[c] for c in columns})
    names = ColumnProfile.__dataclass_fields__
    return Schema([ColumnProfile(**{k: r[k] for k in names}) for r in rows], rows[0].row_count, {c: types[c] for c in columns})


def looks_like(name: str, pattern: str) -> bool:
    return re.search(pattern, name) is not None


def low_cardinality(df: DataFrame, order: str, columns: Sequence[str], most: int = LOW) -> DataFrame:
    """(name, unique_count) of columns with 1 to ``most`` values."""
    found = frequencies(long_form(df, order, columns)).groupBy("name").agg(F.count_if(F.col("value").isNotNull()).alias("unique_count"))
    return found.where(F.col("unique_count").between(1, most))


def distinct_rows(df: DataFrame, order: str) -> DataFrame:
    """One row of each set of equal rows: the one with the least ``order``."""
    rest = [c for c in df.columns if c != order]
    return df.groupBy(*[col(c) for c in rest]).agg(F.min(col(order)).alias(order)).select(df.columns)


def duplicate_flag(columns: Sequence[str], order: str) -> Column:
    """Whether an equal row comes earlier."""
    return F.row_number().over(Window.partitionBy(*[col(c) for c in columns]).orderBy(col(order))) > 1
