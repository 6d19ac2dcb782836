"""Where queries and their SQL are kept, and the fixtures derived from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixtures: the same expressions in both languages.  Nulls, tokens and wrong values are put in by rule, since the tables
# have none.

PART_MIXED = "p_partkey, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'Unknown' WHEN p_partkey % 17 = 0 THEN CAST(p_size AS STRING) || '.0' ELSE CAST(p_size AS STRING) END AS size_text, p_brand, p_retailprice + 0.0 AS p_retailprice"
PART_MIXED_SQL = f"SELECT {PART_MIXED.replace('STRING', 'VARCHAR')} FROM part"
BLANK = "o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'No' WHEN o_orderstatus = 'P' THEN NULL ELSE 'Yes' END AS parent, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS child, CASE WHEN o_orderkey % 5 = 0 THEN 'No data' ELSE o_orderstatus END AS other"
BLANK_SQL = f"SELECT {BLANK} FROM orders"
CHARGE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 0.0 AS l_quantity, l_extendedprice + 0.0 AS l_extendedprice, l_discount + 0.0 AS l_discount, l_returnflag, l_linestatus, CASE WHEN l_linenumber = 3 THEN l_extendedprice * 1.5 WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS charge, CASE WHEN l_returnflag = 'A' THEN 'F' ELSE l_linestatus END AS expected_status"
CHARGE_SQL = f"SELECT {CHARGE} FROM lineitem"


def part_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_items(PART_MIXED))


def orders_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_items(BLANK))


def lineitem_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_items(CHARGE))


def _items(select: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(select + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[at:i])
            at = i + 1
    return out


def orders_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date, a number of nights, and the date after them: 5 days off at each 17th, missing at each 19th."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate")).withColumn("nights", (F.col("o_orderkey") % 30).cast("int"))
    shift = F.when(F.col("o_orderkey") % 17 == 0, F.col("nights") + 5).otherwise(F.col("nights"))
    target = F.when(F.col("o_orderkey") % 19 != 0, F.date_format(F.date_add("d", shift), "yyyy-MM-dd"))
    nights = F.when(F.col("o_orderkey") % 7 != 0, F.col("nights").cast("string"))
    return o.select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("base"), nights.alias("nights"), target.alias("target"))


OFFSET_SQL = """SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') AS base, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 30 AS VARCHAR) END AS nights,
  CASE WHEN o_orderkey % 19 <> 0 THEN strftime(o_orderdate::DATE + CAST(o_orderkey % 30 + CASE WHEN o_orderkey % 17 = 0 THEN 5 ELSE 0 END AS INTEGER), '%Y-%m-%d') END AS target FROM orders"""


def halves(spark: SparkSession, sf_dir: str, columns: str = "o_orderkey, o_orderpriority, o_orderstatus") -> tuple[DataFrame, DataFrame]:
    """Orders with even keys as the source, with odd ones as synthetic rows."""
    o = table(spark, sf_dir, "orders").selectExpr(*_items(columns), "o_orderkey % 2 AS odd")
    return o.where("odd = 0").drop("odd"), o.where("odd = 1").drop("odd")
