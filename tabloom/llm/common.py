"""What the operators of this package share: table access and the folder that all executors see."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.session import checkpoint, shared_dir, ship  # noqa: F401  the operators' own names for them

#: What empties a worker's caches, by the code that fills them.
CACHES: dict[str, Callable[[], object]] = {}


def turn(name: str = "") -> None:
    """At the start of a worker's task: the caches of all other code are emptied, else they stay beside what the task needs."""
    for other, clear in CACHES.items():
        if other != name:
            clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a compressed table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """The frame as a table in the shared folder, laid out by the key: joins by it read the table without dealing it out again."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.bucketBy(parts, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)
