"""Row-wise stages on streams: masks, repair and copies of source rows need no state, so they run on a stream as they do on
a table.  Rates over event-time windows use a watermark; late rows are dropped behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.operators import privacy, rules


def repair_stream(stream: DataFrame, constraints: rules.Constraints) -> DataFrame:
    """Clip, normalise, blank and recompute each row; rows that stay invalid go."""
    return rules.repair(stream, constraints)


def unmatched_stream(stream: DataFrame, real: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that equal no row of a static source table: a null-safe left anti join of a stream and a table."""
    return privacy.without_matches(stream, real, columns)


def invalid_rates(stream: DataFrame, constraints: rules.Constraints, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, rows, invalid) by event time."""
    masked = stream.withColumn("__bad", rules.invalid(constraints, stream.columns))
    return masked.withWatermark(time, late).groupBy(F.window(time, width).alias("window")).agg(F.count("*").alias("rows"), F.count_if("__bad").alias("invalid"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything available now, written as Parquet with exactly-once bookkeeping in the checkpoint."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
