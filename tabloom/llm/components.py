"""Connected components of links.

Up to LOCAL links are joined in one task of bounded memory.  Beyond that, rounds of large-star and small-star run until
nothing changes; a round joins every link with the least neighbour of one end, which is one row a node, so a node with
very many links is a skewed side that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import checkpoint

#: Links that one task joins.
LOCAL = 200_000
#: Links of a partition.
PART = 20_000


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    names = [*parent]
    for at in range(0, len(names), PART):
        part = names[at : at + PART]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], ["node", "label"])


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, label): for each node of the links (a, b), which are ``most`` rows or fewer (None: counted first), the least node of its component."""
    most = links.count() if most is None else most
    links = checkpoint(links.where("a <> b").select("a", "b").distinct().coalesce(1 + most // PART))
    n, kind = links.count(), dict(links.dtypes)["a"]
    if n <= LOCAL:
        return links.coalesce(1).mapInArrow(_joined, f"node {kind}, label {kind}")
    links, seen = links.coalesce(1 + n // PART), None
    while True:
        links = checkpoint(_small(_large(links)).coalesce(1 + n // PART))
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    labelled = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labelled.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
