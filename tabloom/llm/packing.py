"""Cost-balanced packing of token sequences.

Documents are encoded, closed with an end id and cut into full pieces of ``capacity`` tokens plus a remainder.  A
full piece fills a sequence of its own.  The remainders of a block are assigned in descending length: the cost of
a piece is ``linear * n + quadratic * n * n`` (projections and attention), and each goes to the sequence of lowest
cost that has room for it.  Where none has room the piece is cut, its head closing the lowest-cost of the sequences
with most room.  A block opens just the sequences that its tokens fill: full ones, and for what is left over one for
each power of two in it, so no position is padded.

A block is a run of documents of one input split holding about BLOCK_TOKENS tokens; memory is bounded by it and the
longest document, nothing is shuffled, and a lost task is repeated from its split with the same result.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed as often as they
occur; a null doc_id is carried along; a text of any length is packed whole; of
remainders of equal length the split's earlier is placed first, of sequences of equal cost the earlier takes it; an empty table gives no pieces; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import bpe
from tabloom.llm.common import turn

CAPACITY = 1024
BLOCK_TOKENS = 1 << 22
#: A split's sequences are numbered from its partition number shifted by this.
SPLIT_BITS = 34
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 256) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece of the items' tokens."""
    out, rest, sequence = [], [], 0
    for item, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            out.append((item, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((item, n - n % capacity, n % capacity))
    full, left = divmod(sum(r[2] for r in rest), capacity)
    rooms = [capacity] * full + [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
    used = [0] * len(rooms)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    least = np.full(capacity + 1, np.inf)

    def put(cost: float, k: int) -> None:
        free = rooms[k] - used[k]
        heappush(heaps[free], (cost, k))
        least[free] = heaps[free][0][0]

    for k in range(len(rooms)):
        put(0.0, k)
    for item, start, n in sorted(rest, key=lambda r: (-r[2], r[0])):
        while n:
            free = n + int(np.argmin(least[n:]))
            if least[free] == np.inf:  # no sequence has room for all of it
                free = int(np.flatnonzero(np.isfinite(least[1:]))[-1]) + 1
            cost, k = heappop(heaps[free])
            least[free] = heaps[free][0][0] if heaps[free] else np.inf
            take = min(n, free)
            out.append((item, start, take, sequence + k, used[k]))
            used[k] += take
            if used[k] < rooms[k]:
                put(cost + linear * take + quadratic * take * take, k)
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row a piece (SCHEMA; with ``keep_ids`` also its ids as ``ids array<int>``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("bpe")
        words = bpe.rank_words(path, 4)
        end = words.special(end_id)
        sequence = TaskContext.get().partitionId() << SPLIT_BITS
        keys: list = []
        held: list[bytes] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, tokens
            pieces = assign([len(ids) // 4 for ids in held], capacity)
            columns: list[list] = [[] for _ in range(8)]
            for item, start, n, k, offset in pieces:
                ids = held[item][4 * start : 4 * (start + n)]
                row = (keys[item], start, n, zlib.crc32(ids), len(held[item]) // 4, sequence + k, offset, np.frombuffer(ids, "<u4") if keep_ids else None)
                for column, value in zip(columns, row):
                    column.append(value)
            sequence += 1 + max([p[3] for p in pieces], default=-1)
            keys.clear()
            held.clear()
            tokens = 0
            names = SCHEMA.replace(" long", "").split(", ")
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if keep_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(columns[7], pa.list_(pa.int32()))]
            for at in range(0, len(pieces), 50_000):
                yield pa.RecordBatch.from_arrays([a.slice(at, 50_000) for a in arrays], names)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                keys.append(key)
                held.append(ids + end)
                tokens += len(ids) // 4 + 1
                if tokens >= BLOCK_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if keep_ids else ""))
