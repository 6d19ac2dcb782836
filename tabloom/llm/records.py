"""Token ids in length-delimited binary records, with an offset index beside each file.

A record is: payload length (u64), masked CRC-32C of those 8 bytes (u32), payload, masked CRC-32C of the payload
(u32); all little-endian, the common framing of record files for training.  The payload is the document's id (i64)
followed by its token ids, two bytes each where the vocabulary allows it, else four.  The ``.idx`` file holds the
offset of every record as u64, so records can be read in any order.

Documents are dealt out and sorted by ascending doc_id, one file pair a partition, named by partition and attempt; only
the manifest row of the attempt that succeeded names its files, so a lost or repeated task does no harm.  The manifest
(a row a file) is all that reaches the driver; it adds up the ids before each file.

Checksums are computed for many records at once: the CRC is linear, so words are folded pairwise by tables of the
operator that advances a state by 2^j words, all made by rule.

Defined results: a null or empty text is a record of the end id alone; a null doc_id comes first and is stored as the
least 64-bit number; rows with the same doc_id follow each other by their texts' hashes; a
text of any length is one record; an empty table gives no files and no rows;
other columns aren't read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import bpe
from tabloom.llm.common import shared_dir

CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8
NULL_ID = -(1 << 63)
#: Payload bytes that are framed, written or read together.
GROUP_BYTES = 1 << 23


def _compose(outer: list[int], inner: list[int]) -> list[int]:
    """The operator inner, then outer; each given by what it makes of the 32 single bits."""

    def apply(x: int) -> int:
        y = 0
        for bit in range(32):
            if x >> bit & 1:
                y ^= outer[bit]
        return y

    return [apply(x) for x in inner]


@lru_cache(maxsize=64)
def _advance(level: int) -> np.ndarray:
    """Tables (2 x 65,536, by the state's halves) of the operator that advances a CRC state by 2^level words of zeros."""
    op = [(1 << b) >> 1 ^ (CASTAGNOLI if b == 0 else 0) for b in range(32)]
    for _ in range(5 + level):
        op = _compose(op, op)
    values = np.zeros((2, 1 << 16), np.uint32)
    for half in range(2):
        for bit in range(16):
            values[half, (np.arange(1 << 16) >> bit & 1).astype(bool)] ^= np.uint32(op[16 * half + bit])
    return values


def _moved(x: np.ndarray, level: int) -> np.ndarray:
    low, high = _advance(level)
    return low.take(x & np.uint32(0xFFFF)) ^ high.take(x >> np.uint32(16))


def masked_crcs(blobs: list[bytes]) -> np.ndarray:
    """The masked CRC-32C of each blob of at least 4 bytes."""
    out = np.zeros(len(blobs), np.uint32)
    sizes = np.array([(len(b) + 3) // 4 for b in blobs])
    level = np.array([int(n - 1).bit_length() for n in sizes]) if blobs else sizes
    for k in np.unique(level):
        members, width = np.flatnonzero(level == k), 4 << int(k)
        step = max(1, GROUP_BYTES // width)
        for at in range(0, len(members), step):
            part = members[at : at + step]
            grid = np.zeros((len(part), width), np.uint8)
            for row, i in enumerate(part):
                blob = np.frombuffer(blobs[i], np.uint8)
                grid[row, width - len(blob) :] = blob
                grid[row, width - len(blob) : width - len(blob) + 4] ^= 255  # the state starts as all ones
            words = grid.view("<u4").astype(np.uint32)
            for j in range(int(k)):
                words = _moved(words[:, 0::2], j) ^ words[:, 1::2]
            crc = _moved(words[:, 0], 0) ^ np.uint32(0xFFFFFFFF)
            out[part] = (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)
    return out


def frame(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a record."""
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    head_crcs, crcs = masked_crcs(heads).astype("<u4"), masked_crcs(payloads).astype("<u4")
    return [h + hc.tobytes() + p + c.tobytes() for h, hc, p, c in zip(heads, head_crcs, payloads, crcs)]


def unframe(records: list[bytes]) -> list[bytes]:
    """The payloads of records; ValueError where a length or checksum is wrong."""
    heads, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    if any(int.from_bytes(h, "little") != len(p) for h, p in zip(heads, payloads)):
        raise ValueError("a record's length is wrong")
    said = np.frombuffer(b"".join([r[8:12] + r[-4:] for r in records]), "<u4").reshape(-1, 2)
    if not (np.array_equal(said[:, 0], masked_crcs(heads)) and np.array_equal(said[:, 1], masked_crcs(payloads))):
        raise ValueError("a record's checksum is wrong")
    return payloads


def write(docs: DataFrame, path: str, out_dir: str, end_id: int = 1) -> list[dict]:
    """Writes all documents in ascending doc_id order under a URI; gives a manifest, a dict a file in order."""
    width = bpe.id_width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, top = fs.FileSystem.from_uri(out_dir)
        words = bpe.rank_words(path, width)
        end = words.special(end_id)
        name = f"{top}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        at, offsets, n_ids, group, held = 0, [], 0, [], 0
        file = None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist())):
                group.append((NULL_ID if key is None else key).to_bytes(8, "little", signed=True) + ids + end)
                held += len(group[-1])
                n_ids += len(ids) // width + 1
                if held >= GROUP_BYTES:
                    file = file or store.open_output_stream(f"{name}.rec")
                    at, group, held = _write(file, group, offsets, at), [], 0
        if group:
            file = file or store.open_output_stream(f"{name}.rec")
            _write(file, group, offsets, at)
        if file:
            file.close()
            with store.open_output_stream(f"{name}.idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            row = {"part": task.partitionId(), "file": f"{name}.rec", "docs": len(offsets), "ids": n_ids}
            yield pa.RecordBatch.from_pylist([{"entry": json.dumps(row)}])

    fs.FileSystem.from_uri(out_dir)[0].create_dir(fs.FileSystem.from_uri(out_dir)[1], recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    manifest = sorted((json.loads(r.entry) for r in rows.mapInArrow(run, "entry string").collect()), key=lambda e: e["part"])
    start = 0
    for entry in manifest:
        entry |= {"start": start, "width": width, "dir": out_dir}
        start += entry["ids"]
    return manifest


def _write(file, payloads: list[bytes], offsets: list[int], at: int) -> int:
    for record in frame(payloads):
        offsets.append(at)
        file.write(record)
        at += len(record)
    return at


def read_file(entry: dict, order: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's records: all in order, or those of the given numbers in that order."""
    store, _ = fs.FileSystem.from_uri(entry["dir"])
    with store.open_input_file(entry["file"].removesuffix(".rec") + ".idx") as index:
        offsets = np.frombuffer(index.read(), "<u8").astype(np.int64)
    with store.open_input_file(entry["file"]) as file:
        ends = np.append(offsets[1:], file.size())
        if order is not None:
            for i in order:
                yield from _parsed(unframe([file.read_at(int(ends[i] - offsets[i]), int(offsets[i]))]), entry["width"])
            return
        i = 0
        while i < len(offsets):
            j = max(i + 1, int(np.searchsorted(ends, offsets[i] + GROUP_BYTES)))
            blob = file.read_at(int(ends[j - 1] - offsets[i]), int(offsets[i]))
            yield from _parsed(unframe([blob[offsets[k] - offsets[i] : ends[k] - offsets[i]] for k in range(i, j)]), entry["width"])
            i = j


def _parsed(payloads: list[bytes], width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for p in payloads:
        key = int.from_bytes(p[:8], "little", signed=True)
        yield None if key == NULL_ID else key, np.frombuffer(p[8:], f"<u{width}")


def read_summary(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                entry = json.loads(text)
                start, columns = entry["start"], ([], [], [], [])
                for key, ids in read_file(entry):
                    for column, value in zip(columns, (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        column.append(value)
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(json.dumps(e),) for e in manifest], "entry string")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str, end_id: int = 1, out_dir: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    out_dir = out_dir or f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    return read_summary(spark, write(docs, path, out_dir, end_id))
