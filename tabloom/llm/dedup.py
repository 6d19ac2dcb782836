"""Removal of repeated passages with suffix arrays: every byte covered by a 100-byte string that starts earlier goes.

"Earlier" is a smaller doc_id, or the same document at an earlier start; strings are judged on the input.  A suffix
array of the whole corpus would need it on one machine, so the strings that can be equal are brought together first:

1. *Anchors.*  Each 100-byte window is assigned to the least of the hashes of the 32-byte strings in it (the leftmost on
   ties).  Equal windows have equal anchors at equal places, so they meet in the anchor's group.  Neighbouring windows
   with one anchor are one row, a run; there is a run for about 35 bytes of text.
2. *Copies of runs.*  Runs whose whole bytes are equal (two 64-bit hashes) are copies: all but the earliest are removed,
   already within a task (so a passage of a third of all documents leaves a row a task), then among all.
   Groups left with a single run are done: no other text has their windows.
3. *Candidates.*  For the earliest runs of groups with different runs, the bytes are fetched.  Any window holds 34 bytes
   before or 34 bytes after its anchor, so runs are cut in two and meet again by those bytes; what meets no other is
   done.
4. *Suffix arrays.*  Runs that meet are joined to blocks and sorted by Lyndon grouping (:mod:`tabloom.llm.suffixes`);
   neighbours in the array with 100 equal bytes are one class of windows, whose earliest stays.
5. *Hot groups.*  A group of more than HOT_BYTES (a line that very many documents share, in other surroundings each) is not
   sorted: its task hands its rows on as they come.  They are cut where windows hold the anchor at places of one class
   of NARROW neighbours, meet again by the 93 bytes that all windows of a class have in common, and go through 4 once more.
   What is too large even so is cut into single windows, whose copies are found by their 100 bytes.  So a task holds HOT_BYTES
   of one group at most.

Removed windows of all steps are united per document.

Defined results: a null text is empty; a null doc_id is smaller than all others; rows with equal doc_id and text are
one document and get the same result, rows with equal doc_id and other texts are separate documents in the order of
their texts' hashes; texts under 100 bytes keep all; a text of any length is
read whole, one at a time; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import hashing
from tabloom.llm.common import turn, written
from tabloom.llm.suffixes import suffix_array

LENGTH = 100
ANCHOR = 32
SIDE = (LENGTH - ANCHOR) // 2
#: Runs of a task among which copies are found before the shuffle.
TASK_RUNS = 1 << 19
#: Bytes of runs sorted together; a larger group is sorted alone.
BLOCK_BYTES = 1 << 12
#: Bytes of a group that is sorted as it is; a larger one is cut by more context first.
HOT_BYTES = 1 << 18
#: Neighbouring places of the anchor in a window that share a group when hot groups are cut.
NARROW = 8
#: Removed windows of a block are handed on from so many on.
BATCH = 1 << 14
#: Removed windows, or with bytes a part of a group that was too large.
WINDOWS = "doc long, sub long, lo int, n int, head int, bytes binary"
WINDOW_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
PART = "side binary, doc long, sub long, lo int, n int, head int, bytes binary"
NULL_ID = -(1 << 63)
RUN = "anchor long, whole long, doc long, sub long, lo int, n int, head int"
RUN_NAMES = [f.split()[0] for f in RUN.split(", ")]
#: head of a row that only says: these windows are removed.
REMOVED = -1


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, anchor's offset, anchor's hash, whole hash) of every run of the texts."""
    data = np.frombuffer(b"".join(texts) + b" " * LENGTH, np.uint8)
    size = len(data) - LENGTH + 1
    sums = hashing.prefix(data)
    strings = hashing.windows(sums, ANCHOR)
    keys = strings >> np.uint64(32) << np.uint64(32) | np.arange(len(strings), dtype=np.uint64)
    span, reach = LENGTH - ANCHOR + 1, 1
    while 2 * reach <= span:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    rest = span - reach
    least = np.minimum(keys[: size - 0], keys[rest : rest + size]) if rest else keys[:size]
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    good = np.ones(size, bool)
    for i in range(len(texts)):
        good[max(offsets[i], offsets[i + 1] - LENGTH + 1) : offsets[i + 1]] = False
    good[offsets[-1] :] = False
    at[~good] = -1
    edges = np.flatnonzero(np.diff(at, prepend=-2))
    lo, hi = edges, np.append(edges[1:], size)
    real = at[lo] >= 0
    lo, hi = lo[real], hi[real]
    anchor = at[lo]
    number = np.searchsorted(offsets, lo, "right") - 1
    # a document boundary between two runs with one anchor can't be: the anchor lies inside every window of its run
    return number, lo - offsets[number], hi - lo, anchor - lo, strings[anchor], hashing.spans(sums, lo, hi + LENGTH - 1)


def _merged(doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows [lo, lo + n) by document, with neighbours joined."""
    order = np.lexsort((lo, sub, doc))
    doc, sub, lo, n = doc[order], sub[order], lo[order], n[order]
    new = np.ones(len(lo), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (lo[1:] > lo[:-1] + n[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return doc[first], sub[first], lo[first], lo[last] + n[last] - lo[first]


def _rows(anchor, whole, doc, sub, lo, n, head) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((anchor, whole, doc, sub, lo, n, head), kinds)], RUN_NAMES)


def _removed(doc, sub, lo, n) -> pa.RecordBatch:
    doc, sub, lo, n = _merged(doc, sub, lo, n)
    spread = hashing.mix(doc.view(np.uint64) + lo.astype(np.uint64) * np.uint64(hashing.GOLDEN)).view(np.int64)
    return _rows(spread, np.zeros_like(doc), doc, sub, lo, n, np.full(len(lo), REMOVED))


def _copies(anchor, whole, doc, sub, lo, n, head) -> Iterator[pa.RecordBatch]:
    """The earliest of equal runs as they are, the others as removed."""
    order = np.lexsort((lo, sub, doc, whole, anchor))
    anchor, whole, doc, sub, lo, n, head = (c[order] for c in (anchor, whole, doc, sub, lo, n, head))
    first = np.ones(len(lo), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    yield _rows(*(c[first] for c in (anchor, whole, doc, sub, lo, n, head)))
    if not first.all():
        yield _removed(*(c[~first] for c in (doc, sub, lo, n)))


def find_runs(rows: DataFrame) -> DataFrame:
    """RUN rows of all texts, copies within a task already removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn()
        held: list[tuple[np.ndarray, ...]] = []
        total = 0
        items = ((d, t.encode(), s) for b in batches for d, s, t in zip(*(c.to_pylist() for c in b.columns)) if len(t) * 4 >= LENGTH)
        for group in hashing.groups(items):
            number, lo, n, head, anchor, whole = runs([g[1] for g in group])
            doc, sub = np.array([g[0] for g in group], np.int64)[number], np.array([g[2] for g in group], np.int64)[number]
            whole = hashing.mix(whole + head.astype(np.uint64))
            held.append((anchor.view(np.int64), whole.view(np.int64), doc, sub, lo, n, head))
            total += len(lo)
            if total >= TASK_RUNS:
                yield from _copies(*map(np.concatenate, zip(*held)))
                held, total = [], 0
        if held:
            yield from _copies(*map(np.concatenate, zip(*held)))

    return rows.select("doc", "sub", "text").mapInArrow(run, RUN)


def settle_runs(found: DataFrame) -> DataFrame:
    """Of runs grouped by anchor: removed copies, and the earliest runs of groups that have different ones."""
    order = ["anchor", "whole", "doc", "sub", "lo"]
    dealt = found.repartition("anchor").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of the rows so far: anchor and whole of the last run
        waiting = None  # the only run of the last group so far, not yet given
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            removed = columns[6] == REMOVED
            if removed.any():
                yield batch.filter(pa.array(removed))
                columns = [c[~removed] for c in columns]
            anchor, whole = columns[0], columns[1]
            if not len(anchor):
                continue
            new_group, new_run = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
            new_group[1:] = anchor[1:] != anchor[:-1]
            new_run[1:] = new_group[1:] | (whole[1:] != whole[:-1])
            if last:
                new_group[0] = anchor[0] != last[0]
                new_run[0] = new_group[0] or whole[0] != last[1]
            if not new_run.all():
                yield _removed(*(c[~new_run] for c in columns[2:6]))
            at = np.flatnonzero(new_run)
            starts = new_group[at]  # of each run, whether it opens its group
            alone = np.zeros(len(at), bool)
            alone[:-1] = starts[:-1] & starts[1:]
            if len(at):
                if waiting is not None and not starts[0]:
                    yield _rows(*waiting)
                    waiting = None
                if waiting is not None and starts[0]:
                    waiting = None  # its group had no other run
                alone[-1] = starts[-1]
                give = at[~alone]
                if len(give):
                    yield _rows(*(c[give] for c in columns))
                if starts[-1]:
                    waiting = [c[at[-1:]] for c in columns]
            last = (anchor[-1], whole[-1])

    return dealt.mapInArrow(run, RUN)


def candidates(settled: DataFrame, rows: DataFrame) -> DataFrame:
    """PART rows: the two parts of a run under the hash of its anchor and of what stands before or after it; head is the
    anchor's place in the first window."""
    wanted = settled.where(F.col("head") != REMOVED).groupBy("doc", "sub").agg(F.collect_list(F.struct("anchor", "lo", "n", "head")).alias("runs"))
    both = wanted.join(rows, ["doc", "sub"]).select("doc", "sub", "runs", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, sub, found, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data, made = text.encode(), []
                for r in found:
                    lo, n = r["lo"], r["n"]
                    at = lo + r["head"]
                    before = min(n, max(0, r["head"] - SIDE + 1))  # windows that hold SIDE bytes before the anchor; the rest hold as many after it
                    for first, size, side in ((lo, before, data[at - SIDE : at + ANCHOR] + b"<"), (lo + before, n - before, data[at : at + ANCHOR + SIDE] + b">")):
                        if size:
                            key = hashlib.blake2b(side, digest_size=16).digest()
                            made.append((key, doc, sub, first, size, at - first, data[first : first + size - 1 + LENGTH]))
                if made:
                    yield _parts(made)

    return both.mapInArrow(run, PART)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in PART.split(", ")])


def cut_parts(lo: int, n: int, head: int, data: bytes, width: int) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    """(side, lo, n, head, bytes) of a part's windows by classes of ``width`` places of the anchor; the side is the hash of what
    all windows of the class hold, and of the class."""
    for k in range((head - n + 1) // width, head // width + 1):
        least, most = k * width, min(k * width + width, LENGTH - ANCHOR + 1) - 1
        first, last = head - min(head, most), head - max(head - n + 1, least)
        common = data[head - least : head - most + LENGTH]
        key = hashlib.blake2b(b"%d:%d:" % (width, k) + common, digest_size=16).digest()
        yield key, lo + first, last - first + 1, head - first, data[first : last + LENGTH]


def narrower(held: DataFrame, width: int) -> DataFrame:
    """PART rows of the parts that :func:`sort_blocks` handed on, cut by :func:`cut_parts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc, sub, lo, n, head, data in zip(*(c.to_pylist() for c in batch.columns)):
                made += [(key, doc, sub, *rest) for key, *rest in cut_parts(lo, n, head, data, width)]
            if made:
                yield _parts(made)

    return held.select("doc", "sub", "lo", "n", "head", "bytes").mapInArrow(run, PART)


def equal_windows(found: DataFrame) -> DataFrame:
    """Removed windows (doc, sub, lo, n) of PART rows of one window each: the earliest of a side stays."""
    dealt = found.repartition("side").sortWithinPartitions("side", "doc", "sub", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None
        for batch in batches:
            gone = []
            for side, doc, sub, lo, _, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                if side != last:
                    last, first = side, data
                elif data == first:
                    gone.append((doc, sub, lo))
            if gone:
                yield _windows(gone)

    return dealt.mapInArrow(run, WINDOWS)


def repeated_windows(block: list[tuple[int, int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """(doc, sub, start) of every window of the (doc, sub, lo, n, bytes) runs that an earlier window of them equals."""
    data = b"\xff".join(r[4] for r in block)
    owner, at = np.full(len(data), -1, np.int64), 0
    start_of = []
    for k, r in enumerate(block):
        owner[at : at + r[3]] = k
        start_of.append(at)
        at += len(r[4]) + 1
    order = np.array(suffix_array(data), np.int64)
    held: list[int] = []
    last = b""
    for i in order[owner[order] >= 0].tolist():
        window = data[i : i + LENGTH]
        if window != last:
            if len(held) > 1:
                yield from _later(held, block, owner, start_of)
            held, last = [], window
        held.append(i)
    if len(held) > 1:
        yield from _later(held, block, owner, start_of)


def _later(held: list[int], block: list, owner: np.ndarray, start_of: list[int]) -> list[tuple[int, int, int]]:
    places = []
    for i in held:
        doc, sub, lo, _, _ = block[owner[i]]
        places.append((doc, sub, lo + i - start_of[owner[i]]))
    least = min(places)
    return [p for p in places if p != least]


def _windows(places: list[tuple[int, int, int]]) -> pa.RecordBatch:
    doc, sub, lo = np.array(places, np.int64).T
    merged = _merged(doc, sub, lo, np.ones_like(lo))
    arrays = [pa.array(c, k) for c, k in zip(merged, WINDOW_KINDS)] + [pa.nulls(len(merged[0]), k) for k in WINDOW_KINDS[4:]]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in WINDOWS.split(", ")])


def sort_blocks(found: DataFrame, hot: int) -> DataFrame:
    """WINDOWS rows of PART rows that meet: removed windows, and groups of more than ``hot`` bytes as they are."""
    dealt = found.repartition("side").sortWithinPartitions("side", "doc", "sub", "lo")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], bool]]:
        """Whole groups of two rows or more, and larger ones in pieces."""
        last, held, size, over = None, [], 0, False
        for batch in batches:
            for side, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if side != last:
                    if len(held) > 1 or (held and over):
                        yield held, not over
                    last, held, size, over = side, [], 0, False
                held.append(tuple(rest))
                size += len(rest[-1])
                if size > hot:
                    yield held, False
                    held, size, over = [], 0, True
        if len(held) > 1 or (held and over):
            yield held, not over

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn()
        block, size, gone = [], 0, []
        for group, whole in groups(batches):
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*group), WINDOW_KINDS)], [f.split()[0] for f in WINDOWS.split(", ")])
                continue
            block += [(*r[:4], r[5]) for r in group]
            size += sum(len(r[5]) for r in group)
            if size >= BLOCK_BYTES:
                gone += set(repeated_windows(block))
                block, size = [], 0
            if len(gone) >= BATCH:
                yield _windows(gone)
                gone = []
        gone += set(repeated_windows(block))
        if gone:
            yield _windows(gone)

    return dealt.mapInArrow(run, WINDOWS)


def sorted_windows(found: DataFrame, hot: int) -> DataFrame:
    """Removed windows (doc, sub, lo, n) of PART rows, hot groups in up to three rounds."""
    names, tables = ["doc", "sub", "lo", "n"], []
    for width in (NARROW, 1):
        made = written(sort_blocks(found, hot), "windows")
        tables.append(made.where("bytes IS NULL").select(names))
        held = made.where("bytes IS NOT NULL")
        if held.isEmpty():
            break
        found = narrower(held, width)
    else:
        tables.append(written(equal_windows(found).select(names), "windows"))
    return reduce(DataFrame.unionByName, tables)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with doc and sub (in the place of columns of these names), which order documents; sub is 0 unless some doc_id isn't unique."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    twice = not docs.groupBy(key.alias("doc")).count().where("count > 1").isEmpty()
    sub: Column = F.xxhash64(F.col("text").cast("string")) if twice else F.lit(0).cast("long")
    return docs.withColumn("doc", key).withColumn("sub", sub)


def removals(docs: DataFrame, *keep: Column | str, hot: int = HOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(doc, sub, spans array<struct<lo, n>>) of documents with removed windows; (doc, sub, text, what to keep) of all rows."""
    rows = keyed(docs).select("doc", "sub", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    once = rows.select("doc", "sub", "text")
    if _repeats(rows):  # one document, else its runs would be copies of themselves
        once = once.dropDuplicates(["doc", "sub"])
    settled = written(settle_runs(find_runs(once)), "runs")
    sorted_out = sorted_windows(candidates(settled, once), hot)
    gone = settled.where(F.col("head") == REMOVED).select("doc", "sub", "lo", "n").unionByName(sorted_out)
    return gone.groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "n")).alias("spans")), rows


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("doc", "sub").count().where("count > 1").isEmpty()


def kept_parts(data: bytes, spans: list[dict] | None) -> tuple[list[bytes], int, int]:
    """What is left of a document's bytes, and the number of bytes and of maximal runs removed."""
    parts, at, n_removed, n_spans = [], 0, 0, 0
    last = -1
    for lo, n in sorted((s["lo"], s["n"]) for s in spans or []):
        end = lo + n - 1 + LENGTH
        if lo > last:
            parts.append(data[max(last, 0) : lo])
            n_spans += 1
            n_removed += end - lo
            last = end
        elif end > last:
            n_removed += end - last
            last = end
    parts.append(data[max(last, 0) :])
    return parts, n_removed, n_spans


def remove_repeats(docs: DataFrame, hot: int = HOT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row; the result is the same for any ``hot``."""
    spans, rows = removals(docs.select("doc_id", "text"), "doc_id", hot=hot)
    joined = rows.join(spans, ["doc", "sub"], "left").select("doc_id", "text", "spans")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in range(5)]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                parts, n_removed, n_spans = kept_parts(data, found)
                kept = b"".join(parts)
                for column, value in zip(made, (len(data), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, schema)


def rewrite(docs: DataFrame) -> DataFrame:
    """docs without repeated passages: texts hold the bytes kept, less the parts of characters that a cut left over;
    documents of which nothing is left go; an n_chars column is counted anew; all other columns stay."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("__row"))
    spans, rows = removals(packed, "__row")
    joined = rows.join(spans, ["doc", "sub"], "left").select("text", "spans", "__row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None] * batch.num_rows
            for i, (text, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if found:
                    texts[i] = b"".join(kept_parts(text.encode(), found)[0]).decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.string())], ["__row", "__kept"])

    made = joined.mapInArrow(run, f"__row {rows.schema['__row'].dataType.simpleString()}, __kept string")
    new = F.col("__kept").isNotNull()
    out = []
    for name in docs.columns:
        old = F.col("__row").getField(name)
        if name == "text":
            old = F.when(new, F.col("__kept")).otherwise(old)
        elif name == "n_chars":
            old = F.when(new, F.char_length("__kept")).otherwise(old).cast(docs.schema[name].dataType)
        out.append(old.alias(name))
    return made.where("__kept IS NULL OR __kept <> ''").select(out)
