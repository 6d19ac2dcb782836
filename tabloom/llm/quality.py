"""Quality rules as a ledger of bit masks.

:func:`ledger` measures every text once and evaluates every rule once: a row holds the measurements and ``fail_mask``
with one bit a rule.  A policy is a version name and the mask of the rules it enforces; :func:`apply_policy` keeps what
has no enforced bit, so changing a policy never reads a text again.  :func:`ablation` aggregates masks alone: for each
rule of a policy the documents that fail it, and those that fail nothing else and would be kept without it.

Words are runs of characters other than ASCII white space.  Repetition is measured on 8-word windows, compared by
64-bit hashes combined from the words' hashes.

Defined results: a null text has no words and fails ``few_words`` as an empty one does; equal texts get equal rows; a text of any length is
measured whole; a null doc_id is carried along;
an empty table gives an empty ledger; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Multipliers of the rolling combination: odd numbers from a fixed rule (powers of the 64-bit golden ratio).
STEPS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_echo_words")


@dataclass(frozen=True)
class Rule:
    """A name, its bit, and the SQL condition on the measurements under which a document fails."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "10 * word_chars < 20 * n_words"),
    Rule(5, "long_words", "10 * word_chars > 150 * n_words"),
    Rule(6, "echoes", "100 * n_echo_words > 20 * n_words"),
)
#: Versions of the policy: the rules that each enforces.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "short_words", "long_words"),
    "v2": tuple(r.name for r in RULES),
}


def mask_of(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    data = (text or "").encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    n_repeat = 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n_echo = int(np.count_nonzero(hashes[1:] == hashes[:-1]))
    if len(words) > WINDOW:
        size = len(words) - WINDOW + 1
        windows = np.zeros(size, np.uint64)
        for k, step in enumerate(STEPS):
            windows += hashes[k : k + size] * np.uint64(step)
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            edges = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(np.isin(windows, twice))
            np.add.at(edges, at, 1)
            np.add.at(edges, at + WINDOW, -1)
            n_repeat = int(np.count_nonzero(np.cumsum(edges)))
    chars = sum(map(len, words)) if data.isascii() else len(b"".join(words).decode())
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, len(lines), n_echo


def fail_mask(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total.cast("long")


def measured(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """The columns ``keep`` untouched, MEASURES and fail_mask of every row."""
    rows = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    fields = rows.schema.fields[1:]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{m} long" for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [measure(t) for t in batch.column(0).to_pylist()]
            columns = zip(*made) if made else [()] * len(MEASURES)
            arrays = [*batch.columns[1:], *[pa.array(c, pa.int64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, [*[f.name for f in fields], *MEASURES])

    return rows.mapInArrow(run, schema).withColumn("fail_mask", fail_mask())


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and fail_mask of every row."""
    return measured(docs, "doc_id")


def keep_passing(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of docs, with all their columns, that a policy keeps."""
    return measured(docs, F.struct("*").alias("__row")).where(passes(policy)).select("__row.*")


def passes(policy: str) -> Column:
    return F.col("fail_mask").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    return rows.withColumn("kept", passes(policy))


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """(policy, rule, n_docs, n_failed, n_only): per rule the documents failing it, and failing it alone."""
    mask = F.col("fail_mask").bitwiseAND(F.lit(mask_of(policy)).cast("long"))
    masks = rows.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"))  # at most a row for each set of rules
    named = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("flag")) for r in RULES if r.name in POLICIES[policy]]
    each = masks.select("mask", "n", F.explode(F.array(*named)).alias("r")).select("mask", "n", "r.*")
    return each.groupBy(F.lit(policy).alias("policy"), "rule").agg(
        F.sum("n").alias("n_docs"),
        F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.col("flag")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("mask") == F.col("flag"), F.col("n"))), F.lit(0)).alias("n_only"),
    )
