"""Token counts by the whole-token shortcut.

Most words of a text are one token.  For a vocabulary that fact is settled once, before any text is read:
:func:`whole_tokens` merges every vocabulary string that may stand for a word by the vocabulary's own rules and keeps
those that end as one piece, so counting them as one is proved and not assumed.  A word in that set counts one;
only the rest are merged, each distinct word once a worker's cache.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a text count one each, as the
library reads them; repeated rows are counted alike; a text of any length is
counted whole; a null doc_id is carried along; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import bpe


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The words that the vocabulary's merges provably join to one token."""
    model = bpe.load(path)
    back = {c: b for b, c in model.table.items()}
    found = set()
    for piece in model.vocab:
        bare = piece.removesuffix(model.suffix)
        if piece.endswith(model.suffix) and all(c in back for c in bare):
            try:
                word = bytes(back[c] for c in bare).decode()
            except UnicodeDecodeError:
                continue
            if word and len(model.merge(word)) == 1:
                found.add(word)
    return frozenset(found)


@lru_cache(maxsize=4)
def counts(path: str) -> bpe.WordCache:
    """word -> its number of tokens: one for proved words, else as merged."""
    model, whole = bpe.load(path), whole_tokens(path)
    return bpe.WordCache(lambda word: 1 if word in whole else len(model.merge(word)))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = bpe.load(path), counts(path)
        get = cache.__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                n_bytes.append(len((text or "").encode()))
                n_tokens.append(sum(1 if mark else sum(map(get, words)) for mark, words in model.stretches(text or "")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
