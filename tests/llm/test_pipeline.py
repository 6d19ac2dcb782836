"""The pipeline, stage by stage, against plain versions on the small table."""

import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from test_dedup import plain as plain_removals
from test_neardup import plain_classes
from test_text_operators import slow_measures
from tokenizers import Tokenizer

import corpus_pipeline
from tabloom.llm import bpe, language, neardup
from tabloom.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    (_, quality), (_, lang), (_, near), (_, passages), (_, packing) = corpus_pipeline.STAGES

    kept = quality(spark, docs, sf_dir)
    assert kept.columns == columns
    clean = []
    for r in docs.collect():
        n, chars, symbols, dup, repeat, lines, echo = slow_measures(r.text)
        bad = n < 20 or 100 * repeat > 30 * n or 100 * symbols > 10 * n or 100 * dup > 50 * lines or chars < 2 * n or chars > 15 * n or 100 * echo > 20 * n
        if not bad:
            clean.append(r)
    assert sorted(kept.collect()) == sorted(clean) and len(clean) < docs.count()

    kept = spark.createDataFrame(clean, docs.schema)
    known = lang(spark, kept, sf_dir)
    model = language.train(kept.where(~language.held_out()), bpe.vocabulary_path("piece_bpe_32k.model"))
    sure = [r for r, (p, s) in zip(clean, model.predict([r.text for r in clean])) if p != "und" and s >= 0.5]
    assert known.columns == columns and sorted(known.collect()) == sorted(sure)

    known = spark.createDataFrame(sure, docs.schema)
    single = near(spark, known, sf_dir)
    classes = plain_classes(known)
    first = [r for r in sure if classes[r.doc_id] == r.doc_id]
    assert single.columns == columns and sorted(single.collect()) == sorted(first) and len(first) < len(sure)

    single = spark.createDataFrame(first, docs.schema)
    cut = passages(spark, single, sf_dir)
    left = {i: k[4].decode("utf-8", "ignore") for i, k in plain_removals([(r.doc_id, r.text) for r in first]).items()}
    assert cut.columns == columns and {r.doc_id: r.text for r in cut.collect()} == {i: t for i, t in left.items() if t}
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    pieces = packing(spark, cut, sf_dir).collect()
    library = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert by_doc.keys() == {i for i, t in left.items() if t}
    for i, found in by_doc.items():
        ids = library.encode(left[i], add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted(found, key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_edges(spark, sf_dir):
    """Nulls, empty texts, repeated rows and columns named like results: one row of equal texts stays, with all its columns."""
    docs = table(spark, sf_dir, "documents").where("doc_id < 60 AND lang IS NOT NULL")
    odd = docs.unionByName(docs).unionByName(docs.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars"))
    nulls = spark.createDataFrame([(None, None, None, None, None), (2000, "", "en", "s", 0), (2001, None, "en", "s", None)], docs.schema)
    names = ["node", "label", "class_id", "kept", "score", "lang_pred", "n_words", "fail_mask", "spans", "doc", "sub", "data"]
    left = odd.unionByName(nulls).selectExpr("*", *[f"concat('x', doc_id) AS {c}" for c in names])
    columns = left.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf_dir)
        assert left.columns == columns, name
        left = spark.createDataFrame(left.collect(), left.schema)
    rows = left.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows) and all(r.doc_id < 60 for r in rows)
    assert all(r[c] == f"x{r.doc_id}" for r in rows for c in names)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, left, sf_dir).collect()} == {r.doc_id for r in rows}


def test_caches_take_turns():
    """A worker that goes on to the next stage doesn't keep the language stage's words."""
    shared = SimpleNamespace(value=(bpe.vocabulary_path("piece_bpe_32k.model"), ["a", "b"], np.ones((32_001, 2), np.float32)))
    scorer = language._scorer(shared)
    assert language._scorer(shared) is scorer
    batches = iter([pa.RecordBatch.from_arrays([pa.array(["k"]), pa.array(["some words of a text"])], ["node", "text"])])
    assert len(list(neardup._grouped(batches))) == 1
    assert not language._scorers
