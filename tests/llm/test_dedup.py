"""Removal of repeated passages against a plain scan, and suffix arrays against sorting."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import dedup
from tabloom.llm.common import table
from tabloom.llm.suffixes import suffix_array

DOC = "doc_id long, text string, lang string, source string, n_chars long, doc string, lo string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], DOC)


def plain(rows):
    """For (doc_id, text) rows in order: kept bytes, removed bytes, spans; windows are seen in order of (doc_id, start)."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest(), kept)
    return out


def found(docs, hot=dedup.HOT_BYTES):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in dedup.remove_repeats(docs, hot).collect()}


@given(st.binary(max_size=200) | st.lists(st.sampled_from([b"a", b"ab", b"ba", b"\xff"]), max_size=80).map(b"".join))
@settings(max_examples=300, deadline=None)
def test_suffix_array(data):
    assert suffix_array(data) == sorted(range(len(data)), key=lambda i: data[i:])


def test_suffix_array_of_repeats():
    for data in (b"", b"a" * 3000, b"ab" * 1500, b"abcab" * 400 + b"a", bytes(range(256)) * 5):
        assert suffix_array(data) == sorted(range(len(data)), key=lambda i: data[i:])


def test_small_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("task_runs", [dedup.TASK_RUNS, 8])
def test_planted_passages(spark, monkeypatch, task_runs):
    monkeypatch.setattr(dedup, "TASK_RUNS", task_runs)
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choices("abcdefgh éü\n", k=n))
    passages = [prose(n) for n in (99, 100, 101, 130, 180, 400, 3000)]
    rows = []
    for i in range(90):
        cut = rng.choice(passages)
        part = cut[rng.randrange(0, 20) : len(cut) - rng.randrange(0, 20)]
        rows.append((i, prose(rng.randrange(0, 150)) + part + prose(rng.randrange(0, 150)) + rng.choice(["", part])))
    rows += [(200 + i, passages[5]) for i in range(20)]
    assert found(frame(spark, rows).repartition(5)) == plain(rows)


@pytest.mark.parametrize("hot", [600, 4000])
def test_hot_groups(spark, hot):
    """Lines that many documents share, of 70, 98 and 150 bytes, in surroundings that are all different, alike or few."""
    rng = random.Random(21)
    prose = lambda n: "".join(rng.choices("abcdefgh éü\n", k=n))
    short, long, longest = prose(60), "x" + prose(80) + "y", prose(140)
    few = [prose(20) for _ in range(3)]
    rows = [(i, prose(60) + short + prose(60)) for i in range(150)]
    rows += [(200 + i, prose(rng.randrange(40)) + rng.choice(few) + short + rng.choice(few) + prose(rng.randrange(40))) for i in range(150)]
    rows += [(400 + i, prose(2) + rng.choice("pq") + long + rng.choice("rs") + "t" * 10 + prose(2)) for i in range(150)]
    rows += [(600 + i, prose(9) + longest + prose(9)) for i in range(80)]
    assert found(frame(spark, rows).repartition(5), hot) == plain(rows)


def test_hot_groups_take_all_rounds(spark):
    """The third round, of single windows: 97 shared bytes with three that differ."""
    rng = random.Random(22)
    line = "".join(rng.choices("abcdefgh", k=97))
    rows = [(i, f"{i % 100:03d}" + line + f"{i // 3:03d}") for i in range(300)]
    assert found(frame(spark, rows), 200) == plain(rows)


@given(st.integers(0, 68), st.integers(1, 69), st.sampled_from([1, 5, 8, 34]))
@settings(max_examples=200, deadline=None)
def test_cut_parts_keep_every_window(head, n, width):
    n = min(n, head + 1)
    data = bytes(random.Random(head * 100 + n).choices(range(256), k=n - 1 + dedup.LENGTH))
    parts = list(dedup.cut_parts(1000, n, head, data, width))
    assert sorted(lo + i for _, lo, k, _, _ in parts for i in range(k)) == list(range(1000, 1000 + n))
    for _, lo, k, own, cut in parts:
        assert lo + own == 1000 + head and cut == data[lo - 1000 : lo - 1000 + k - 1 + dedup.LENGTH]


def test_periods_and_edges(spark):
    rows = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 101), (5, "a" * 5000), (6, "ab" * 300), (7, "ba" * 300 + "x"), (8, "same line\n" * 80), (9, "é" * 500), (10, " " * 250), (11, "x" * 99 + "é" * 60)]
    assert found(frame(spark, rows)) == plain(rows)
    assert dedup.remove_repeats(frame(spark, [])).count() == 0


def test_null_and_repeated_ids(spark):
    text, other = "".join(random.Random(2).choices("abcdefgh ", k=300)), "".join(random.Random(3).choices("abcdefgh ", k=300))
    got = dedup.remove_repeats(frame(spark, [(5, text), (5, text), (None, text), (7, other), (7, other + text[:150]), (7, other)])).collect()
    by_id = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in got)
    assert by_id[0] == (-1, 300, 0) and by_id[1:3] == [(5, 300, 300)] * 2
    seven = {(n, gone) for i, n, gone in by_id[3:]}
    assert seven in ({(300, 0), (450, 450)}, {(300, 300), (450, 150)})


def test_repeated_rows_alone_keep_their_text(spark):
    text, other = "".join(random.Random(6).choices("abcdefgh ", k=300)), "".join(random.Random(7).choices("abcdefgh ", k=120))
    for rows in ([(5, text), (5, text)], [(5, text), (5, text), (5, other), (None, other), (None, other)]):
        docs = frame(spark, rows).repartition(3)
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in dedup.remove_repeats(docs).collect())
        assert got == sorted((i or -1, len(t), 120 if (i, t) == (5, other) else 0) for i, t in rows)
        assert sorted(r.text for r in dedup.rewrite(docs).collect()) == sorted(t for i, t in rows if (i, t) != (5, other))


def test_rewrite_keeps_columns(spark):
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choices("abcdefgh éü", k=n))
    part = prose(300)
    rows = [(1, part), (2, prose(50) + part + prose(50)), (3, part), (4, None), (5, "")]
    docs = frame(spark, rows).selectExpr("*", "1 AS __kept", "2 AS spans", "3 AS sub")
    got = dedup.rewrite(docs)
    assert got.columns == docs.columns
    expect = {i: k[4].decode("utf-8", "ignore") for i, k in plain(rows).items()}
    for r in got.collect():
        assert (r.text or "") == expect[r.doc_id] and r.n_chars == len(expect[r.doc_id])
    assert {r.doc_id for r in got.collect()} == {1, 2, 4, 5}
