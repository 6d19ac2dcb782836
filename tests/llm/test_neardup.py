"""Near-duplicates against all pairs, and planted groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import components as components_of
from tabloom.llm import hashing, neardup
from tabloom.llm.common import table
from tabloom.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, node string, label string"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or ""), "x", "y") for i, t in enumerate(texts)], DOC)


def plain_classes(docs):
    """Classes by comparing every pair of texts, with shingles made anew."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    idf = neardup.idf_table(neardup.nodes(docs).where("text IS NOT NULL")).astype(float)
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        keys = next(hashing.shingles([(text or "").lower().encode()]))
        assert len(keys) == (max(1, len(words) - 4) if words else 0)
        sets.append(neardup.counted(keys, idf))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a is not None and b is not None and (a == b or neardup.similarity(sets[i], sets[j]) >= 0.8):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return {doc_id: least[root(i)] for i, (doc_id, _) in enumerate(rows)}


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def changed(rng, text, n):
    out = list(text)
    for i in rng.sample(range(len(out)), n):
        out[i] = "".join(rng.choices("klmnop", k=5))
    return out


def test_shingles_are_runs_of_words():
    a, b = hashing.shingles([b"a b c d e f", b"x  b c\nd e f"])
    assert len(a) == len(b) == 2 and a[1] == b[1] and a[0] != b[0]
    assert [len(x) for x in hashing.shingles([b"", b" ", b"one two", b"one two ", b"a b c d e"])] == [0, 0, 1, 1, 1]


def test_samples_agree_as_often_as_similar():
    rng = np.random.default_rng(3)
    hits, total = 0, 0.0
    for k in range(60):
        keys = np.unique(rng.integers(0, 1 << 63, 240).astype(np.uint64))
        weights = rng.uniform(0.2, 3, len(keys))
        other = np.where(rng.random(len(keys)) < 0.3, weights * rng.uniform(0.3, 2, len(keys)), weights)
        a, b = (keys[:200], weights[:200]), (keys[20:220], other[20:220])
        hits += (neardup.samples(*a) == neardup.samples(*b)).sum()
        total += neardup.similarity(a, b)
    assert abs(hits / (60 * neardup.SAMPLES) - total / 60) < 0.04


def test_small_table_as_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert found == plain_classes(docs)


def test_planted_groups(spark):
    rng = random.Random(5)
    texts, groups = [], []
    for size in (2, 3, 5, 12, 60):
        base = words(rng, 300)
        groups.append(range(len(texts), len(texts) + size + 1))
        texts += [" ".join(changed(rng, base, 4)) for _ in range(size)] + [" ".join(base)]
    passage = " ".join(words(rng, 60))
    loners = [f"{' '.join(words(rng, 150))} {passage} {' '.join(words(rng, 150))}" for _ in range(80)]
    docs = frame(spark, texts + loners)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    for g in groups:
        assert {found[i] for i in g} == {g[0]}
    assert all(found[i] == i for i in range(len(texts), len(texts) + len(loners)))
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    assert kept == set(found.values())


def test_large_group_as_all_pairs(spark):
    """A group of copies with few and many changes, some cut short, some changed alike: links that no hub shows."""
    rng = random.Random(8)
    base = words(rng, 150)
    texts = [" ".join(changed(rng, base, rng.randint(0, 7))) for _ in range(300)]
    for _ in range(4):  # families within the family: far from the hub, near to each other
        part = changed(rng, base, 12)
        texts += [" ".join(changed(rng, part, 1)) for _ in range(8)]
    texts += [" ".join(base[: rng.randint(60, 150)]) for _ in range(40)]
    rng.shuffle(texts)
    docs = frame(spark, texts)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == plain_classes(docs)


def test_member_that_met_its_later_hub_before(spark, monkeypatch):
    """Families within families in one bucket, with pairs that no key of the first rounds sets apart: they stay in the
    search for more rounds, also under a hub that they were compared with when it was of a team."""
    rng = random.Random(1)
    parts = [words(rng, 60)]
    for n in (4, 40):
        starts = [(part, rng.randrange(56)) for part in parts for _ in range(n)]
        parts = [part[:at] + words(rng, 4) + part[at + 4 :] for part, at in starts]
    texts = [" ".join(part[:-1] + words(rng, 1)) for part in parts for _ in range(2)]
    rng.shuffle(texts)
    docs = frame(spark, texts)
    drawn = neardup.sketches
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "idf_table", lambda rows: np.ones(neardup.CELLS, np.float32))  # as rare as in a large corpus
    monkeypatch.setattr(neardup, "sketches", lambda rows, idf: drawn(rows, idf).withColumn("buckets", F.array(F.lit(1).cast("long"))))
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == plain_classes(docs)


def test_keys_outside_a_hub():
    """Whatever is like x meets it in a group of the keys that either has outside a hub, or is like the hub."""
    rng = np.random.default_rng(4)
    idf = np.round(rng.uniform(0.1, 1, neardup.CELLS), 2)
    met = 0
    for _ in range(600):
        pool = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        hub, x = (neardup.counted(rng.choice(pool, rng.integers(5, 60)), idf) for _ in range(2))
        drop = rng.integers(0, max(1, len(x[0]) // 5) + 1)
        y = (x[0][drop:], x[1][drop:])
        linked = [neardup.similarity(z, hub) >= 0.8 for z in (x, y)]
        if neardup.similarity(x, y) >= 0.8 and not all(linked):
            met += 1
            a, b = ({*zip(*neardup.outside(z, hub, idf, b"name of a hub", on))} for z, on in zip((x, y), linked))
            flip = {0: 0, 1: 2, 2: 1}
            assert {(k, flip[role]) for k, role in a} & b
    assert met > 50


def test_edges(spark):
    rows = [None, None, "", "", " ", "one", "one", "one two", "tie tie tie tie tie tie", "tie tie tie tie tie tie", "long word " * 20_000, "X" * 100_000]
    docs = frame(spark, rows)
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11}
    again = docs.unionByName(docs).unionByName(docs.selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars", "node", "label"))
    assert again.count() == neardup.near_duplicates(again).count()
    kept = neardup.keep_one(docs.unionByName(docs.where("text IS NOT NULL")))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 4, 5, 7, 8, 10, 11]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("local", [200_000, 0])
def test_components_of_a_chain_and_a_hub(spark, monkeypatch, local):
    """In one task and in rounds."""
    monkeypatch.setattr(components_of, "LOCAL", local)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_tables_in_few_files(spark, monkeypatch):
    """However many partitions the session deals out, tables between the rounds are checkpointed in as many as their rows need."""
    rng = random.Random(17)
    base = words(rng, 150)
    texts = [" ".join(changed(rng, base, rng.randint(1, 6))) for _ in range(150)] + [" ".join(words(rng, 40)) for _ in range(40)]
    monkeypatch.setattr(neardup, "SMALL", 16)
    docs = frame(spark, texts)
    parts, settings = [], {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def recorded(df, save=neardup.checkpoint):
        made = save(df)
        parts.append(made.rdd.getNumPartitions())
        return made

    monkeypatch.setattr(neardup, "checkpoint", recorded)
    monkeypatch.setattr(components_of, "checkpoint", recorded)
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == plain_classes(docs)
    assert len(parts) > 10 and max(parts) <= 3, parts
