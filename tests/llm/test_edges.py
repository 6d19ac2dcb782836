"""Every operator on null ids, repeated rows, extra columns named like its results, and very long texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_text_operators import slow_measures
from tokenizers import Tokenizer

from tabloom.llm import bpe, dedup, language, media, neardup, packing, quality, records, token_count
from tabloom.llm.common import table

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators give to their results or use inside.
CLASHING = (
    "n_bytes n_removed n_spans kept_sha256 n_tokens ids_sha256 decoded_sha256 start length ids_crc32 doc_tokens sequence_id offset "
    "payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature n_words fail_mask kept held_out lang_pred score node label class_id "
    "over_limit ids media sub data spans"
).split()


def language_of(docs):
    model = language.train(docs, bpe.vocabulary_path("piece_bpe_32k.model"))
    return language.predict(docs, model, "doc_id")


OPERATORS = {
    "suffix_dedup": dedup.remove_repeats,
    "round_trip": lambda d: bpe.round_trip_digests(d, bpe.vocabulary_path("byte_bpe_50k.json")),
    "pack": lambda d: packing.pack(d, bpe.vocabulary_path("byte_bpe_50k.json")),
    "records": lambda d: records.write_and_read(d, bpe.vocabulary_path("word_bpe_49k.json")),
    "media": lambda d: media.features(media.store_texts(d)),
    "quality": quality.ledger,
    "language": language_of,
    "near_duplicates": neardup.near_duplicates,
    "token_counts": lambda d: token_count.count_tokens(d, bpe.vocabulary_path("word_bpe_49k.json")),
}


def words(rng, n):
    return ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    text = " ".join(words(random.Random(4), 120))
    rows = [(None, text), (None, None), (1, text), (1, text), (1, "other words " + text), (2, ""), (3, None), (3, None), (4, "tie " * 60), (5, "tie " * 60)]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).coalesce(1)


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_with_clashing_names(odd, name):
    """They aren't read: results are those without them.  Null ids, null and empty texts and repeated rows keep their rows."""
    run = OPERATORS[name]
    clash = odd.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])
    plain, found = run(odd), run(clash)
    assert found.columns == plain.columns
    rows = sorted(map(str, found.collect()))
    assert rows == sorted(map(str, plain.collect()))
    ids = Counter(r.doc_id for r in plain.collect())
    assert ids.keys() == {None, 1, 2, 3, 4, 5}
    if name != "pack":
        assert ids == Counter([None, None, 1, 1, 1, 2, 3, 3, 4, 5])


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(6)
    part = " ".join(words(rng, 30_000)) + " "
    texts = {1: part + part, 2: "ab" * 60_000, 3: "é " * 50_000, 4: " ".join(words(rng, 20_000)) + "\n" * 50_000, 5: "a\n" * 40_000}
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOC).repartition(4), texts


def test_very_long_texts_encode_whole(long_docs):
    docs, texts = long_docs
    byte, word = (Tokenizer.from_file(bpe.vocabulary_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    ids = {k: {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()} for k, lib in (("byte", byte), ("word", word))}
    digest = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in OPERATORS["round_trip"](docs).collect()}
    assert digest == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids["byte"].items()}
    assert {r.doc_id: r.n_tokens for r in OPERATORS["token_counts"](docs).collect()} == {i: len(x) for i, x in ids["word"].items()}
    whole = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in OPERATORS["records"](docs).collect()}
    assert whole == {i: (len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, x in ids["word"].items()}
    held = Counter()
    for r in OPERATORS["pack"](docs).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*ids["byte"][r.doc_id], 0][r.start : r.start + r.length], "<u4").tobytes())
        held[r.doc_id] += r.length
    assert held == {i: len(x) + 1 for i, x in ids["byte"].items()}


def test_very_long_texts_measured_whole(long_docs):
    docs, texts = long_docs
    for r in quality.ledger(docs).collect():
        assert tuple(r[c] for c in quality.MEASURES) == slow_measures(texts[r.doc_id])
    for r in OPERATORS["media"](docs).collect():
        assert r.n_bytes == len(texts[r.doc_id].encode())
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == {i: i for i in texts}
    assert all(0 <= r.score <= 1 for r in language_of(docs).collect())


def test_very_long_repeats_removed_whole(long_docs):
    docs, texts = long_docs
    found = {r.doc_id: r for r in dedup.remove_repeats(docs).collect()}
    half = len(texts[1]) // 2
    assert (found[1].n_removed, found[1].n_spans) == (half, 1)
    assert found[1].kept_sha256 == hashlib.sha256(texts[1][:half].encode()).hexdigest()
    # Of a text of one period, every 100-byte string but those of the first period starts earlier.
    assert (found[2].n_removed, found[2].n_spans) == (120_000 - 2, 1)
    assert (found[3].n_removed, found[3].n_spans) == (150_000 - 3, 1)
    assert (found[4].n_removed, found[4].n_spans) == (50_000 - 1, 1)
    assert (found[5].n_removed, found[5].n_spans) == (80_000 - 2, 1)


def test_difference_hash_by_brute_force():
    """Mean brightness of 9 x 8 areas, from an image blown up to their least common grid."""
    rng = np.random.default_rng(7)
    for rows in (1, 3, 8, 11):
        pixels = rng.integers(0, 256, (rows, 64, 3), np.uint8)
        grey = np.kron(pixels.astype(float).mean(2), np.ones((8, 9)))
        cells = grey.reshape(8, rows, 9, 64).mean((1, 3))
        bits = "".join("01"[int(cells[i, j] < cells[i, j + 1])] for i in range(8) for j in range(8))
        assert media.difference_hash(pixels) == f"{int(bits, 2):016x}"


def test_images_in_strips(monkeypatch):
    """A long image gives the same sums however it is cut."""
    pixels = np.random.default_rng(8).integers(0, 256, (1000, 64, 3), np.uint8)
    whole = media.resize(pixels, 16, 16), media.difference_hash(pixels)
    for strip in (1, 3 * 64 * 7, 3 * 64 * 999):
        monkeypatch.setattr(media, "STRIP", strip)
        assert np.array_equal(media.resize(pixels, 16, 16), whole[0]) and media.difference_hash(pixels) == whole[1]


def test_near_duplicates_against_plain_strings(spark, sf_dir):
    """Similarity from shingles as tuples of strings and plain counts: pairs well above 0.8 share a class, and every class is
    held together by pairs that are near it."""
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(table(spark, sf_dir, "documents")).collect()}
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    text_of = dict(rows)
    for i in sets:
        for j in sets:
            if i < j and (sets[i].keys() & sets[j].keys() or text_of[i] == text_of[j]):
                shared = sum((sets[i] & sets[j]).values())
                alike = shared / max(1, sum((sets[i] | sets[j]).values()))
                if text_of[i] == text_of[j] or alike >= 0.85:
                    assert found[i] == found[j]
                if text_of[i] == text_of[j] or alike >= 0.75:
                    parent[root(i)] = root(j)
    assert all(root(i) == root(c) for i, c in found.items())
