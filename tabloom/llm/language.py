"""Language ID by unigram pieces, summed over all segmentations.

A fixed public vocabulary gives the pieces.  Each language has a probability for every piece, and a word's probability
is the sum over all ways to cut it into pieces, found by the forward algorithm; a text's is the product over its
words (lower-cased runs of letters of any length after a word mark).  Words are scored once a worker's cache, all
missing words of a batch in step; sums over words of over PLAIN letters are kept as logarithms, so none underflows.

Training: words are counted by language over all rows given; each distinct word of a task gets its expected piece
counts by forward and backward sums with all pieces equally likely, and tasks add up counts by (language, piece), at
most the vocabulary's size a language each.  The model is a matrix of the vocabulary by the languages learned, on
the driver and in workers; words are scored in blocks of TABLE numbers, however long they are and however many languages.

Score: the best language's share after softmax over the languages' mean log-probabilities a word, sharpened by
min(words, SHARP) so that short texts stay unsure.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from, all are
``und``; of languages with equal scores the alphabetically first is given; rows without a language train nothing; equal texts get equal results; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import CACHES, turn

MARK = "▁"
#: Words of more letters are summed by logarithms.
PLAIN = 24
#: Numbers of a table of forward sums, unless a single word's is larger.
TABLE = 1 << 21
SMOOTHING = 0.1
SHARP = 8
CACHE_WORDS = 400_000
#: Distinct words that a task counts before it turns them into pieces.
COUNT_WORDS = 200_000
LETTERS = regex.compile(r"\p{L}+")


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """piece -> its number: the vocabulary's pieces of a word (with or without mark); 0 stands for a single letter that it lacks."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for i in range(library.get_piece_size()):
        text = library.id_to_piece(i)
        if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i)) and text == text.lower():
            if regex.fullmatch(r"▁?\p{L}*", text) and text:
                found.setdefault(text, len(found) + 1)
    return found


def words_of(text: str) -> list[str]:
    """Lower-cased words."""
    return LETTERS.findall(text.lower())


STEP = np.uint64(0x9E3779B97F4A7C15)
FIRST_BITS, SECOND_BITS = 20, 20


class PieceTable:
    """Finds pieces by the polynomial hash of their characters, for many at once: a slot by the hash's upper bits, for
    pieces whose slot is taken a second one by its lower bits; a hit must have the whole hash."""

    def __init__(self, path: str):
        known = pieces(path)
        self.most = max(map(len, known), default=1)
        self.hashes = np.zeros(len(known) + 1, np.uint64)
        with np.errstate(over="ignore"):
            for text, i in known.items():
                h = np.uint64(0)
                for c in text:
                    h = h * STEP + np.uint64(ord(c))
                self.hashes[i] = h
        if len(set(self.hashes.tolist())) != len(known) + 1:
            raise ValueError("two pieces have one hash")
        self.first, self.second = np.zeros(1 << FIRST_BITS, np.int32), np.zeros(1 << SECOND_BITS, np.int32)
        for i in range(1, len(self.hashes)):
            one, two = (slot[0] for slot in self._slots(self.hashes[i : i + 1]))
            if not self.first[one]:
                self.first[one] = i
            elif not self.second[two]:
                self.second[two] = i
            else:
                raise ValueError("a piece has no free slot")

    @staticmethod
    def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        return mixed >> np.uint64(64 - FIRST_BITS), mixed >> np.uint64(8) & np.uint64((1 << SECOND_BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces' numbers, -1 for none."""
        one, two = self._slots(h)
        a, b = self.first[one], self.second[two]
        return np.where((self.hashes[a] == h) & (a > 0), a, np.where((self.hashes[b] == h) & (b > 0), b, -1))


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def lattice(words: list[str], path: str) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For words of one length, with the word mark before them: (end, size, words, pieces) wherever pieces fit, by end."""
    table = piece_table(path)
    n = len(words[0]) + 1
    codes = np.array([MARK + w for w in words], f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
    found = []
    for start in range(n):
        h = np.zeros(len(words), np.uint64)
        for size in range(1, min(n - start, table.most) + 1):
            h = h * STEP + codes[:, start + size - 1]
            piece = table.find(h)
            if size == 1:
                piece = np.maximum(piece, 0)
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                found.append((start + size, size, hit, piece[hit]))
    return sorted(found, key=lambda x: x[:2])


def by_length(words, width: int = 1) -> Iterator[list[str]]:
    """Words of one length together, as many as a table with ``width`` numbers a letter and word holds."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, group in groups.items():
        rows = max(1, TABLE // ((n + 2) * max(1, width)))
        for at in range(0, len(group), rows):
            yield group[at : at + rows]


def expected_counts(counts: dict[str, float], path: str) -> np.ndarray:
    """Expected number of each piece over the words' counts, all segmentations weighted by 1/V a piece."""
    total = np.zeros(len(pieces(path)) + 1)
    weight = 1.0 / max(1, len(pieces(path)))
    for group in by_length(counts):
        steps = lattice(group, path)
        n, rows = len(group[0]) + 1, len(group)
        number = np.array([counts[w] for w in group], float)
        if n > PLAIN + 1:
            cost = np.log(weight)
            forward, backward = np.full((n + 1, rows), -np.inf), np.full((n + 1, rows), -np.inf)
            forward[0] = backward[n] = 0.0
            for end, size, hit, _ in steps:
                forward[end, hit] = np.logaddexp(forward[end, hit], forward[end - size, hit] + cost)
            for end, size, hit, _ in reversed(steps):
                backward[end - size, hit] = np.logaddexp(backward[end - size, hit], backward[end, hit] + cost)
            for end, size, hit, piece in steps:
                share = np.exp(forward[end - size, hit] + backward[end, hit] + cost - forward[n, hit])
                total += np.bincount(piece, share * number[hit], len(total))
            continue
        forward, backward = np.zeros((n + 1, rows)), np.zeros((n + 1, rows))
        forward[0] = backward[n] = 1.0
        for end, size, hit, _ in steps:
            forward[end, hit] += forward[end - size, hit] * weight
        for end, size, hit, _ in reversed(steps):
            backward[end - size, hit] += backward[end, hit] * weight
        scale = number / forward[n]
        for end, size, hit, piece in steps:
            total += np.bincount(piece, forward[end - size, hit] * backward[end, hit] * scale[hit] * weight, len(total))
    return total


class Model:
    """Languages in order and their log-free piece probabilities (piece, language)."""

    def __init__(self, path: str, languages: list[str], counts: np.ndarray):
        self.path, self.languages = path, languages
        smooth = counts + SMOOTHING
        self.probability = smooth / smooth.sum(0) if languages else smooth
        self.cache: dict[str, int] = {}  # word -> its row of scores
        self.scores = np.zeros((1 << 12, len(languages)))

    def fill(self, words: set[str]) -> None:
        """Scores words that the cache lacks: the logarithm of the sum over their segmentations, by language."""
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        for group in by_length(words - self.cache.keys(), len(self.languages)):
            scores = self._summed(group)
            at = len(self.cache)
            while at + len(group) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at : at + len(group)] = scores
            self.cache.update(zip(group, range(at, at + len(group))))

    def _summed(self, group: list[str]) -> np.ndarray:
        """The logarithm of each word's probability by language."""
        n = len(group[0]) + 1
        if n > PLAIN + 1:
            forward = np.full((n + 1, len(group), len(self.languages)), -np.inf)
            forward[0] = 0.0
            for end, size, hit, piece in lattice(group, self.path):
                forward[end, hit] = np.logaddexp(forward[end, hit], forward[end - size, hit] + np.log(self.probability[piece]))
            return forward[n]
        forward = np.zeros((n + 1, len(group), len(self.languages)))
        forward[0] = 1.0
        for end, size, hit, piece in lattice(group, self.path):
            forward[end, hit] += forward[end - size, hit] * self.probability[piece]
        return np.log(forward[n])

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for at in range(0, len(texts), 500):
            cut = [words_of(t or "") for t in texts[at : at + 500]]
            if not self.languages:
                yield from [("und", 0.0)] * len(cut)
                continue
            self.fill({w for words in cut for w in words})
            get = self.cache.__getitem__
            for words in cut:
                if not words:
                    yield "und", 0.0
                    continue
                mean = self.scores[np.fromiter(map(get, words), np.int64, len(words))].mean(0)
                best = int(np.argmax(mean))
                yield self.languages[best], float(1 / np.exp((mean - mean[best]) * min(len(words), SHARP)).sum())


def train(rows: DataFrame, path: str) -> Model:
    """The model of (text, lang) rows; rows without either are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        held: dict[str, Counter] = {}

        def settle() -> None:
            for lang, counts in held.items():
                totals[lang] = totals.get(lang, 0) + expected_counts(counts, path)
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > COUNT_WORDS:
                    settle()
        settle()
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(np.rint(total[at] * 1e6), pa.int64())], ["lang", "piece", "millionths"])

    known = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")
    summed = known.mapInArrow(run, "lang string, piece int, millionths long").groupBy("lang", "piece").agg(F.sum("millionths").alias("n"))
    found = summed.groupBy("lang").agg(F.collect_list(F.struct("piece", "n")).alias("counts")).toArrow()
    by_lang = {r["lang"]: r["counts"] for r in found.to_pylist()}
    languages = sorted(by_lang)
    counts = np.zeros((len(pieces(path)) + 1, len(languages)))
    for column, lang in enumerate(languages):
        for c in by_lang[lang]:
            counts[c["piece"], column] = c["n"] / 1e6
    return Model(path, languages, counts)


def predict(docs: DataFrame, model: Model, *keep: Column | str) -> DataFrame:
    """The columns ``keep``, lang_pred and score of every row; only the text is read for them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.path, model.languages, model.probability.astype(np.float32)))
    rows = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    fields = rows.schema.fields[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            found = [*scorer.predict(batch.column(0).to_pylist())]
            arrays = [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*[f.name for f in fields], "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of docs, with all their columns, in a learned language with a score of ``least`` or more; all rows where
    nothing was learned."""
    if not model.languages:
        return docs
    found = predict(docs, model, F.struct("*").alias("__row"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("__row.*")


_scorers: dict = {}
CACHES["language"] = _scorers.clear


def _scorer(shared) -> Model:
    """The worker's model for a broadcast; its cache outlives a task, until other code has its turn."""
    turn("language")
    path, languages, probability = shared.value
    token = (path, tuple(languages), hash(probability.tobytes()))
    if token not in _scorers:
        _scorers.clear()
        model = Model(path, languages, np.zeros_like(probability))
        model.probability = probability
        _scorers[token] = model
    return _scorers[token]


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
