"""Byte-pair encoding and decoding of whole texts with published vocabularies.

A vocabulary file (``tokenizers`` JSON) holds the pieces, the ordered merges and the special strings.  A text is
cut at special strings, each stretch is normalised and split into short words by the file's own pattern, and every
word is merged by :meth:`BpeModel.merge`:

* the word's part boundaries sit in one contiguous list, beside it the rank of each adjacent pair;
* the list of ranks is scanned for its minimum (the leftmost on ties);
* the boundary under it is deleted and the two neighbouring ranks are looked up again.

The scan is quadratic, which is fastest for short words; words of over ``LONG_WORD`` symbols take a heap with the
same order of merges, so one endless word can't stall a task.

Defined results: a null text counts as empty; an empty text has no ids; a text of any length is encoded whole, a batch's texts
in memory at a time; a null id is carried along; repeated rows are encoded alike; columns other than the id and text columns
aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of more symbols than this are merged with a heap.
LONG_WORD = 256
#: A worker's cache of words is emptied beyond this many entries; words over CACHED_CHARS never enter it.
CACHE_WORDS = 600_000
CACHED_CHARS = 48
NO_RANK = 1 << 60
#: The public pattern in a form that never steps back far, for texts of any length.
WORDS_AT_ONCE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)}
    hidden = (b for b in range(256) if b not in shown)
    moved = {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(moved.get(b, b)) for b in range(256)]


#: Characters below this are of one kind and have one normalised form in all versions of Unicode in use.
SETTLED = 0x250
#: Code points outside these ranges are unassigned or private in every version of Unicode so far.
ASSIGNED = ((SETTLED, 0xD800), (0xE000, 0x33480), (0xE0000, 0xE0200))
#: A character of each kind that the words' patterns tell apart, which none of them names itself.
STAND_INS = {r"\p{L}": "ü", r"\p{N}": "7", r"\s": " ", "": "!"}
#: The ASCII characters of the kinds that the words' patterns name, inside brackets.
ASCII_KINDS = {"L": "a-zA-Z", "N": "0-9", "White_Space": " \\t-\\r"}
#: Surroundings in which a character's normalised form shows.
SURROUNDINGS = ("{}", "a{}\u0323", "{}\u0301")


def settled(text: str) -> bool:
    """Whether a text has only characters below SETTLED."""
    return text.isascii() or int(np.frombuffer(text.encode("utf-16-le"), "<u2").max()) < SETTLED


def ascii_pattern(pattern: str) -> str:
    """What a pattern of words says of ASCII characters, without Unicode's properties."""
    out, inside = [], False
    for part in regex.split(r"(\\[pP]\{\w+\}|\\.|[\[\]])", pattern):
        if part[:2] in (r"\p", r"\P"):
            ranges, no = ASCII_KINDS[part[3:-1]], "^" * (part[1] == "P")
            out.append(ranges if inside else f"[{no}{ranges}]")
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
    return "".join(out)


def odd_characters(normaliser, normalise: Callable[[str], str]) -> dict[str, str]:
    """Characters that the library's tables and Python's tell apart, by kind or by normalised form, each with a stand-in of
    the library's kind; found over all code points from what the library makes of them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = [chr(i) for low, high in ASSIGNED for i in range(low, high)]
    text, kind, odd = "".join(every), np.full(len(every), "", object), np.zeros(len(every), bool)
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        inside = np.ones(len(every), bool)
        for _, (low, high) in Split(Regex(name), "removed").pre_tokenize_str(text):
            inside[low:high] = False
        own = regex.compile(name.replace(r"\s", r"\p{White_Space}"))
        odd |= inside != np.fromiter((own.match(c) is not None for c in every), bool, len(every))
        kind[inside] = name
    shown = np.flatnonzero(kind != r"\s")  # white space only parts words
    for around in SURROUNDINGS if normaliser else ():
        whole = "0".join(around.format(every[i]) for i in shown)
        found, expected = normaliser.normalize_str(whole).split("0"), normalise(whole).split("0")
        odd[shown] |= np.fromiter((a != b for a, b in zip(found, expected, strict=True)), bool, len(shown))
    return {every[i]: STAND_INS[kind[i]] for i in np.flatnonzero(odd)}


class BpeModel:
    """One vocabulary file, read once a worker (see :func:`load`)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks: dict[tuple[str, str], int] = {pair: rank for rank, pair in enumerate(pairs)}
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.vocab.values(), *self.specials.values()])
        steps = spec.get("normalizer") or {}
        self.normal = [s["type"] for s in steps.get("normalizers", [steps] if steps else [])]
        self.path = path
        self.words = regex.compile(self._pattern(spec["pre_tokenizer"]))
        self.ascii_words = re.compile(ascii_pattern(self.words.pattern), re.ASCII)
        at = "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))
        self.cut = regex.compile(f"({at})") if at else None
        self.table = dict(enumerate(byte_symbols()))
        back = {ord(c): b for b, c in self.table.items()}
        self.pieces: list[bytes] = [b""] * self.size
        for text, i in self.vocab.items():
            bare = text[: -len(self.suffix)] + " " if self.suffix and text.endswith(self.suffix) else text
            self.pieces[i] = bytes(back.get(ord(c), 32) for c in bare)
        for text, i in self.specials.items():
            self.pieces[i] = text.encode()

    @staticmethod
    def _pattern(spec: dict) -> str:
        """The words' pattern with the library's meaning of white space (the Unicode property)."""
        parts = spec.get("pretokenizers", [spec])
        found = next((p["pattern"]["Regex"] for p in parts if p["type"] == "Split"), None)
        if found is None:
            import public_tokenizers

            found = public_tokenizers.PATTERN
        inside = found.replace(r"[^\s", r"[^\p{White_Space}")
        return inside.replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})")

    @cached_property
    def normaliser(self):
        """The library's own, for texts with characters on which Python's differs."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).normalizer

    @cached_property
    def odd(self) -> dict[int, str]:
        return str.maketrans(odd_characters(self.normaliser, self._normalised))

    @cached_property
    def _odd_set(self) -> frozenset[str]:
        return frozenset(map(chr, self.odd))

    def is_odd(self, text: str) -> bool:
        return not (settled(text) or self._odd_set.isdisjoint(text))

    def normalise(self, text: str) -> str:
        if self.normal and self.is_odd(text):
            return self.normaliser.normalize_str(text)
        return self._normalised(text)

    def split(self, text: str) -> list[str]:
        """The words of a normalised text, as the library cuts it."""
        if text.isascii():
            return self.ascii_words.findall(text)
        if self.is_odd(text):
            return [text[m.start() : m.end()] for m in self.words.finditer(text.translate(self.odd))]
        return self.words.findall(text)

    def _normalised(self, text: str) -> str:
        if "NFC" in self.normal and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.normal:  # by single characters: a capital sigma never becomes a final one
            text = text.replace("Σ", "σ").lower()
        return text

    def parts(self, text: str) -> Iterator[tuple[str | None, str]]:
        """(special string or None, normalised text): the text in order."""
        for i, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else [text]):
            if i % 2:
                yield part, ""
            elif part:
                yield None, self.normalise(part)

    def stretches(self, text: str) -> Iterator[tuple[str | None, list[str]]]:
        """(special string or None, words): the text in order."""
        for mark, part in self.parts(text):
            yield mark, self.split(part)

    def merge(self, word: str) -> list[str]:
        """The word's pieces, as the vocabulary writes them."""
        return self.merge_symbols(word.encode().decode("latin-1").translate(self.table))

    def merge_symbols(self, text: str, ended: bool = True) -> list[str]:
        """The same of a word (or, unless ``ended``, of a part before its end) written with a character a byte."""
        suffix = self.suffix if ended else ""
        ends = [*range(len(text)), len(text) + len(suffix)]
        text += suffix
        if len(ends) > LONG_WORD:
            return self._merge_long([text[a:b] for a, b in zip(ends, ends[1:])])
        rank = self.ranks.get
        ranks = [rank((text[ends[i] : ends[i + 1]], text[ends[i + 1] : ends[i + 2]]), NO_RANK) for i in range(len(ends) - 2)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            del ends[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((text[ends[i - 1] : ends[i]], text[ends[i] : ends[i + 1]]), NO_RANK)
            if i < len(ranks):
                ranks[i] = rank((text[ends[i] : ends[i + 1]], text[ends[i + 1] : ends[i + 2]]), NO_RANK)
        return [text[a:b] for a, b in zip(ends, ends[1:])]

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, rank = len(parts), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        live: list[str | None] = [*parts]
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if live[i] is None or j >= n or rank((live[i], live[j])) != r:
                continue
            live[i] += live[j]
            live[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank((live[a], live[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in live if p is not None]

    def ids(self, word: str) -> list[int]:
        return [self.vocab[p] for p in self.merge(word)]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for special, words in self.stretches(text or ""):
            out += [self.specials[special]] if special else [i for w in words for i in self.ids(w)]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> BpeModel:
    return BpeModel(path)


class WordCache(dict):
    """word -> what ``make`` gives for it, kept for a bounded number of short words: when one generation is full, the
    next begins, and words used again move on to it."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.older = make, {}

    def keep(self, word: str, made: object) -> None:
        if len(self) >= CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
        self[word] = made

    def __missing__(self, word: str):
        made = self.older[word] if word in self.older else self.make(word)
        if len(word) <= CACHED_CHARS:
            self.keep(word, made)
        return made


@lru_cache(maxsize=4)
def merged_words(path: str, pack: Callable[[BpeModel, list[int]], object]) -> WordCache:
    """The worker's cache of words merged by :meth:`BpeModel.merge`; it outlives a task."""
    model = load(path)
    return WordCache(lambda word: pack(model, model.ids(word)))


class RankWords:
    """Texts' ids as little-endian bytes, by ``tiktoken`` from the file's own vocabulary and merges.

    ``tiktoken`` joins any neighbours whose bytes stand in its table, the file's rules only its pairs.  Both come to
    the same where the table holds just the strings that the rules, applied to such a string alone, make one piece: what
    happens inside a string doesn't depend on its surroundings, so a string that isn't one piece alone never becomes
    one.  That is settled here by merging every vocabulary string (:meth:`BpeModel.merge`).  Where words have an end
    mark, a space stands for it (words have none) and joins the last byte before all else, as in the file."""

    def __init__(self, path: str, width: int):
        from tiktoken import Encoding

        self.model, self.kind = load(path), {2: "<u2", 4: "<u4"}[width]
        model, back = self.model, {c: b for b, c in self.model.table.items()}
        self.marked = bool(model.suffix)
        ranks: dict[bytes, int] = {}
        ids: dict[int, int] = {}

        def add(text: str, rank: int) -> None:
            bare = text.removesuffix(model.suffix) if self.marked else text
            ranks[bytes(back[c] for c in bare) + b" " * (bare != text)] = rank
            ids[rank] = model.vocab[text]

        for b, c in model.table.items():
            add(c, b)
            if self.marked:
                add(c + model.suffix, 256 + b)
        for (left, right), rank in model.ranks.items():
            ended = self.marked and right.endswith(model.suffix)
            bare = (left + right).removesuffix(model.suffix) if ended else left + right
            if len(model.merge_symbols(bare, ended)) == 1:
                add(left + right, 512 + rank)
        self.ids = np.zeros(max(ids) + 1, self.kind)
        self.ids[list(ids)] = list(ids.values())
        pattern = "[^ ]++ " if self.marked else WORDS_AT_ONCE
        self.library = Encoding("table", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def special(self, i: int) -> bytes:
        return np.array([i], self.kind).tobytes()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        model = self.model
        for text in texts:
            out = []
            for mark, part in model.parts(text or ""):
                if mark:
                    out.append(self.special(model.specials[mark]))
                    continue
                if self.marked:
                    part = " ".join(model.split(part)) + " "
                found = self.library.encode_to_numpy(part, disallowed_special=())
                out.append(self.ids[found].tobytes())
            yield out[0] if len(out) == 1 else b"".join(out)


@lru_cache(maxsize=4)
def rank_words(path: str, width: int) -> RankWords:
    return RankWords(path, width)


def id_width(path: str) -> int:
    """Bytes that hold any id of the vocabulary."""
    return 2 if load(path).size <= 1 << 16 else 4


def per_text(model: BpeModel, cache: WordCache, special: Callable[[int], object], text: str | None) -> list:
    """What the cache holds for each word of a text and ``special`` for each special id, in order."""
    out: list = []
    for mark, words in model.stretches(text or ""):
        if mark:
            out.append(special(model.specials[mark]))
        else:
            out += map(cache.__getitem__, words)
    return out


def plain_ids(_: BpeModel, ids: list[int]) -> list[int]:
    return ids


def ids_and_bytes(model: BpeModel, ids: list[int]) -> tuple[str, bytes]:
    """The decimal ids joined by commas, and the bytes they decode to."""
    return ",".join(map(str, ids)), b"".join([model.pieces[i] for i in ids])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = load(path), merged_words(path, plain_ids)
        for batch in batches:
            ids = [[i for p in per_text(model, cache, lambda i: [i], t) for i in p] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of rows with arrays of ids; a null array decodes to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    rows = encoded.select(F.col(id_col), F.col(ids_col))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids, the digest of the ids and the digest of the text decoded from them.

    Ids and decoded bytes are made once for each distinct word of a worker's cache; both digests are over the whole
    document, joined in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = load(path), merged_words(path, ids_and_bytes)
        for batch in batches:
            counts, id_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                parts = per_text(model, cache, lambda i: ids_and_bytes(model, [i]), text)
                ids = ",".join([p[0] for p in parts])
                decoded = b"".join([p[1] for p in parts]).decode("utf-8", "replace")
                counts.append(ids.count(",") + 1 if ids else 0)
                id_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
