"""Hashes of many byte spans at once: prefix sums of a polynomial modulo 2^64, the same in every process."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15
BASE = 0xD1342543DE82EF95  # odd, so it has an inverse
#: Bytes of text hashed together.
GROUP_BYTES = 1 << 21


def _scrambled(i: int) -> int:
    z = (i + 1) * GOLDEN & MASK
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
    return z ^ z >> 31


def numbers(n: int, seed: int = 0) -> np.ndarray:
    """n odd 64-bit numbers by rule."""
    return np.array([_scrambled(seed * 1_000_003 + i) | 1 for i in range(n)], np.uint64)


BYTES = numbers(256)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, from 0 to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of which :func:`spans` makes the hash of any span."""
    up, _ = _table(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    return sums


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each pair, equal for equal bytes."""
    _, down = _table(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """The hash of every window of ``size`` bytes."""
    _, down = _table(len(sums) - 1)
    return mix((sums[size:] - sums[:-size]) * down[: len(sums) - size] + np.uint64(size))


def groups(items: Iterable[tuple], size: int = GROUP_BYTES) -> Iterator[list[tuple]]:
    """Runs of (key, bytes, ...) items of about ``size`` bytes."""
    held, total = [], 0
    for item in items:
        held.append(item)
        total += len(item[1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SHINGLE = 5
STEPS = numbers(SHINGLE, 1)


def shingles(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its 5-word runs; a text of 1 to 4 words has its whole run of words, one of none has none."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sums = prefix(data)
    gap = SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    words = spans(sums, starts, ends)
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    if len(words) >= SHINGLE:
        size = len(words) - SHINGLE + 1
        runs = np.zeros(size, np.uint64)
        for k in range(SHINGLE):
            runs += words[k : k + size] * STEPS[k]
        runs = mix(runs)
    for i in range(len(texts)):
        n = at[i + 1] - at[i]
        if n >= SHINGLE:
            yield runs[at[i] : at[i + 1] - SHINGLE + 1]
        elif n:
            yield mix((words[at[i] : at[i + 1]] * STEPS[:n]).sum(keepdims=True))
        else:
            yield words[:0]
