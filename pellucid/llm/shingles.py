"""Vectorised hashing of words and word shingles inside Arrow tasks.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D`` after A-Z became a-z. Words are hashed to 64
bits by a polynomial over the UTF-8 bytes, evaluated for all words of a block at once from running
sums; a shingle's hash is a polynomial over the mixed hashes of its words. Texts are cut into
blocks at white space, so that a very long text needs no more memory than its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_tables: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash's base, or of its inverse modulo 2 ** 64."""
    name = "down" if inverse else "up"
    have = _tables.get(name)
    if have is None or len(have) < n:
        row = np.full(max(n, BLOCK_BYTES + 1), _BASE_INVERSE if inverse else _BASE, dtype=np.uint64)
        row[0] = 1
        have = _tables[name] = np.multiply.accumulate(row)
    return have[:n]


def byte_values() -> np.ndarray:
    """A random 64-bit value for each byte."""
    if "bytes" not in _tables:
        _tables["bytes"] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    return _tables["bytes"]


def _block_words(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of one block of lower-cased bytes."""
    solid = ~_WHITE[block]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    n = len(block)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(byte_values()[block] * powers(n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(n + 1, inverse=True)[starts]
    return starts, mix64(hashes + (ends - starts).astype(np.uint64))


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of at most about BLOCK_BYTES, each with the first byte of the texts' parts in it."""
    held: list[bytes] = []
    marks: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            room = BLOCK_BYTES - size
            if len(text) - at <= room:
                part, at = text[at:], len(text)
            elif size:
                part = b""
            else:  # one text is longer than a block: cut it at white space
                end = at + BLOCK_BYTES
                while end < len(text) and not _WHITE[text[end]]:
                    end += 1
                part, at = text[at:end], end
            if part:
                held += [part, b" "]
                marks.append(k)
                marks.append(size)
                size += len(part) + 1
            if at >= len(text):
                break
            yield np.frombuffer(b"".join(held), dtype=np.uint8), np.array(marks, dtype=np.int64).reshape(-1, 2)
            held, marks, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), dtype=np.uint8), np.array(marks, dtype=np.int64).reshape(-1, 2)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's first word (one entry more)."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for block, marks in _pieces(texts):
        starts, found = _block_words(_LOWER[block])
        hashes.append(found)
        owners.append(marks[np.searchsorted(marks[:, 1], starts, side="right") - 1, 0])
    owner = np.concatenate(owners)
    return np.concatenate(hashes), np.searchsorted(owner, np.arange(len(texts) + 1))


def shingle_sets(texts: Iterable[bytes | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle.

    A missing text and a text without words have the empty set.
    """
    texts = [t or b"" for t in texts]
    words, first = word_hashes(texts)
    if len(words) >= width:
        rolled = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * _STEP + words[k : len(words) - width + 1 + k]
        rolled = mix64(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                short = short * _STEP + words[k : k + 1]
            yield mix64(short)
        else:
            yield np.zeros(0, np.uint64)
