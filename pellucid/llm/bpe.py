"""Exact encoding of whole texts with files of the ``tokenizers`` library, piece by piece.

A *piece* is white space and the run of other characters behind it. Both kinds of public vocabulary
split text before merging, never across a change from a visible character to white space, and what
follows such a change is encoded without regard to what precedes it. So a text's ids are those of its
pieces in a row, and frequent pieces need encoding only once for each Python worker.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Python takes these four for white space, Unicode's property (and so the library) doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PIECES = re.compile(r"\s*\S+")
#: Longer pieces are encoded without being kept.
PIECE_CHARS = 48
#: Pieces kept at most; then all are forgotten.
KEPT_PIECES = 400_000
#: Pieces that the library encodes in one call.
PIECES_AT_ONCE = 4096
ID = "I"

#: A word, with at most one space before it, that every Unicode version takes for letters, and ASCII marks.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

def _byte_chars() -> list[str]:
    """How byte-level vocabularies write each byte.

    The printable Latin-1 bytes stand for themselves, the others, in order, for U+0100 and on.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_CHARS = _byte_chars()

_encoders: dict[tuple[str, bool], PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts to unsigned 32-bit ids in native byte order.

    drops_space: the vocabulary's splitter throws white space away, so pieces go without it.
    """

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.drops_space = drops_space
        #: The merges alone, for words that need nothing before them.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.kept: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, drops_space: bool) -> PieceEncoder:
        """One encoder for each worker process, which keeps its pieces from task to task."""
        if (path, drops_space) not in _encoders:
            _encoders[path, drops_space] = cls(path, drops_space)
        return _encoders[path, drops_space]

    def _pieces(self, text: str) -> list[str]:
        if self.drops_space:
            return text.split()
        pieces = _PIECES.findall(text)
        if rest := len(text) - sum(map(len, pieces)):  # white space at the end belongs to the last piece
            if pieces:
                pieces[-1] += text[-rest:]
            else:
                pieces = [text]
        return pieces

    def _keep(self, names: list[str], encode) -> None:
        """Encode what the names stand for, many in one call; numbers of words lead back to them."""
        for at in range(0, len(names), PIECES_AT_ONCE):
            part = names[at : at + PIECES_AT_ONCE]
            found = encode(part)
            ids = np.array(found.ids, dtype=np.uint32).tobytes()
            edge = (4 * np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(part) + 1))).tolist()
            self.kept.update((name, ids[a:b]) for name, a, b in zip(part, edge[:-1], edge[1:], strict=True))

    def _merge(self, words: list[str]):
        """Words of Latin letters, as the merges take them."""
        return self.words.encode(" ".join(w if w.isascii() and w[0] != " " else "".join(map(_CHARS.__getitem__, w.encode())) for w in words), add_special_tokens=False)

    def _add(self, fresh: list[str]) -> None:
        """Encode new pieces: a word of Latin letters and the marks behind it are encoded apart, which is faster."""
        split, words, others = [], set(), set()
        for piece in fresh:
            plain = _PLAIN.fullmatch(piece) if len(piece) <= PIECE_CHARS else None
            if plain is None:
                others.add(piece)
                continue
            word, marks = plain.groups()
            if self.drops_space:
                word = word.lower()
            words.add(word)
            if marks:
                others.add(marks)
            split.append((piece, word, marks))
        self._keep([w for w in words if w not in self.kept], self._merge)
        self._keep([p for p in others if p not in self.kept], lambda part: self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False))
        self.kept.update((piece, self.kept[word] + self.kept[marks] if marks else self.kept[word]) for piece, word, marks in split)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what the texts have in new pieces is encoded first."""
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        pieces = [None if _SEPARATORS.search(t) else self._pieces(t) for t in texts]
        fresh = [p for p in set().union(*filter(None, pieces)) if p not in self.kept]
        self._add(fresh)
        get = self.kept.__getitem__
        out = [
            array(ID, self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if p is None else b"".join(map(get, p))
            for t, p in zip(texts, pieces, strict=True)
        ]
        for piece in fresh:
            if len(piece) > PIECE_CHARS:
                del self.kept[piece]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def byte_table(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    byte_of = {c: b for b, c in enumerate(_CHARS)}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        known = all(c in byte_of for c in token)
        table[i] = bytes(byte_of[c] for c in token) if known else token.encode()
    return table
