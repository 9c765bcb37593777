"""Phrases and literals found by one automaton (a trie with failure links) in a single pass over each text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import regex

from pellucid.functions.unicode import collapsed, normalize_text

# Characters that hide in a text, and those that make up words.
INVISIBLE, BIDI, JOIN = "­​⁠﻿", "؜‎‏‪-‮⁦-⁩", "‌‍"
# End of the fixed values.

TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: The same words of a text that is all ASCII, as most texts are.
_ASCII_TOKEN = re.compile("[A-Za-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}\p{Pc}]")
_HIDDEN = regex.compile(f"[{INVISIBLE}{BIDI}{JOIN}]")


def automaton(keys: list[str]) -> ahocorasick.Automaton:
    """Finds every occurrence of every key, overlapping ones too, and tells it by the key's number."""
    made = ahocorasick.Automaton()
    for k, key in enumerate(keys):
        made.add_word(key, (k, len(key)))
    if keys:
        made.make_automaton()
    return made


def words_of(text: str) -> list[str]:
    return (_ASCII_TOKEN if text.isascii() else TOKEN).findall(text)


class PhraseFinder:
    """Phrases (words, one space apart) where they follow each other in a text, with their places in it."""

    def __init__(self, phrases: list[str]):
        self.phrases = phrases
        self.lengths = [p.count(" ") for p in phrases]
        self.found = automaton([f" {p} " for p in phrases])

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(number of the phrase, start, stop) in code points of the text, in order of their ends."""
        if not self.phrases:
            return
        padded = f" {' '.join(words_of(text)).lower()} "
        spans, spaces, at = None, 0, 0
        for end, (k, _) in self.found.iter(padded):
            if spans is None:
                spans = [m.span() for m in (_ASCII_TOKEN if text.isascii() else TOKEN).finditer(text)]
            # the word before a space has as many spaces before it as words
            spaces, at = spaces + padded.count(" ", at, end), end
            last = spaces - 1
            yield k, spans[last - self.lengths[k]][0], spans[last][1]


def mapping_reliable(text: str) -> bool:
    """Whether places in the normalised text are places in the text: same words, nothing hidden, no compatibility forms."""
    if text.isascii():
        return True
    if _HIDDEN.search(text):
        return False
    whole = unicodedata.normalize("NFC", collapsed(text))
    if unicodedata.normalize("NFKC", whole) != whole:
        return False
    own = [unicodedata.normalize("NFKC", t.lower()) for t in TOKEN.findall(text)]
    return own == TOKEN.findall(normalize_text(text))


def bordered(text: str, start: int, stop: int) -> bool:
    """Whether no letter, mark, digit or connector touches a stretch of the text."""
    return not (start and _WORD.match(text, start - 1)) and not (stop < len(text) and _WORD.match(text, stop))


def literal_hits(found: ahocorasick.Automaton, text: str) -> set[int]:
    """Numbers of the keys that occur between borders somewhere in the text."""
    if not len(found):
        return set()
    out: set[int] = set()
    for end, (k, size) in found.iter(text):
        if k not in out and bordered(text, end + 1 - size, end + 1):
            out.add(k)
    return out
