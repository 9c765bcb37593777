"""Normalised texts, words by Unicode's rules, and decoded host labels (S03-S06, L11), in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a step in Python holds at a time.
FEW_TEXTS = 200
# End of the fixed values.

_SPACE = regex.compile(r"[\s﻿]+")
_BREAK = regex.compile(r"\b", flags=regex.WORD)
_WORDLIKE = regex.compile(r"[\p{L}\p{N}\p{Extended_Pictographic}]")


def collapsed(text: str | None) -> str:
    """White-space runs as one space, ends trimmed."""
    return _SPACE.sub(" ", text or "").strip()


def normalize_text(text: str | None, lower: bool = True) -> str:
    """White-space runs become one space, ends are trimmed, then NFC, NFKC and lower case."""
    text = collapsed(text)
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFC", text))
    return text.lower() if lower else text


def words(text: str) -> list[str]:
    """Word-like segments between Unicode word breaks."""
    return [w for w in _BREAK.split(text) if w and _WORDLIKE.search(w)]


def decode_label(label: str) -> str:
    """A host label's characters; one that can't be decoded stays as it is."""
    if not label.startswith("xn--"):
        return label
    try:
        return label[4:].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError):
        return label


def n_words(text: str) -> int:
    return sum(1 for w in _BREAK.splititer(text) if w and _WORDLIKE.search(w))


# texts become Python strings one by one, or a few at a time: an Arrow batch has up to 10,000 of them
@F.arrow_udf(T.StringType())
def normalized(text: pa.Array) -> pa.Array:
    parts = [pa.array([normalize_text(t.as_py()) for t in text[k : k + FEW_TEXTS]], pa.string()) for k in range(0, len(text), FEW_TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """How many words the normalised text has."""
    return pa.array((n_words(normalize_text(t.as_py())) for t in text), pa.int64())


@F.pandas_udf(T.StringType())
def decoded_host(host: pd.Series) -> pd.Series:
    return host.map(lambda h: None if h is None else ".".join(map(decode_label, h.lower().split("."))))
