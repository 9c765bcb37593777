"""Ids of whole batches of texts for vocabularies whose words white space parts: each distinct word of a batch is looked up once.

Texts are split, their pieces numbered and parted into a word and the marks behind it as Arrow arrays, without a Python
string for each occurrence. The ids of the distinct words and marks, which :class:`PieceEncoder` gives and keeps, are
then gathered by number.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pellucid.llm.bpe import KEPT_PIECES, PIECE_CHARS, PieceEncoder

#: White space beyond ASCII's, and separators that some take for it: such texts are encoded one by one.
_OTHER_SPACE = r"[\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Words whose ids don't depend on the ASCII marks behind them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = f"^[{_LETTERS}]+[!-/:-@\\[-`{{-~]*$"


class _Gather:
    """Lists of ids, one after the other, from which lists are picked by number."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes = ids, sizes
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, lists: list[bytes]) -> _Gather:
        return cls(np.frombuffer(b"".join(lists), dtype="<u4"), np.array([len(x) for x in lists], dtype=np.int64) // 4)

    def pick(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the picked lists in a row, where each begins and the last ends)."""
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(self.starts[numbers] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _kept(encoder: PieceEncoder, names: list[str], encode) -> list[bytes]:
    encoder._keep([n for n in names if n not in encoder.kept], encode)
    return [encoder.kept[n] for n in names]


def _pieces(encoder: PieceEncoder, pieces: pa.Array) -> _Gather:
    """The ids of distinct pieces: those of a word and of the marks behind it, or of what is no such pair."""
    if len(encoder.kept) > KEPT_PIECES:
        encoder.kept.clear()
    plain = pc.and_(pc.match_substring_regex(pieces, _PLAIN), pc.less_equal(pc.utf8_length(pieces), PIECE_CHARS)).to_numpy(zero_copy_only=False)
    chosen = pieces.filter(pa.array(plain))
    words = pc.utf8_lower(pc.utf8_rtrim(chosen, string.punctuation)).dictionary_encode()
    marks = pc.replace_substring_regex(chosen, f"^[{_LETTERS}]+", "").dictionary_encode()
    whole = lambda part: encoder.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
    lists = _kept(encoder, words.dictionary.to_pylist(), encoder._merge)
    behind = marks.dictionary.to_pylist()
    known = dict(zip(filled := [m for m in behind if m], _kept(encoder, filled, whole), strict=True))
    others = pieces.filter(pa.array(~plain)).to_pylist()
    short, long_ones = [p for p in others if 0 < len(p) <= PIECE_CHARS], [p for p in others if len(p) > PIECE_CHARS]
    known |= dict(zip(short, _kept(encoder, short, whole), strict=True)) | dict(zip(long_ones, _kept(encoder, long_ones, whole), strict=True)) | {"": b""}
    for p in long_ones:
        del encoder.kept[p]
    # two lists for each piece, the second one empty where a piece is one whole
    every = _Gather.of([*lists, *(known[m] for m in behind), *(known[p] for p in others), b""])
    at = np.full((len(pieces), 2), len(every.sizes) - 1)
    at[plain, 0], at[plain, 1] = words.indices.to_numpy(), len(lists) + marks.indices.to_numpy()
    at[~plain, 0] = len(lists) + len(behind) + np.arange(len(others))
    ids, ends = every.pick(at.ravel())
    return _Gather(ids, np.diff(ends[::2]))


def encode_texts(encoder: PieceEncoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, where each begins and the last ends); a missing text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = np.flatnonzero(pc.match_substring_regex(texts, _OTHER_SPACE).to_numpy(zero_copy_only=False))
    lists = pc.ascii_split_whitespace(texts)
    numbered = lists.values.dictionary_encode()
    flat, ends = _pieces(encoder, numbered.dictionary).pick(numbered.indices.to_numpy())
    edges = ends[lists.offsets.to_numpy()]
    if not len(odd):
        return flat, edges
    rows = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for k in odd:
        rows[k] = np.frombuffer(encoder.encode(texts[int(k)].as_py()), dtype="<u4")
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
