"""Long texts as segments that are analysed one by one (T08): places in the text, not copies of it."""

from __future__ import annotations

import re

# Code points in a segment, and how far windows of an overlong sentence overlap.
SEGMENT, OVERLAP = 4_096, 256
# End of the fixed values.

#: White space behind the end of a sentence belongs to that sentence, so segments join to the whole text.
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_BREAK = re.compile(r"[\s.,;:!?]")


def _windows(text: str, start: int, stop: int, length: int, overlap: int) -> list[tuple[int, int]]:
    """Overlapping windows of one sentence, each ending behind a space or mark if one lies within the overlap."""
    found = []
    while True:
        end = min(stop, start + length)
        if end < stop:
            end = next((k for k in range(end, start + length - overlap, -1) if _BREAK.match(text, k - 1)), end)
        found.append((start, end))
        if end >= stop:
            return found
        start = max(end - overlap, start + 1)


def segment_spans(text: str, length: int = SEGMENT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, stop) in code points. Sentences are packed while they fit; a longer sentence has windows of its own."""
    if len(text) <= length:
        return [(0, len(text))]
    found, first, last = [], 0, 0
    for end in [*(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]:
        if end - last > length:
            if last > first:
                found.append((first, last))
            found += _windows(text, last, end, length, overlap)
            first = end
        elif end - first > length:
            found.append((first, last))
            first = last
        last = end
    return found + [(first, last)] * (last > first)
