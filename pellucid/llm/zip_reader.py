"""Random access to stored members of ZIP and ZIP64 archives by range reads, without extraction.

Only the end of an archive, its central directory and the asked-for ranges are read. The names below
are those of the public ZIP application note; all numbers are little-endian.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

_END, _END64_LOCATOR, _END64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_END_SIZE, _MAX_COMMENT, _LOCATOR_SIZE = 22, 0xFFFF, 20
STORED = 0


class ZipError(ValueError):
    """The bytes are not those of a readable archive."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def _zip64(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
    """The three numbers with those that are all ones taken from the ZIP64 field, in its order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return tuple(next(wide) if v == 0xFFFFFFFF else v for v in (size, packed, header))
        at += 4 + length
    return size, packed, header


class ZipReader:
    """source: an open file with seek and read; only ``size`` more is needed."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.members = {m.name: m for m in self._directory()}

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.size - _END_SIZE - _MAX_COMMENT)
        tail = self._at(tail_at, self.size - tail_at)
        end = tail.rfind(_END)
        if end < 0:
            raise ZipError("no end of central directory")
        count, length, offset = struct.unpack_from("<HLL", tail, end + 10)
        if count == 0xFFFF or 0xFFFFFFFF in (length, offset):
            locator = self._at(tail_at + end - _LOCATOR_SIZE, _LOCATOR_SIZE)
            if locator[:4] != _END64_LOCATOR:
                raise ZipError("no ZIP64 locator")
            record = self._at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != _END64:
                raise ZipError("no ZIP64 end of central directory")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
        data, at, found = self._at(offset, length), 0, []
        for _ in range(count):
            if data[at : at + 4] != _ENTRY:
                raise ZipError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, n_name, n_extra, n_comment = struct.unpack_from("<LLHHH", data, at + 20)
            header = struct.unpack_from("<L", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            found.append(Member(name, method, *_zip64(extra, size, packed, header)))
            at += 46 + n_name + n_extra + n_comment
        return found

    def data_offset(self, name: str) -> int:
        """Where a stored member's bytes begin in the archive."""
        member = self.members[name]
        if member.method != STORED:
            raise ZipError(f"{name} is compressed")
        local = self._at(member.header, 30)
        if local[:4] != _LOCAL:
            raise ZipError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return member.header + 30 + n_name + n_extra

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        size = self.members[name].size
        length = size - offset if length is None else min(length, size - offset)
        return self._at(self.data_offset(name) + offset, length)
