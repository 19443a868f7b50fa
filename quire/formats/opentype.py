"""OpenType and TrueType fonts: faces of a file, their tables, and the glyph and width of a character.

Static fonts only. Big-endian fields are read where they are needed; outlines are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import pairwise

from quire.formats.errors import FormatError, Limits

#: Signatures of a face and of a collection.
FACE, COLLECTION = (b"\0\1\0\0", b"OTTO", b"true"), b"ttcf"
#: Tables without which a font cannot be measured.
NEEDED = ("OS/2", "cmap", "head", "hhea", "hmtx", "maxp", "name", "post")
MAX_FACES, MAX_TABLES = 256, 256
#: Character maps from the best to the least: (platform, encoding).
MAPS = ((3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0))


def _bad(reason: str, at: int | None = None, kind: str = "Malformed") -> FormatError:
    return FormatError(kind, reason, at, "font")


def _field(raw: bytes, at: int, width: int = 2, signed: bool = False) -> int:
    if at + width > len(raw):
        raise FormatError("Truncated", "", at, "font", (), (width, max(0, len(raw) - at)))
    return int.from_bytes(raw[at : at + width], "big", signed=signed)


def faces(data: bytes) -> list[int]:
    """Where the table directory of each face begins."""
    if data[:4] in FACE:
        return [0]
    if data[:4] != COLLECTION:
        raise _bad("neither a font nor a collection", 0, "UnsupportedFormat")
    count = _field(data, 8, 4)
    if not 0 < count <= MAX_FACES:
        raise FormatError("LimitExceeded", "faces", 8, "font", (), (MAX_FACES, count))
    return [_field(data, 12 + 4 * k, 4) for k in range(count)]


class Face:
    """One face: ``tables`` maps a tag to (checksum, offset, length)."""

    def __init__(self, data: bytes, at: int = 0, limits: Limits = Limits()):
        self.data = data
        if data[at : at + 4] not in FACE:
            raise _bad("face has no signature", at)
        count = _field(data, at + 4)
        if not 0 < count <= MAX_TABLES:
            raise FormatError("LimitExceeded", "tables", at + 4, "font", (), (MAX_TABLES, count))
        self.tables: dict[str, tuple[int, int, int]] = {}
        for row in range(at + 12, at + 12 + 16 * count, 16):
            check, offset, length = (_field(data, row + k, 4) for k in (4, 8, 12))
            tag = data[row : row + 4].decode("latin-1")
            if tag in self.tables:
                raise _bad("table stands twice", row)
            if offset + length > len(data):
                raise _bad("table extends beyond the file", row)
            self.tables[tag] = check, offset, length
        spans = sorted((o, o + n) for _, o, n in self.tables.values() if n)
        if any(b[0] < a[1] for a, b in pairwise(spans)):
            raise _bad("tables overlap", at)
        if self.tables.keys() & {"fvar", "CFF2"}:
            raise _bad("variable font", at, "UnsupportedFormat")
        missing = [t for t in NEEDED if t not in self.tables]
        if missing:
            raise _bad(f"table is missing: {missing[0]}", at)
        self.outlines = "CFF" if "CFF " in self.tables else "glyf"
        if ("CFF " in self.tables) == (self.tables.keys() >= {"glyf", "loca"}):
            raise _bad("outlines are missing or of two kinds", at)
        held = sum(self.tables[t][2] for t in NEEDED)
        if held > limits.max_allocation_bytes:
            raise FormatError("LimitExceeded", "metadata bytes", at, "font", (), (limits.max_allocation_bytes, held))
        self.units_per_em = _field(self.table("head"), 18)
        self.adjustment = _field(self.table("head"), 8, 4)
        self.glyphs = _field(self.table("maxp"), 4)
        self.measured = _field(self.table("hhea"), 34)
        if not 16 <= self.units_per_em <= 16384 or not self.glyphs or not 0 < self.measured <= self.glyphs:
            raise _bad("metrics are malformed", at)
        self.widths = self.table("hmtx")
        if len(self.widths) < 4 * self.measured:
            raise _bad("table is too short: hmtx", self.tables["hmtx"][1])

    def table(self, tag: str) -> bytes:
        _, offset, length = self.tables[tag]
        return self.data[offset : offset + length]

    @property
    def embeddable(self) -> bool:
        """Whether the font's licence bits let a subset be embedded: restricted alone never does;
        from version 2 on, neither do those against subsets and for bitmaps only."""
        version, bits = _field(self.table("OS/2"), 0), _field(self.table("OS/2"), 8)
        licensed = bits & 0xF == 0 or bits & 0xC != 0
        return licensed and (version < 2 or bits & 0x300 == 0)

    def width(self, glyph: int) -> int:
        """The advance of a glyph in units; glyphs past the last that is measured share its advance."""
        return _field(self.widths, 4 * min(glyph, self.measured - 1))

    def mappings(self) -> Iterator[tuple[int, int]]:
        """(character, glyph) of the best character map, rising; characters without a glyph are left out."""
        for first, last, glyph in self._runs():
            for code in range(first, last + 1):
                found = glyph(code)
                if 0 < found < self.glyphs:
                    yield code, found

    def glyph(self, character: str) -> tuple[int, int] | None:
        """Glyph and advance of a character; None if the font has none, never the glyph for the unknown."""
        code = ord(character)
        if not hasattr(self, "_index"):
            self._index = list(self._runs())
            self._starts = [r[0] for r in self._index]
        k = bisect.bisect_right(self._starts, code) - 1
        if k < 0 or code > self._index[k][1]:
            return None
        found = self._index[k][2](code)
        return (found, self.width(found)) if 0 < found < self.glyphs else None

    def _runs(self) -> Iterator[tuple[int, int, object]]:
        """(first, last, glyph of a character) of the best map, rising and apart."""
        raw = self.table("cmap")
        known = {}
        for row in range(4, 4 + 8 * _field(raw, 2), 8):
            at = _field(raw, row + 4, 4)
            if _field(raw, at) in (4, 6, 12):
                known.setdefault((_field(raw, row), _field(raw, row + 2)), at)
        at = next((known[m] for m in MAPS if m in known), None)
        if at is None:
            raise _bad("no character map of Unicode", self.tables["cmap"][1], "UnsupportedFormat")
        end = -1
        for first, last, glyph in {4: self._segments, 6: self._trimmed, 12: self._groups}[_field(raw, at)](raw, at):
            if not end < first <= last <= 0x10FFFF:
                raise _bad("character map is not in order", self.tables["cmap"][1] + at)
            end = last
            yield first, last, glyph

    @staticmethod
    def _segments(raw: bytes, at: int):
        doubled = _field(raw, at + 6)
        if doubled % 2:
            raise _bad("character map is malformed", at)
        for k in range(0, doubled, 2):
            last, first = _field(raw, at + 14 + k), _field(raw, at + 16 + doubled + k)
            shift, place = _field(raw, at + 16 + 2 * doubled + k), at + 16 + 3 * doubled + k
            skip = _field(raw, place)

            def glyph(code, first=first, shift=shift, place=place, skip=skip):
                if skip in (0, 0xFFFF):
                    return 0 if skip else code + shift & 0xFFFF
                found = _field(raw, place + skip + 2 * (code - first))
                return found + shift & 0xFFFF if found else 0

            if (first, last) != (0xFFFF, 0xFFFF):  # the segment that closes the list
                yield first, last, glyph

    @staticmethod
    def _trimmed(raw: bytes, at: int):
        first, count = _field(raw, at + 6), _field(raw, at + 8)
        if count:
            yield first, first + count - 1, lambda code: _field(raw, at + 10 + 2 * (code - first))

    @staticmethod
    def _groups(raw: bytes, at: int):
        for row in range(at + 16, at + 16 + 12 * _field(raw, at + 12, 4), 12):
            first, last, start = (_field(raw, row + k, 4) for k in (0, 4, 8))
            yield first, last, lambda code, first=first, start=start: start + code - first
