"""Records of page texts: glyphs, controls, image places, drawings, and the characters of native codes.

Each grammar is a table of what may stand where; records are rows (offset, kind, tag, value
and what the kind adds). Offsets count from the start of the page's text, inflated if it is compressed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from quire.formats.paged import Container

#: Tags of all grammars.
RUN, STYLE, END, IMAGE, REFERENCE, WIDE, TALL = 0x8001, 0x8002, 0x8004, 0x800A, 0x810A, 0x8070, 0x8071
IMAGE_BYTES, GLYPH_BYTES, D300 = 28, 16, 0xD300
#: Controls of the tagged grammar; the pair that may begin a page; its control without payload.
TAGGED, PREFIX, VOID = {0x8001, 0x801C, 0x801D, 0x80FF, 0x8070, 0x8071}, 0x8003, 0x80CE
#: What follows what in the ordered grammar.
ORDER = {"start": {RUN}, RUN: {WIDE}, WIDE: {TALL}, TALL: {RUN, "glyph", IMAGE}, "glyph": {RUN, "glyph", IMAGE}, IMAGE: {IMAGE}}
#: Controls of native pages with the values they may have (None: any), by variant.
CONTROLS = {
    "C8": {
        0x8001: None, 0x8002: None, 0x801C: {2, 3, 4}, 0x801D: {0, 3, 4, 28, 31}, 0x8021: {0x2000, 0x2009}, 0x8024: {0x2800, 0x2815, 0x281C, 0x281D},
        0x8067: {0, 4, 5, 6, 7, 8, 9, 11}, 0x8070: {1, 4, 22, 34, 36, 38, 40}, 0x8071: {1, 4, 22, 34, 36, 38, 40}, 0x8072: None, 0x8073: None, 0x8074: None,
        0x80CE: {0, 1}, 0x80D0: {0}, 0x80D1: {1}, 0x80D2: {0}, 0x80D3: {0, 1, 2}, 0x80D5: {0}, 0x9002: {0}, 0xC053: None, 0xC054: None, 0xFFFF: {5},
    },
    "HN-B": {
        0x8001: None, 0x8002: None, 0x801C: {4}, 0x801D: {0, 3, 4}, 0x8024: {0x2800, 0x2815, 0x281D}, 0x8067: {5, 6, 7, 9, 18}, 0x8069: {0x1084},
        0x8070: {28, 36, 43}, 0x8071: {28, 36, 43}, 0x8072: None, 0x8073: None, 0x8074: None, 0x80CE: {0, 1}, 0xC053: None, 0xFFFF: {5},
    },
}
EXTENDED = {"C8": {0x81FF: {1, 2, 3}, 0x80CC: {0x0204}}, "HN-B": {0xC052: {0xA385}}}
DRAWINGS = {
    "C8": {0x8006: {0xA381, 0xA383, 0xA385, 0xA387, 0xA38B, 0xA38D}, 0x8007: {0xA380, 0xA382}, 0x8008: {0xA380}, 0x8010: {1, 2, 46, 117}, 0x8090: None},
    "HN-B": {0x8006: {0xA381, 0xA383, 0xA385}},
}
#: Sizes of both axes that stand for style 0 where none was set.
PLAIN_AXES = {"C8": {22, 34, 38, 40}, "HN-B": {28, 43}}
#: Characters of native mode 2 that differ from their GB18030 value.
MODE_2 = {0xA0A6: "＆", 0xA0AD: "－", 0xA0AE: "．", 0xA0AF: "／", 0xA0BA: ":", 0xAAB1: "∙", 0xAAB2: "-", 0xAAB3: "∗", 0xACA3: "►"}
#: Characters of native mode 0; first codes of its letters and digits; codes with their GB18030 value.
MODE_0 = {0xA1A1: " ", 0x9FF5: "／", 0xA3A7: "’", 0xAAB1: ".", 0xAAB2: "-"}
MODE_0_RUNS = [(0xA980, "A", 26), (0xA99A, "a", 26), (0xA3C1, "A", 26), (0xA3E1, "a", 26), (0xA3B0, "0", 10)]
MODE_0_PLAIN = {0xA1A2, 0xA1A3, 0xA1AA, 0xA1AE, 0xA1AF, 0xA1B0, 0xA1B1, 0xA3A8, 0xA3A9, 0xA3AB, 0xA3AC, 0xA3AD, 0xA3AE, 0xA3AF, 0xA3BA, 0xA3BB, 0xA3BF, 0xA3DB, 0xA3DD}


def _gb(code: int) -> str | None:
    try:
        text = code.to_bytes(2, "big").decode("gb18030")
    except UnicodeDecodeError:
        return None
    return text if len(text) == 1 else None


def native_character(mode: int | None, code: int) -> str | None:
    """The character of a native code in modes 0 and 2; None where it is not known."""
    if mode == 2:
        if code in MODE_2:
            return MODE_2[code]
        if code >> 8 == 0xA0:
            letter = chr(code & 0x7F) if code & 0x80 else ""
            return letter if letter.isalnum() else None
        found = _gb(code)
        unknown = found is None or ord(found) < 32 or 0x7F <= ord(found) < 0xA0 or 0xE000 <= ord(found) <= 0xF8FF
        return None if unknown else found
    if mode == 0:
        if code in MODE_0:
            return MODE_0[code]
        for first, letter, count in MODE_0_RUNS:
            if first <= code < first + count:
                return chr(ord(letter) + code - first)
        han = 0xB0A1 <= code <= 0xF7FE and 0xA1 <= code & 0xFF <= 0xFE
        found = _gb(code) if han or code in MODE_0_PLAIN else None
        return found if found and (not han or "一" <= found <= "鿿") else None
    return None


def words(raw: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(raw) // 2}H", raw)


def fits(table: dict, tag: int, value: int) -> bool:
    return tag in table and (table[tag] is None or value in table[tag])


class PageText:
    """One page's text and the grammar it follows: ordered, tagged, fixed or native."""

    def __init__(self, box: Container, page: dict):
        self.box, self.page, self.here = box, page, {"page": page["page_number"]}
        self.framing = box.framing(page)[0]
        self.body = box.page_text(page)
        self.size = None
        if box.header.variant == "HN-A" and box.v.data[page["text_offset"] :][:2] == box.v.data[page["text_offset"] + 4 :][:2] == b"\x03\x80":
            raw = words(box.v.data[page["text_offset"] :][:8])
            self.size = (raw[1], raw[3])
        first = int.from_bytes(self.body[:2], "little")
        self.grammar = {"compresstext": "tagged", "legacy-24": "fixed", "raw-paired": "tagged", "native": "native", "none": "none"}.get(self.framing) or ("tagged" if first == IMAGE else "ordered")

    def _fail(self, reason: str, at: int, kind: str = "Malformed"):
        inflated = self.framing in ("compresstext", "legacy-24")
        return self.box.v.error(kind, reason, self.page["text_offset"] + (0 if inflated else at), **self.here)

    def records(self) -> Iterator[dict]:
        """All records up to the end; the first that the grammar does not allow is an error."""
        read = {"none": lambda: iter(()), "fixed": self._fixed, "native": self._native}.get(self.grammar, self._sequence)
        yield from read()

    def _place(self, at: int) -> dict:
        """The image record at ``at``; HN-A marks x and width with their two upper bits."""
        tag, value, x, y, width, height = words(self.body[at : at + 12])
        if self.box.header.variant == "HN-A" and (tag, value) == (IMAGE, D300) and x >> 14 == width >> 14 == 3:
            x, width = x & 0x3FFF, width & 0x3FFF
        return {"offset": at, "kind": "image", "tag": tag, "value": value, "x": x, "y": y, "width": width, "height": height}

    def _sequence(self) -> Iterator[dict]:
        at, before, images, seen, y = 0, "start", 0, 0, None
        ordered, prefixed, left = self.grammar == "ordered", self.framing == "raw-paired", self.page["image_count"]
        while at + 4 <= len(self.body):
            tag, value = words(self.body[at : at + 4])
            kind = "glyph" if tag < 0x8000 else tag
            if kind == IMAGE and not ordered and images == left:
                raise self._fail("more image records than source descriptors", at)
            ends = kind == END and (not ordered or images == left and before in ("start", TALL, "glyph", IMAGE))
            if ordered:
                known = kind in ORDER.get(before, ()) and (kind != IMAGE or images < left)
            else:
                known = kind in ("glyph", IMAGE) or kind in TAGGED or prefixed and (kind == PREFIX and seen < 2 or kind == VOID and not value)
            if not ends and not known:
                raise self._fail("text record: unexpected tag or order", at)
            seen += 1
            if kind == IMAGE:
                if at + IMAGE_BYTES > len(self.body):
                    break
                yield self._place(at)
                images += 1
                at += IMAGE_BYTES
            else:
                y = value if kind == RUN else y
                extra = {"x": tag, "y": y, "code": value} if kind == "glyph" else {}
                yield {"offset": at, "kind": "glyph" if kind == "glyph" else "end" if ends else "control", "tag": tag, "value": value} | extra
                at += 4
            if ends:
                return
            before = kind
        raise self._fail("text records: missing complete end", at)

    def _fixed(self) -> Iterator[dict]:
        count, body = self.page["image_count"], self.body
        area = len(body) - 12 - IMAGE_BYTES * count
        regions = {12: 1, 8: 2}.get(area % GLYPH_BYTES, 0) if self.box.header.variant == "HN-A" and count == 1 else 0
        area -= regions * IMAGE_BYTES
        if area < 0:
            raise self._fail("text layout: too short for declared image records", 0)
        if area % GLYPH_BYTES:
            raise self._fail("text layout: record area is not a multiple of 16", 0)
        end = 8 + area
        for at in range(8, end, GLYPH_BYTES):
            wide, a, tall, b, run, y, x, code = words(body[at : at + GLYPH_BYTES])
            if (wide, tall, run) != (WIDE, TALL, RUN):
                raise self._fail("text marker: differs from the record's markers", at)
            yield {"offset": at, "kind": "glyph", "tag": x, "value": code, "x": x, "y": y, "code": code, "width": a, "height": b}
        if regions:
            self._check_regions(end, regions)
        for k in range(count):
            yield self._place(end + IMAGE_BYTES * k)

    def _check_regions(self, at: int, regions: int) -> None:
        """A placement that fills the page, regions in order that place nothing, and the end with the page's ordinal."""
        box, page = self.box, self.page
        if next(box.images(page))["record_type"] != 2:
            raise self._fail("image regions require one JPEG descriptor", at)
        size = self.size or words(box.v.data[page["text_offset"] :][:8])[1::2]
        first = bytearray(struct.pack("<HHHHHH", IMAGE, 0, 0, 0, *size) + bytes(16))
        first[12] = min(self.body[at + 12], 1)
        expected = bytes(first)
        for k in range(1, regions + 1):
            expected += b"\x0a\x80\0\0" + self.body[at + k * IMAGE_BYTES + 4 : at + k * IMAGE_BYTES + 12] + bytes([k - 1]) + bytes(15)
        expected += struct.pack("<HH", END, page["page_number"] - 1)
        if self.body[at:] != expected:
            raise self._fail("image regions: invalid prefix, placement or record", at)

    def _native(self) -> Iterator[dict]:
        variant, body, size = self.box.header.variant, self.body, len(self.body)
        mode, left = self.box.header.native_mode, self.page["image_count"]
        y = style = None
        axes: list[int | None] = [None, None]
        at = images = 0
        while at < size:
            if variant == "HN-B" and body[at:] == b"\x04\x80":
                yield self._ended({"offset": at, "kind": "end", "tag": END}, images)
                return
            if at + 4 > size:
                raise self._fail("native record", at, "Truncated")
            tag, value = words(body[at : at + 4])
            row, length = {"offset": at, "tag": tag, "value": value}, 4
            if tag < 0x8000:
                own = style
                if own is None and axes[0] in PLAIN_AXES[variant] and axes[1] in PLAIN_AXES[variant] and (variant == "HN-B" or axes[0] == axes[1]):
                    own = 0
                if y is None or own is None:
                    raise self._fail("native glyph: missing run position or style", at, "UnsupportedFormat" if variant == "HN-B" and own is None else "Malformed")
                row |= {"kind": "glyph", "x": tag, "y": y, "style": own, "code": value, "character": native_character(mode, value)}
            elif tag == END:
                if variant != "HN-B" and at + 4 != size:
                    raise self._fail("native page end: trailing bytes in indexed text span", at)
                yield self._ended(row | {"kind": "end"}, images)
                return
            elif fits(CONTROLS[variant], tag, value):
                row["kind"] = "control"
                if tag == RUN:
                    y = value
                elif tag == STYLE:
                    style, axes = value, [None, None]
                elif tag in (WIDE, TALL):
                    axes[tag - WIDE] = value
            elif fits(EXTENDED[variant], tag, value):
                row["kind"], length = "extended", 8
            elif fits(DRAWINGS[variant], tag, value):
                row["kind"], length = "drawing", 12
            elif variant == "C8" and tag == 0x80CC and 0x0102 <= value <= 0x01FF:
                row["kind"], length = "string", 2 * (value & 0xFF)
            elif (tag, value) == (IMAGE, D300):
                row["kind"], length = "image", IMAGE_BYTES
            elif variant == "C8" and (tag, value) == (REFERENCE, D300):
                row["kind"], length = "reference", 16 + (int.from_bytes(body[at + 14 : at + 16], "little") + 3) // 4 * 4
            else:
                raise self._fail("native record tag/value", at, "UnsupportedFormat")
            if at + length > size:
                raise self._fail("native record", at, "Truncated")
            if row["kind"] in ("image", "reference"):
                images += 1
                if images > left:
                    raise self._fail("native image records: exceed declared image count", at)
            row, length = self._payload(row, length)
            yield row
            at += length
        raise self._fail("native page end: missing end record", size)

    def _ended(self, row: dict, images: int) -> dict:
        if images != self.page["image_count"]:
            raise self._fail("native image records: differ from declared image count", row["offset"])
        return row

    def _payload(self, row: dict, length: int) -> tuple[dict, int]:
        """What a record holds after its first word pair, and its length with what may follow it."""
        at, body, kind = row["offset"], self.body, row["kind"]
        raw = words(body[at + 4 : at + length])
        if kind in ("extended", "drawing"):
            row["words"] = list(raw)
        elif kind == "image":
            row["words"] = list(raw)
            if raw[0] >> 14 == raw[2] >> 14 == 3 and raw[2] & 0x3FFF and raw[3]:
                row |= {"x": raw[0] & 0x3FFF, "y": raw[1], "width": raw[2] & 0x3FFF, "height": raw[3]}
        elif kind == "string":
            if raw and raw[-1] == 0xE000:
                raw = raw[:-1]
            for k, w in enumerate(raw):
                if not 0xE020 <= w <= 0xE07E:
                    raise self._fail("native encoded-string word", at + 4 + 2 * k, "UnsupportedFormat")
            row["text"] = "".join(chr(w & 0x7F) for w in raw)
        elif kind == "reference":
            x, y, width, height, flags, named = raw[:6]
            if flags:
                raise self._fail("native image-reference flags", at + 12, "UnsupportedFormat")
            if any(body[at + 16 + named : at + length]):
                raise self._fail("native image reference: nonzero terminator or padding", at + 16 + named)
            row |= {"x": x, "y": y, "width": width, "height": height, "name": body[at + 16 : at + 16 + named]}
            if named % 4 == 0 and body[at + length : at + length + 4] == bytes(4):
                length += 4
        return row, length
