"""HN and C8 containers: header, page rows, image descriptors, text framing, outline, package tail.

A document is opened once into a ``Header``; any page is then read by itself, so one
broken page does not hide the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from quire.formats.errors import FormatError, Limits, View
from quire.formats.text import gb18030

#: Fixed values of the layout: variant, page count field, page index.
C8, HN_A, HN_B = ("C8", 0x08, 0x50), ("HN-A", 0x90, 0x15C), ("HN-B", 0x90, 0xD8)
SIGNATURES = {b"\xc8\0\0\0": "C8", b"HN\0\0": "HN"}
HN_MARKERS = {b"\x90\x01\0\0": HN_A, b"\xc8\0\0\0": HN_B}
OUTLINE_COUNT, OUTLINE, OUTLINE_BYTES = 0x158, 0x15C, 308
ROW_LAYOUT, ROW_BYTES, COMPACT_ROW_BYTES, DESCRIPTOR_BYTES = 0x88, 20, 12, 12
TRAILER = b"APPINFOSIGN "
COMPRESSED = b"COMPRESSTEXT"
MAX_PACKAGE_BYTES = 1 << 20


@dataclass(frozen=True)
class Header:
    variant: str
    page_count: int
    native_mode: int | None
    native_origin: tuple[int, int] | None
    page_size: tuple[int, int]
    page_index: tuple[int, int]
    row_bytes: int
    outline_count: int | None


class Container:
    """An opened HN or C8 document."""

    def __init__(self, data: bytes, limits: Limits = Limits()):
        self.v, self.limits = View(data, "HN/C8"), limits
        v = self.v
        if v.size > limits.max_input_bytes:
            raise v.error("LimitExceeded", "source bytes", 0, (limits.max_input_bytes, v.size))
        family = SIGNATURES.get(v.take(0, 4, "signature"))
        if family is None:
            raise v.error("UnsupportedFormat", "signature", 0)
        layout = C8 if family == "C8" else HN_MARKERS.get(v.take(4, 4, "HN marker"))
        if layout is None:
            raise v.error("UnsupportedFormat", "HN marker", 4)
        variant, count_at, index = layout
        v.structure = f"HN/C8 {variant}"
        pages = v.number(count_at, 4, "page count", signed=True)
        if pages <= 0:
            raise v.malformed("page count: must be positive", count_at)
        if pages > limits.max_pages:
            raise v.error("LimitExceeded", "pages", count_at, (limits.max_pages, pages))
        mode = origin = entries = None
        if variant != "HN-A":
            mode = v.number(count_at + 4, 4, "native mode")
            raw = v.take(count_at + 20, 4, "native coordinate origin")
            origin = (raw[0] | raw[1] << 8, raw[2] | raw[3] << 8)
        raw = v.take(count_at + 24, 4, "page dimensions")
        size = (raw[0] | raw[1] << 8, raw[2] | raw[3] << 8)
        row = ROW_BYTES
        if variant == "HN-A":
            entries = v.number(OUTLINE_COUNT, 4, "outline count", signed=True)
            if entries < 0:
                raise v.malformed("outline count: negative signed value", OUTLINE_COUNT)
            index += entries * OUTLINE_BYTES
        elif variant == "HN-B":
            word = v.number(ROW_LAYOUT, 4, "HN-B page-index layout")
            if word not in (0, 0xC8):
                raise v.error("UnsupportedFormat", "HN-B page-index layout", ROW_LAYOUT)
            row = ROW_BYTES if word else COMPACT_ROW_BYTES
        span = v.span(index, pages * row, "page index", index)
        self.header = Header(variant, pages, mode, origin, size, span, row, entries)
        self.index_end = index + pages * row

    def page(self, number: int) -> dict:
        """``page_number, row_offset, text_offset, text_length, image_count, unknown``; numbers from one."""
        v, h = self.v, self.header
        if not 0 < number <= h.page_count:
            raise v.malformed("page number: outside declared page index", h.page_index[0])
        at, here = h.page_index[0] + (number - 1) * h.row_bytes, {"page": number}
        start, length = (v.number(at + k, 4, "page row", signed=True, **here) for k in (0, 4))
        for value, field, name in ((start, 0, "text offset"), (length, 4, "text length")):
            if value < 0:
                raise v.malformed(f"{name}: negative signed value", at + field, **here)
        v.span(start, length, "text span", at, **here)
        images, unknown = 0, bytes(10)
        if h.row_bytes == COMPACT_ROW_BYTES:
            if start < self.index_end:
                raise v.malformed("text span: overlaps protected container index", at, **here)
            if v.number(at + 8, 4, "page row", **here):
                raise v.error("UnsupportedFormat", "compact HN-B third word", at + 8, **here)
        else:
            images = v.number(at + 8, 2, "page row", signed=True, **here)
            unknown = v.take(at + 10, 10, "page row", **here)
            if images < 0:
                raise v.malformed("image count: negative signed value", at + 8, **here)
        return {"page_number": number, "row_offset": at, "text_offset": start, "text_length": length, "image_count": images, "unknown": unknown}

    def images(self, page: dict) -> Iterator[dict]:
        """Descriptors of a page: the first follows the text, each next the payload before it."""
        v = self.v
        at = page["text_offset"] + page["text_length"]
        for number in range(1, page["image_count"] + 1):
            here = {"page": page["page_number"], "image": number}
            v.span(at, DESCRIPTOR_BYTES, "image descriptor", at, **here)
            if at < self.index_end:
                raise v.malformed("image descriptor: overlaps header or page index", at, **here)
            kind, start, length = (v.number(at + k, 4, "image descriptor", signed=True, **here) for k in (0, 4, 8))
            if kind > 3:
                raise v.error("UnsupportedFormat", "image type", at, **here)
            for value, field, name in ((kind, 0, "type"), (start, 4, "offset"), (length, 8, "length")):
                if value < 0:
                    raise v.malformed(f"image {name}: negative signed value", at + field, **here)
            if length == 0:
                raise v.malformed("image length: zero-length payload", at + 8, **here)
            v.span(start, length, "image payload", at + 4, **here)
            if length > self.limits.max_allocation_bytes:
                raise v.error("LimitExceeded", "image span bytes", at + 8, (self.limits.max_allocation_bytes, length), **here)
            if start < at + DESCRIPTOR_BYTES:
                raise v.malformed("image offset: payload overlaps descriptor or chain regresses", at + 4, **here)
            yield {"page_number": page["page_number"], "image_number": number, "descriptor_offset": at, "record_type": kind, "payload_offset": start, "payload_length": length}
            at = start + length

    def framing(self, page: dict) -> tuple[str, int | None]:
        """How a page's text is framed, and the decoded length of a compressed one."""
        v, h = self.v, self.header
        raw = v.data[page["text_offset"] : page["text_offset"] + page["text_length"]]
        if not raw:
            return "none", None
        tag = int.from_bytes(raw[:2], "little")
        if h.variant == "HN-A" and tag == 0x8003 and raw[4:6] == b"\x03\x80" and int.from_bytes(raw[8:10], "little") in (0x800A, 0x801C):
            return "raw-paired", None
        if h.variant == "HN-A" and tag in (0x8001, 0x800A, 0x8004) or h.variant == "C8" and page["image_count"] == 1 and raw[:4] == b"\x0a\x80\0\0":
            return "raw", None
        head = 16 if raw[:12] == COMPRESSED else 24 if raw[:2] == raw[4:6] == b"\x03\x80" and raw[8:20] == COMPRESSED else 0
        if head and h.variant != "HN-B":
            return ("compresstext" if head == 16 else "legacy-24"), len(self.page_text(page))
        if h.variant != "HN-A":
            return "native", None
        raise v.malformed("page text: unknown framing", page["text_offset"], page=page["page_number"])

    def page_text(self, page: dict) -> bytes:
        """A page's text records, inflated where they are compressed."""
        v, at, here = self.v, page["text_offset"], {"page": page["page_number"]}
        raw = v.data[at : at + page["text_length"]]
        head = 16 if raw[:12] == COMPRESSED else 24 if raw[8:20] == COMPRESSED else 0
        if not head:
            return raw
        declared = int.from_bytes(raw[head - 4 : head], "little")
        if declared > self.limits.max_allocation_bytes:
            raise v.error("LimitExceeded", "decoded text bytes", at + head - 4, (self.limits.max_allocation_bytes, declared), **here)
        return inflate(v, raw[head:], declared, at + head, "page text", **here)

    def outline(self, max_depth: int = 64, pages: set[int] | None = None) -> Iterator[dict]:
        """HN-A entries in order: ``bookmark`` rows, and ``defect`` rows for those skipped or clamped.

        A skipped entry still sets the level its successor is judged by; what was last written
        bounds the depth.
        """
        v, h = self.v, self.header
        if h.outline_count is None:
            raise v.error("UnsupportedFormat", "outline variant", 0)
        if h.outline_count > self.limits.max_bookmarks:
            raise v.error("LimitExceeded", "bookmarks", 0, (self.limits.max_bookmarks, h.outline_count))
        written, before = 0, 0
        for ordinal in range(h.outline_count):
            at = OUTLINE + ordinal * OUTLINE_BYTES
            raw = v.take(at, OUTLINE_BYTES, "outline record")
            level = int.from_bytes(raw[304:308], "little")
            defect, title, page = self._entry(raw, at, level, pages)
            parent, before = before, level or None
            if defect:
                yield {"kind": "defect", "ordinal": ordinal, "offset": defect[0], "reason": defect[1], "repair": "skipped"}
                continue
            put = min(level, max_depth, written + 1)
            why = "level exceeds the configured depth" if level > max_depth else "level skips a parent" if parent is not None and level > parent + 1 else None
            if why and put < level:
                yield {"kind": "defect", "ordinal": ordinal, "offset": at + 304, "reason": why, "repair": "clamped"}
            written = put
            yield {"kind": "bookmark", "ordinal": ordinal, "depth": put - 1, "title": title, "page_index": page}

    def _entry(self, raw: bytes, at: int, level: int, pages: set[int] | None):
        name, closed, _ = raw[:256].partition(b"\0")
        if not closed:
            return (at, "title has no NUL terminator"), None, None
        title = gb18030(name)
        if isinstance(title, int):
            return (at + title, "title is not valid GB18030"), None, None
        digits, closed, _ = raw[280:292].partition(b"\0")
        if not closed:
            return (at + 280, "page has no NUL terminator"), None, None
        if not digits or any(not 0x30 <= b <= 0x39 for b in digits):
            return (at + 280, "page is not a decimal number"), None, None
        if not 0 < int(digits) <= self.header.page_count:
            return (at + 280, "destination is outside source pages"), None, None
        if pages is not None and int(digits) not in pages:
            return (at + 280, "destination page was not emitted"), None, None
        if level == 0:
            return (at + 304, "level is zero"), None, None
        return None, title, int(digits) - 1

    def package(self) -> tuple[int, int, bytes] | None:
        """(offset, length, XML) of the package whose trailer ends a C8 document; None without trailer."""
        v = self.v
        tail = v.data[max(0, v.size - 64) :]
        digits = len(tail) - len(tail.rstrip(b"0123456789"))
        marker = v.size - digits - len(TRAILER)
        if not digits or v.data[max(0, marker) : v.size - digits] != TRAILER:
            if TRAILER[:-1] in tail:
                raise v.malformed("application-info trailer: no decimal offset", v.size - len(tail) + tail.index(TRAILER[:-1]))
            return None
        start = int(tail[-digits:])
        if start < self.index_end:
            raise v.malformed("application-info lengths: package starts inside the header or page index", marker)
        if marker - start < 8:
            raise v.error("Truncated", "application-info lengths", marker, (8, max(0, marker - start)))
        decoded, packed = v.number(start, 4), v.number(start + 4, 4)
        for name, value in (("decoded", decoded), ("compressed", packed)):
            if value > MAX_PACKAGE_BYTES:
                raise v.error("LimitExceeded", f"application-info {name} bytes", start, (MAX_PACKAGE_BYTES, value))
        if decoded == 0:
            raise v.malformed("application-info lengths: declared empty package", start)
        if start + 8 + packed != marker:
            raise v.malformed("application-info lengths: compressed length does not end at the marker", start)
        return start, v.size - start, inflate(v, v.data[start + 8 : marker], decoded, start + 8, "application-info package")


def inflate(v: View, raw: bytes, length: int, at: int, name: str, **place: int) -> bytes:
    """One zlib stream that fills ``raw`` and gives exactly ``length`` bytes."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(raw, length + 1)
    except zlib.error:
        raise v.malformed(f"{name}: invalid zlib stream", at, **place) from None
    if len(out) != length or not stream.eof or stream.unused_data:
        raise v.malformed(f"{name}: zlib stream does not have the declared lengths", at, **place)
    return out


def probe(data: bytes, limits: Limits = Limits()) -> Iterator[dict]:
    """A row for each page, with its own ``error`` where it cannot be read."""
    box = Container(data, limits)
    for number in range(1, box.header.page_count + 1):
        row = {"page_number": number}
        try:
            page = box.page(number)
            row |= page
            row["images"] = list(box.images(page))
            try:
                row["framing"], row["decoded_length"] = box.framing(page)
            except FormatError as error:
                row["text_error"] = str(error)
        except FormatError as error:
            row["error"] = str(error)
        yield row
