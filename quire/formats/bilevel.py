"""Bilevel images: the bitmap wrapper of types 0 and 3, and the segments of embedded JBIG2.

Headers and structure only; coded pixels are not decoded here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from quire.formats.errors import Limits, View

WRAPPER_BYTES = 48
#: Fixed values of the wrapper: header size, planes, bits, compression; then white and black.
HEADER_SIZE, PLANES, BITS, COMPRESSION = 40, 1, 1, 0
PALETTE = b"\xff\xff\xff\0\0\0\0\0"
#: Segment types of T.88 that are named here.
SEGMENT_NAMES = {0: "symbol dictionary", 6: "immediate text region", 38: "immediate generic region", 48: "page information", 49: "end of page", 51: "end of file"}


def wrapper(data: bytes, limits: Limits = Limits()) -> dict:
    """``width, height, stride, visible_bytes`` of a type-0 or type-3 payload."""
    v = View(data, "image")
    raw = v.take(0, WRAPPER_BYTES, "bitmap header")
    size, width, height, planes, bits, compression = struct.unpack("<IiiHHI", raw[:20])
    used = struct.unpack("<I", raw[32:36])[0]
    rules = [
        (size == HEADER_SIZE, 0, "header size"), (width > 0, 4, "width must be positive"), (height > 0, 8, "height must be positive"), (planes == PLANES, 12, "planes"),
        (bits == BITS, 14, "bits of a pixel"), (compression == COMPRESSION, 16, "compression"), (used in (0, 2), 32, "colours used"), (raw[40:] == PALETTE, 40, "palette"),
    ]
    for ok, at, reason in rules:
        if not ok:
            raise v.malformed(f"bitmap header: {reason}", at)
    if width * height > limits.max_image_pixels:
        raise v.error("LimitExceeded", "image pixels", 4, (limits.max_image_pixels, width * height))
    return {"width": width, "height": height, "stride": (width + 31) // 32 * 4, "visible_bytes": (width + 7) // 8}


def segments(data: bytes, start: int = WRAPPER_BYTES) -> Iterator[dict]:
    """Segment headers of embedded JBIG2 in order; numbers must rise and references lead back.

    ``number, type, name, page_association, referred_to, data_offset, data_length``.
    """
    v, at, seen = View(data, "JBIG2"), start, []
    while at < v.size:
        head = at
        number, flags, count = struct.unpack(">IBB", v.take(at, 6, "segment header"))
        at += 5
        if count >> 5 < 5:
            references, at = count >> 5, at + 1
        elif count >> 5 == 7:
            references = int.from_bytes(v.take(at, 4, "referred-to count"), "big") & 0x1FFFFFFF
            at += 4 + (references + 8) // 8
        else:
            raise v.malformed("referred-to count is reserved", at, segment=number)
        if seen and number <= seen[-1]:
            raise v.malformed("segment numbers do not rise", head, segment=number)
        width = 1 if number <= 256 else 2 if number <= 65536 else 4
        raw = v.take(at, width * references, "referred-to segments", segment=number)
        referred = [int.from_bytes(raw[k : k + width], "big") for k in range(0, len(raw), width)]
        if not set(referred) <= set(seen):
            raise v.malformed("segment refers to one that is not before it", at, segment=number)
        at += len(raw)
        wide = 4 if flags & 0x40 else 1
        page = int.from_bytes(v.take(at, wide, "page association", segment=number), "big")
        length = int.from_bytes(v.take(at + wide, 4, "segment length", segment=number), "big")
        at += wide + 4
        if length == 0xFFFFFFFF:
            raise v.error("UnsupportedFormat", "segment of unknown length", head, segment=number)
        v.span(at, length, "segment data", at, segment=number)
        seen.append(number)
        yield {"number": number, "type": flags & 63, "name": SEGMENT_NAMES.get(flags & 63), "page_association": page, "referred_to": referred, "data_offset": at, "data_length": length}
        at += length


def page_size(data: bytes, segment: dict) -> tuple[int, int]:
    """Width and height of a page-information segment."""
    v = View(data, "JBIG2")
    if segment["type"] != 48 or segment["data_length"] != 19:
        raise v.malformed("page information has the wrong type or length", segment["data_offset"], segment=segment["number"])
    return struct.unpack(">II", data[segment["data_offset"] : segment["data_offset"] + 8])


def profile(data: bytes) -> str:
    """``generic`` (page and generic region) or ``symbols`` (page, two dictionaries, text, generic region) of a type-3 image."""
    v, size = View(data, "JBIG2"), wrapper(data)
    found = list(segments(data))
    shape = [(s["number"], s["type"], s["referred_to"]) for s in found]
    #: Fixed values: (number, type, referred-to) of the segments that are known.
    known = {"generic": [(0, 48, []), (1, 38, [])], "symbols": [(0, 48, []), (1, 0, []), (2, 0, [1]), (3, 6, [2]), (4, 38, [])]}
    name = next((n for n, k in known.items() if k == shape), None)
    if name is None:
        raise v.error("UnsupportedFormat", "segment profile", WRAPPER_BYTES)
    if page_size(data, found[0]) != (size["width"], size["height"]):
        raise v.malformed("bitmap and page sizes differ", found[0]["data_offset"], segment=0)
    return name
