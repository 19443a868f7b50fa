"""Pixels of bilevel images: type 0 (T.82 rows) and type 3 (T.88 regions of symbols and pixels).

Rows are bytearrays of one pixel a byte with a margin on both sides, so that a context is
moved along instead of being read anew. One is black.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from quire.formats import arithmetic, bilevel
from quire.formats.errors import Limits, View

LEFT, RIGHT = 2, 4
#: Fixed value: the context that tells whether a type-0 row repeats the one above.
SAME_ROW = 457
#: Fixed values of T.88: flags of the two dictionaries that are known, and of the adaptive pixel of template 2.
DIRECT, REFINED, ADAPTIVE = 0x0800, 0x1802, b"\x02\xff"


def _blank(width: int) -> bytearray:
    return bytearray(LEFT + width + RIGHT)


def three_lines(bit, bank: list, width: int, height: int, *, coded_repeats: bool) -> Iterator[bytearray]:
    """Rows whose pixels depend on ten around them: two before, five above, three in the row above that.

    With ``coded_repeats`` (type 0) a symbol before each row tells whether it repeats the last.
    """
    near_shift, far_shift, own_shift = (3, 0, 8) if coded_repeats else (2, 7, 0)
    above2, above = _blank(width), _blank(width)
    for _ in range(height):
        if coded_repeats and bit(bank, SAME_ROW):
            row = bytearray(above)
        else:
            row = _blank(width)
            far, near, own = above2[2] << 1 | above2[3], above[2] << 2 | above[3] << 1 | above[4], 0
            for x in range(width):
                pixel = bit(bank, far << far_shift | near << near_shift | own << own_shift)
                row[x + 2] = pixel
                own = own << 1 & 3 | pixel
                far = far << 1 & 7 | above2[x + 4]
                near = near << 1 & 31 | above[x + 5]
        yield row
        above2, above = above, row


def _bitmap(rows, width: int) -> np.ndarray:
    rows = [np.frombuffer(r, np.uint8, width, LEFT) for r in rows]
    return np.stack(rows) if rows else np.zeros((0, width), np.uint8)


def refined(bit, bank: list, width: int, height: int, reference: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """A bitmap by template 1: four of its own pixels and six of ``reference`` moved by (dx, dy)."""
    ground = np.zeros((height + 2, width + 2), np.uint8)
    h, w = reference.shape
    y0, x0 = max(0, dy + 1), max(0, dx + 1)
    y1, x1 = min(height + 2, dy + 1 + h), min(width + 2, dx + 1 + w)
    if y0 < y1 and x0 < x1:
        ground[y0:y1, x0:x1] = reference[y0 - dy - 1 : y1 - dy - 1, x0 - dx - 1 : x1 - dx - 1]
    below = [bytes(r) for r in ground]
    above, rows = _blank(width), []
    for y in range(height):
        row, up, mid, down = _blank(width), below[y], below[y + 1], below[y + 2]
        for x in range(width):
            context = above[x + 1] << 9 | above[x + 2] << 8 | above[x + 3] << 7 | row[x + 1] << 6
            context |= up[x + 1] << 5 | mid[x] << 4 | mid[x + 1] << 3 | mid[x + 2] << 2 | down[x + 1] << 1 | down[x + 2]
            row[x + 2] = bit(bank, context)
        rows.append(row)
        above = row
    return _bitmap(rows, width)


class Jbig2:
    """The segments of one type-3 payload, decoded into its page."""

    def __init__(self, data: bytes, limits: Limits = Limits()):
        self.data, self.limits, self.v = data, limits, View(data, "JBIG2")
        self.segments = list(bilevel.segments(data))
        self.anomaly: str | None = None

    def _coded(self, segment: dict, head: int) -> tuple:
        """The decoder of what follows ``head`` bytes of a segment, and those bytes."""
        at, end = segment["data_offset"], segment["data_offset"] + segment["data_length"]
        if segment["data_length"] < head:
            raise self.v.error("Truncated", "segment data", at, (head, segment["data_length"]), segment=segment["number"])
        body = self.data[at + head : end]
        if not arithmetic.closed(body):
            raise self.v.malformed("coded data has no final marker, or one inside", at + head, segment=segment["number"])
        return arithmetic.mq(body), self.data[at : at + head]

    def _fail(self, segment: dict, reason: str, kind: str = "Malformed"):
        return self.v.error(kind, reason, segment["data_offset"], segment=segment["number"])

    def _area(self, segment: dict, width: int, height: int) -> None:
        if width * height > self.limits.max_image_pixels:
            raise self.v.error("LimitExceeded", "image pixels", segment["data_offset"], (self.limits.max_image_pixels, width * height), segment=segment["number"])

    def dictionary(self, segment: dict, imported: list[np.ndarray]) -> list[np.ndarray]:
        """The symbols a dictionary exports."""
        flags = int.from_bytes(self.data[segment["data_offset"] : segment["data_offset"] + 2], "big")
        if flags not in (DIRECT, REFINED):
            raise self._fail(segment, "symbol dictionary coding", "UnsupportedFormat")
        bit, head = self._coded(segment, 12)
        if head[2:4] != ADAPTIVE:
            raise self._fail(segment, "adaptive pixel", "UnsupportedFormat")
        exported, new = struct.unpack(">II", head[4:])
        total = len(imported) + new
        if total > self.limits.max_symbols or exported > total:
            raise self.v.error("LimitExceeded", "symbols", segment["data_offset"], (self.limits.max_symbols, max(total, exported)), segment=segment["number"])
        if not total and not exported and segment["data_length"] == 14:
            return []
        numbers, pixels, changes = arithmetic.Integers(bit), [0] * 1024, [0] * 1024
        symbols, length, height, area = list(imported), max(0, (total - 1).bit_length()), 0, 0
        while len(symbols) < total:
            step = numbers.read("IADH")
            if step is None or height + step < 0:
                raise self._fail(segment, "symbol height")
            height, width = height + step, 0
            while (step := numbers.read("IADW")) is not None:
                width += step
                if len(symbols) == total or width < 0:
                    raise self._fail(segment, "symbol width, or too many symbols")
                if not width or not height:
                    raise self._fail(segment, "symbol without extent", "UnsupportedFormat")
                area += width * height
                self._area(segment, area, 1)
                if flags == DIRECT:
                    symbols.append(_bitmap(three_lines(bit, pixels, width, height, coded_repeats=False), width))
                    continue
                if numbers.read("IAAI") != 1:
                    raise self._fail(segment, "symbols made of several", "UnsupportedFormat")
                number, dx, dy = numbers.symbol(length), numbers.read("IARDX"), numbers.read("IARDY")
                if number >= len(symbols) or dx is None or dy is None:
                    raise self._fail(segment, "refined symbol")
                symbols.append(refined(bit, changes, width, height, symbols[number], dx, dy))
        out, place, take = [], 0, False
        while place < total:
            run = numbers.read("IAEX")
            if run is None or run < 0 or place + run > total:
                raise self._fail(segment, "export run")
            out += symbols[place : place + run] if take else []
            place, take = place + run, not take
        if len(out) != exported:
            raise self._fail(segment, "number of exported symbols")
        return out

    def _region(self, segment: dict, raw: bytes) -> tuple[int, int, int, int]:
        width, height, x, y = struct.unpack(">IIII", raw[:16])
        if raw[16] not in (0, 1, 2, 3, 4) or not width or not height:
            raise self._fail(segment, "region information")
        self._area(segment, width, height)
        return width, height, x, y

    def text(self, segment: dict, symbols: list[np.ndarray], page: np.ndarray, *, strict: bool = False) -> None:
        """Symbols put on the page, strip by strip.

        A template bit without refinement is an error if ``strict``, else it is kept as ``anomaly``.
        """
        flags = int.from_bytes(self.data[segment["data_offset"] + 17 : segment["data_offset"] + 19], "big")
        if flags & 1:
            raise self._fail(segment, "Huffman text region", "UnsupportedFormat")
        refine, corner, transposed, operator = flags >> 1 & 1, flags >> 4 & 3, flags >> 6 & 1, flags >> 7 & 3
        if refine and not flags >> 15:
            raise self._fail(segment, "refinement template", "UnsupportedFormat")
        if flags >> 15 and not refine:
            if strict:
                raise self._fail(segment, "refinement template without refinement")
            self.anomaly = "unused refinement template"
        bit, head = self._coded(segment, 23)
        width, height, left, top = self._region(segment, head)
        count = int.from_bytes(head[19:23], "big")
        if count > self.limits.max_image_pixels:
            raise self.v.error("LimitExceeded", "symbol instances", segment["data_offset"], (self.limits.max_image_pixels, count), segment=segment["number"])
        strips, shift = 1 << (flags >> 2 & 3), (flags >> 10 & 31) - (32 if flags >> 14 & 1 else 0)
        region = np.full((height, width), flags >> 9 & 1, np.uint8)
        numbers, changes, length = arithmetic.Integers(bit), [0] * 1024, max(0, (len(symbols) - 1).bit_length())

        def need(name: str) -> int:
            value = numbers.read(name)
            if value is None:
                raise self._fail(segment, f"{name} out of band")
            return value

        strip, first, done = -need("IADT") * strips, 0, 0
        while done < count:
            strip += need("IADT") * strips
            first += need("IAFS")
            along = first
            while True:
                if done == count:
                    raise self._fail(segment, "more instances than declared")
                across = strip + (need("IAIT") if strips > 1 else 0)
                number = numbers.symbol(length)
                if number >= len(symbols):
                    raise self._fail(segment, "symbol number")
                shape = symbols[number]
                if refine and need("IARI"):
                    dw, dh, dx, dy = (need(n) for n in ("IARDW", "IARDH", "IARDX", "IARDY"))
                    h, w = shape.shape[0] + dh, shape.shape[1] + dw
                    if h <= 0 or w <= 0:
                        raise self._fail(segment, "refined instance without extent")
                    self._area(segment, w, h)
                    shape = refined(bit, changes, w, h, shape, (dw >> 1) + dx, (dh >> 1) + dy)
                h, w = shape.shape
                extent = (h if transposed else w) - 1
                # Corners: 0 bottom left, 1 top left, 2 bottom right, 3 top right.
                ends = corner in (0, 2) if transposed else corner in (2, 3)
                along += extent if ends else 0
                x, y = (across, along) if transposed else (along, across)
                _place(region, shape, x - (w - 1 if corner in (2, 3) else 0), y - (h - 1 if corner in (0, 2) else 0), operator)
                along += 0 if ends else extent
                done += 1
                step = numbers.read("IADS")
                if step is None:
                    break
                along += step + shift
        _place(page, region, left, top, head[16])

    def generic(self, segment: dict, page: np.ndarray) -> None:
        """A region of pixels by template 2, combined with the page."""
        bit, head = self._coded(segment, 20)
        flags = head[17]
        if flags >> 4:
            raise self._fail(segment, "reserved flags of a generic region")
        if flags != 4 or head[18:] != ADAPTIVE:
            raise self._fail(segment, "generic region coding", "UnsupportedFormat")
        width, height, x, y = self._region(segment, head)
        _place(page, _bitmap(three_lines(bit, [0] * 1024, width, height, coded_repeats=False), width), x, y, head[16])


def _place(ground: np.ndarray, shape: np.ndarray, x: int, y: int, operator: int) -> None:
    """Combines what of ``shape`` lies inside: 0 or, 1 and, 2 exclusive or, 3 its inverse, 4 replace."""
    y0, x0 = max(0, y), max(0, x)
    y1, x1 = min(ground.shape[0], y + shape.shape[0]), min(ground.shape[1], x + shape.shape[1])
    if y0 >= y1 or x0 >= x1:
        return
    part, own = ground[y0:y1, x0:x1], shape[y0 - y : y1 - y, x0 - x : x1 - x]
    part[:] = (part | own, part & own, part ^ own, 1 - (part ^ own), own)[operator]


def type0(data: bytes, limits: Limits = Limits()) -> np.ndarray:
    """Pixels of a type-0 payload, a byte each."""
    size = bilevel.wrapper(data, limits)
    return _bitmap(three_lines(arithmetic.qm(data[bilevel.WRAPPER_BYTES :]), [0] * 1024, size["width"], size["height"], coded_repeats=True), size["width"])


def type3(data: bytes, limits: Limits = Limits(), *, strict: bool = False) -> tuple[np.ndarray, str | None]:
    """Pixels of a type-3 payload, and the anomaly that was let pass."""
    size, kind, image = bilevel.wrapper(data, limits), bilevel.profile(data), Jbig2(data, limits)
    parts = image.segments
    page = np.full((size["height"], size["width"]), data[parts[0]["data_offset"] + 16] >> 2 & 1, np.uint8)
    if kind == "symbols":
        symbols = image.dictionary(parts[2], image.dictionary(parts[1], []))
        image.text(parts[3], symbols, page, strict=strict)
    image.generic(parts[-1], page)
    return page, image.anomaly


def read(kind: int, data: bytes, limits: Limits = Limits()) -> np.ndarray:
    return type0(data, limits) if kind == 0 else type3(data, limits)[0]


def packed(bitmap: np.ndarray) -> bytes:
    """Rows of eight pixels a byte, without padding words."""
    return np.packbits(bitmap, axis=1).tobytes()
