"""Baseline JPEG structure: markers and tables are walked, coefficients are not decoded."""

from __future__ import annotations

import re

from quire.formats.errors import FormatError, View

SOI, EOI, SOS, SOF0, DHT, DQT, DRI, APP0, APP14, DNL = 0xD8, 0xD9, 0xDA, 0xC0, 0xC4, 0xDB, 0xDD, 0xE0, 0xEE, 0xDC
_STOP = re.compile(rb"\xff+([^\x00\xff])", re.S)


def read(data: bytes) -> dict:
    """``width, height, color`` (gray or ycc) of a file of one frame and one scan."""
    v = View(data, "JPEG")
    if data[:2] != b"\xff\xd8":
        raise v.malformed("SOI is missing", 0)
    at, frame, restart, jfif, scanned = 2, None, 0, False, False
    quant, huffman = set(), set()
    while True:
        m = re.compile(rb"\xff+([^\x00\xff])", re.S).match(data, at)
        if m is None:
            raise v.malformed("marker is missing", at)
        kind, at = m[1][0], m.end()
        if kind == EOI:
            if not scanned:
                raise v.malformed("EOI before a scan", at)
            if at != len(data):
                raise v.malformed("bytes after EOI", at)
            return frame
        length = int.from_bytes(v.take(at, 2, "segment length"), "big")
        body, start = v.take(at + 2, max(0, length - 2), "segment"), at
        at += length
        if length < 2:
            raise v.malformed("segment length is below two", start)
        if kind == APP0 and body[:5] == b"JFIF\0":
            if jfif:
                raise v.malformed("second JFIF marker", start)
            jfif = True
        elif kind in (APP14, DNL):
            raise v.error("UnsupportedFormat", f"marker FF{kind:02X}", start)
        elif kind == DQT:
            place = 0
            while place < len(body):
                quant.add(body[place] & 15)
                place += 129 if body[place] >> 4 else 65
            if place != len(body):
                raise v.malformed("quantization table length", start)
        elif kind == DHT:
            place = 0
            while place < len(body):
                huffman.add(body[place])
                place += 17 + sum(body[place + 1 : place + 17])
            if place != len(body):
                raise v.malformed("Huffman table length", start)
        elif kind == DRI:
            restart = int.from_bytes(body, "big")
        elif 0xC0 <= kind <= 0xCF and kind not in (DHT, 0xC8, 0xCC):
            if kind != SOF0 or frame is not None:
                raise v.error("UnsupportedFormat", "frame type or number of frames", start)
            frame = _frame(v, body, start)
        elif kind == SOS:
            if frame is None or scanned:
                raise v.malformed("scan without a frame, or second scan", start)
            _scan_tables(v, body, frame, quant, huffman, start)
            at, scanned = _skip_scan(v, data, at, restart), True


def _frame(v: View, body: bytes, start: int) -> dict:
    if len(body) < 6 or len(body) != 6 + 3 * body[5] or body[0] != 8 or body[5] not in (1, 3):
        raise v.error("UnsupportedFormat", "frame precision or components", start)
    height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
    if not width or not height:
        raise v.malformed("frame has no extent", start)
    parts = {body[k]: body[k + 2] for k in range(6, len(body), 3)}
    return {"width": width, "height": height, "color": "gray" if body[5] == 1 else "ycc", "_tables": parts}


def _scan_tables(v: View, body: bytes, frame: dict, quant: set, huffman: set, start: int) -> None:
    parts = frame.pop("_tables")
    named = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])} if body and len(body) == 4 + 2 * body[0] else {}
    if set(named) != set(parts):
        raise v.malformed("scan components differ from the frame's", start)
    if not all(q in quant for q in parts.values()) or not all({t >> 4, 16 | t & 15} <= huffman for t in named.values()):
        raise v.malformed("scan uses a table that is not defined", start)


def _skip_scan(v: View, data: bytes, at: int, restart: int) -> int:
    """Where the marker after the entropy-coded data stands; restart markers must count up."""
    turn = 0
    while m := _STOP.search(data, at):
        if not 0xD0 <= m[1][0] <= 0xD7:
            return m.start()
        if not restart or m[1][0] != 0xD0 + turn % 8:
            raise v.malformed("restart marker without interval or out of sequence", m.start())
        turn, at = turn + 1, m.end()
    raise v.malformed("scan has no end", at)


def problem(data: bytes) -> str | None:
    """What is wrong with a file, or None."""
    try:
        read(data)
    except FormatError as error:
        return str(error)
    return None
