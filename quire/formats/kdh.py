"""KDH wrappers: a header, then a PDF under a repeating six-byte key."""

from __future__ import annotations

import re

import numpy as np

from quire.formats.errors import Limits, View

#: Fixed values of the layout.
SIGNATURE = b"KDH 2.00 Copyright(C) 2000 CAJCD"
KEY = b"FZHMEI"
START, VERSION = 254, 0x28
VERSIONS = (b"\0\0\x02\0", b"\x01\0\0\0")
_END = re.compile(rb"startxref[\r\n\t ]+(\d+)[\r\n\t ]+%%EOF")
_TABLE = re.compile(rb"\s*(?:xref\b|\d+\s+\d+\s+obj\b)")


def unmask(data: bytes) -> bytes:
    """The bytes after the header without their key."""
    body = np.frombuffer(data, np.uint8)[START:]
    return (body ^ np.resize(np.frombuffer(KEY, np.uint8), len(body))).tobytes()


def decode(data: bytes, limits: Limits = Limits()) -> tuple[bytes, int]:
    """The PDF, and how many bytes follow it.

    Its end is the one end marker whose cross-reference offset leads to a table or
    stream; two such markers are an error, since either could be meant.
    """
    v = View(data)
    if v.size > limits.max_input_bytes:
        raise v.error("LimitExceeded", "input bytes", None, (limits.max_input_bytes, v.size))
    if v.size < START:
        raise v.error("Truncated", "", 0, (START, v.size))
    v.structure = "KDH"
    if data[: len(SIGNATURE)] != SIGNATURE:
        raise v.malformed("KDH signature is invalid", 0)
    if data[VERSION : VERSION + 4] not in VERSIONS:
        raise v.malformed("KDH version field is invalid", VERSION)
    if v.size - START < 8:
        raise View(data).error("Truncated", "", START, (8, v.size - START))
    body = unmask(data)
    if not body.startswith(b"%PDF-"):
        raise v.malformed("decoded payload does not start with a PDF header", START)
    found: list[tuple[int, int]] = []
    for m in _END.finditer(body):
        marker, table = m.end() - 5, int(m[1])
        if table < marker and (not found or table > found[-1][0]) and _TABLE.match(body, table):
            if found:
                raise v.malformed("ambiguous PDF end in KDH trailer", START + marker)
            found.append((marker, table))
    if not found:
        raise v.malformed("decoded PDF startxref and EOF were not found", v.size)
    end = found[0][0] + 5
    end += 2 if body[end : end + 2] == b"\r\n" else 1 if body[end : end + 1] in (b"\r", b"\n") else 0
    return body[:end], len(body) - end
