"""Text functions of the formats: strict GB18030, escapes and outline titles."""

from __future__ import annotations

import unicodedata


def gb18030(raw: bytes) -> str | int:
    """The decoded text, or the position of the first invalid byte."""
    try:
        return raw.decode("gb18030")
    except UnicodeDecodeError as error:
        return error.start


def printable(text: str) -> str:
    """Control characters written as escapes, so that a report stays one line an entry."""
    return "".join(f"\\u{{{ord(c):x}}}" if unicodedata.category(c) == "Cc" else c for c in text)


def signature_text(raw: bytes) -> str:
    """Printable ASCII as it is; quotes, backslashes and everything else as two hex digits."""
    return "".join(chr(b) if 0x20 <= b < 0x7F and b not in b'"\\' else f"\\x{b:02x}" for b in raw)


def utf16_hex(text: str) -> str:
    """A PDF text string: byte order mark and UTF-16BE, in hex."""
    return ("﻿" + text).encode("utf-16-be").hex().upper()
