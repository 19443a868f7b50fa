"""Located errors and resource limits shared by all kernels."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Limits:
    """Bounds that reject a document; they never cut one short."""

    max_input_bytes: int = 8 << 30
    max_output_bytes: int = 16 << 30
    max_allocation_bytes: int = 64 << 20
    max_pages: int = 100_000
    max_bookmarks: int = 100_000
    max_image_pixels: int = 12_000_000
    max_symbols: int = 8192


@dataclass
class FormatError(Exception):
    """What went wrong, where, and in which structure.

    kind: UnsupportedFormat, Malformed, Encrypted, Truncated or LimitExceeded;
    structure: the name shown (empty if unknown); place: numbered parts such as
    (("page", 3), ("image", 1)); details: (expected, available) or (limit, attempted).
    """

    kind: str
    reason: str = ""
    offset: int | None = None
    structure: str = ""
    place: tuple[tuple[str, int], ...] = ()
    details: tuple[int, int] | None = None
    row: dict = field(default_factory=dict, repr=False)

    def __str__(self) -> str:
        name = self.structure
        if self.kind == "Malformed":
            head = f"malformed {name}" if name else "invalid input"
        elif self.kind == "UnsupportedFormat":
            head = "unsupported feature PDF" if name == "PDF" else f"unsupported {name or 'input format'}"
        elif self.kind == "LimitExceeded":
            head = f"{name} {self.reason} limit exceeded".strip()
        else:
            head = f"{self.kind.lower()} {name or 'input'}"
        parts = [head + (f" at byte {self.offset}" if self.offset is not None else "") + "".join(f", {k} {v}" for k, v in self.place)]
        if self.reason and self.kind != "LimitExceeded":
            parts.append(self.reason)
        if self.details:
            a, b = self.details
            parts.append(f"expected {a} bytes, available {b}" if self.kind == "Truncated" else f"maximum {a}, attempted {b}")
        return ": ".join(parts)


#: Stable codes by structure and kind; what is not listed falls to the structure's own, then to the kind's.
STRUCTURE_CODES = {"CAJ": 13, "KDH": 15}
KIND_CODES = {"UnsupportedFormat": 1, "Malformed": 2, "Encrypted": 2, "Truncated": 3, "LimitExceeded": 4}
EXACT_CODES = {("PDF", "Malformed"): 8, ("PDF", "Encrypted"): 9, ("PDF", "UnsupportedFormat"): 10, ("PDF", "LimitExceeded"): 12, ("CAJ", "LimitExceeded"): 14}
CONTAINER_CODE, CONTAINER_PARTS = 16, ("HN/C8", "JBIG2", "JPEG", "image")


def error_code(error: FormatError) -> int:
    """The stable number of an error's category."""
    name, kind = error.structure, error.kind
    if name.startswith(CONTAINER_PARTS):
        return CONTAINER_CODE
    exact = EXACT_CODES.get((name, kind))
    if exact or kind in ("Truncated", "LimitExceeded"):
        return exact or KIND_CODES[kind]
    return STRUCTURE_CODES.get(name) or KIND_CODES[kind]


class View:
    """Bytes of a document with checked little-endian fields; errors carry the structure's name."""

    def __init__(self, data: bytes, structure: str = ""):
        self.data, self.size, self.structure = data, len(data), structure

    def error(self, kind: str, reason: str, offset: int | None, details=None, **place: int) -> FormatError:
        return FormatError(kind, reason, offset, self.structure, tuple(place.items()), details)

    def malformed(self, reason: str, offset: int | None, **place: int) -> FormatError:
        return self.error("Malformed", reason, offset, **place)

    def take(self, offset: int, count: int, name: str = "", **place: int) -> bytes:
        if offset + count > self.size:
            raise self.error("Truncated", name, offset, (count, max(0, self.size - offset)), **place)
        return self.data[offset : offset + count]

    def number(self, offset: int, count: int, name: str = "", signed: bool = False, **place: int) -> int:
        return int.from_bytes(self.take(offset, count, name, **place), "little", signed=signed)

    def span(self, offset: int, length: int, name: str, at: int, **place: int) -> tuple[int, int]:
        if offset + length > self.size:
            raise self.malformed(f"{name}: extends beyond source", at, **place)
        return offset, length
