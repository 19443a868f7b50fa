"""PDF structure: the cross-reference chain, objects, page tree and outline of one file, and outline append.

A strict reader: what it cannot follow is an error with its byte, never a guess.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from quire.formats.errors import Limits, View
from quire.formats.text import utf16_hex

TAIL, MAX_SECTIONS, MAX_TREE_DEPTH = 64 << 10, 64, 64
_SPACE = b"\0\t\n\x0c\r "
_TOKEN = re.compile(rb"[\0\t\n\x0c\r ]*(?:%[^\r\n]*[\r\n\0\t\x0c ]*)*(<<|>>|\[|\]|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\0\t\n\x0c\r ()<>\[\]{}/%]*|[^\0\t\n\x0c\r ()<>\[\]{}/%]+)", re.S)
#: A token by kind: name, reference (two groups), whole number, start of a dictionary, start of a list, end of one, anything else.
_VALUE = re.compile(
    rb"[\0\t\n\x0c\r ]*(?:%[^\r\n]*[\r\n\0\t\x0c ]*)*(?:(/[^\0\t\n\x0c\r ()<>\[\]{}/%]*)|(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])"
    rb"|([+-]?\d{1,18})(?![^\0\t\n\x0c\r ()<>\[\]{}/%])|(<<)|(\[)|(>>|\])|(\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|[^\0\t\n\x0c\r ()<>\[\]{}/%]+))",
    re.S,
)
_NAME, _REF, _WHOLE, _DICT, _LIST, _CLOSE = 1, 3, 4, 5, 6, 7
_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")
_REAL = re.compile(rb"[+-]?(?:\d+\.\d*|\.\d+)")
_WORDS = {b"true": True, b"false": False, b"null": None}
_HEAD = re.compile(rb"[\0\t\n\x0c\r ]*(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+obj")

_STREAM = re.compile(rb"[\0\t\n\x0c\r ]*stream(?:\r\n|\n)")
_ENDSTREAM = re.compile(rb"\s*endstream")
_XREF, _SECTION, _ROW, _TRAILER = re.compile(rb"[\0\t\n\x0c\r ]*xref"), re.compile(rb"\s*(\d+)\s+(\d+)[ \t]*\r?\n?"), re.compile(rb"\s*(\d{10}) (\d{5}) ([nf])"), re.compile(rb"\s*trailer")
#: Bytes of objects whose values a file keeps once they are read; objects beyond are read anew each time.
KEPT_BYTES = 4 << 20
#: The start and the prime of 128-bit FNV-1a.
FNV_START, FNV_PRIME = 0x6C62272E07BB014262B821756295C58D, (1 << 88) + 0x13B


class Ref(NamedTuple):
    number: int
    generation: int


def _natural(value, most: int = 1 << 40) -> bool:
    """Whether a value is a whole number from 0 to ``most``; true and false are none."""
    return isinstance(value, int) and not isinstance(value, bool) and 0 <= value <= most


def guarded(read):
    """What a reader of damaged bytes may trip over as a located error: malformed input is never a failure of the program."""

    @functools.wraps(read)
    def call(self, *args, **kwargs):
        try:
            return read(self, *args, **kwargs)
        except (AttributeError, IndexError, KeyError, OverflowError, RecursionError, TypeError, ValueError) as error:
            raise self.v.malformed(f"PDF structure is malformed ({type(error).__name__})", None) from error

    return call


class Name(str):
    """A PDF name, to tell it from a string."""


@functools.lru_cache(4096)
def _name(token: bytes) -> Name:
    return Name(_HEX.sub(lambda x: bytes([int(x[1], 16)]), token[1:]).decode("latin-1"))


def _scalar(m: re.Match):
    """The value of a token that neither opens nor ends anything."""
    kind = m.lastindex
    if kind == _NAME:
        token = m[1]
        return _name(token) if len(token) < 64 else _name.__wrapped__(token)
    if kind == _REF:
        return Ref(int(m[2]), int(m[3]))
    if kind == _WHOLE:
        return int(m[4])
    token = m[8]
    if _REAL.fullmatch(token):
        return float(token)
    return _WORDS.get(token, token)


@dataclass
class Pdf:
    """An indexed file: newest cross-reference row of each object, trailer and pages in order."""

    data: bytes
    limits: Limits = field(default_factory=Limits)

    @guarded
    def __post_init__(self):
        self.v = View(self.data, "PDF")
        self.packs: dict[int, tuple[bytes, list[int], int]] = {}
        self.known: dict[int, tuple] = {}
        self.kept = 0
        #: Where repairs were made while reading, and which.
        self.repaired: list[tuple[int, str]] = []
        if not self.data.startswith(b"%PDF-"):
            raise self.v.malformed("PDF header is missing", 0)
        at = self.data.rfind(b"startxref", max(0, len(self.data) - TAIL))
        tail = re.match(rb"startxref\s+(\d+)\s+%%EOF", self.data[at:]) if at >= 0 else None
        if tail is None:
            raise self.v.malformed("startxref and EOF were not found", len(self.data))
        self.end = at + tail.end()
        self.rows: dict[int, tuple[str, int, int]] = {}
        self.trailer: dict = {}
        self.id_text = b""
        self.startxref = int(tail[1][:20])
        self._chain(self.startxref)
        if "Encrypt" in self.trailer:
            raise self.v.error("Encrypted", "", self.startxref)
        root = self.resolve(self.trailer.get("Root"))
        if not isinstance(root, dict) or root.get("Type") != "Catalog":
            raise self.v.malformed("catalog is missing", self.startxref)
        self.catalog = root
        if "Perms" in root:
            raise self.v.error("UnsupportedFormat", "signed PDF", self.startxref)
        form = self.resolve(root.get("AcroForm"))
        if isinstance(form, dict) and self.resolve(form.get("SigFlags", 0)) != 0:
            raise self.v.error("UnsupportedFormat", "signed form", self.startxref)
        info = self.resolve(self.trailer.get("Info"))
        if "Info" in self.trailer and (not isinstance(info, dict) or "Type" in info):
            raise self.v.malformed("trailer Info is not an information dictionary", self.startxref)
        self.pages = list(self._pages(root.get("Pages"), 0, set(), root))
        if len(self.pages) > self.limits.max_pages:
            raise self.v.error("LimitExceeded", "pages", None, (self.limits.max_pages, len(self.pages)))
        outline = self.resolve(root.get("Outlines"))
        self.has_outline = isinstance(outline, dict) and "First" in outline

    def _chain(self, at: int) -> None:
        """Sections from the newest on; the first row of an object wins."""
        seen: list[int] = []
        queue = [at]
        while queue:
            at = queue.pop(0)
            if at in seen or len(seen) >= MAX_SECTIONS:
                raise self.v.malformed("xref chain repeats or is too long", at)
            if not 0 <= at < len(self.data):
                raise self.v.malformed("xref offset is outside the file", at)
            seen.append(at)
            here = _XREF.match(self.data, at)
            trailer, inside = self._table(here.end()) if here else self._stream(at)
            if "ID" in trailer and "ID" not in self.trailer:
                self.id_text = entry(self, self.data, inside, "ID")
            for k, value in trailer.items():
                self.trailer.setdefault(k, value)
            queue += [trailer[k] for k in ("XRefStm", "Prev") if isinstance(trailer.get(k), int)]

    def _table(self, at: int) -> tuple[dict, int]:
        while m := _SECTION.match(self.data, at):
            first, count, at = int(m[1][:20]), int(m[2][:20]), m.end()
            if count * 18 > len(self.data):
                raise self.v.malformed("xref row is malformed", at)
            for number in range(first, first + count):
                m = _ROW.match(self.data, at)
                if m is None:
                    raise self.v.malformed("xref row is malformed", at)
                self.rows.setdefault(number, ("free" if m[3] == b"f" else "plain", int(m[1]), int(m[2])))
                at = m.end()
        m = _TRAILER.match(self.data, at)
        if m is None:
            raise self.v.malformed("trailer is missing", at)
        value, _ = self.parse(self.data, m.end())
        if not isinstance(value, dict):
            raise self.v.malformed("trailer is not a dictionary", at)
        return value, m.end()

    def _stream(self, at: int) -> tuple[dict, int]:
        head, body = self._object_at(at)
        if not isinstance(head, dict) or head.get("Type") != "XRef":
            raise self.v.malformed("xref section is neither table nor stream", at)
        widths, raw = head.get("W"), self.unfilter(head, body, at)
        if not isinstance(widths, list) or len(widths) != 3 or not all(_natural(w, 8) for w in widths) or not sum(widths):
            raise self.v.malformed("xref stream widths are malformed", at)
        index = head.get("Index") or [0, head.get("Size", 0)]
        if not isinstance(index, list) or len(index) % 2 or not all(_natural(x) for x in index):
            raise self.v.malformed("xref stream index is malformed", at)
        step, place = sum(widths), 0
        if sum(index[1::2]) * step > len(raw):
            raise self.v.malformed("xref stream is too short", at)
        for first, count in zip(index[::2], index[1::2], strict=True):
            for number in range(first, first + count):
                row, cut = raw[place : place + step], 0
                fields = []
                for k, w in enumerate(widths):
                    fields.append(int.from_bytes(row[cut : cut + w], "big") if w else (1 if k == 0 else 0))
                    cut += w
                self.rows.setdefault(number, ({0: "free", 1: "plain", 2: "packed"}.get(fields[0], "free"), fields[1], fields[2]))
                place += step
        return head, _HEAD.match(self.data, at).end()

    def unfilter(self, head: dict, body: bytes, at: int) -> bytes:
        """Stream bytes after Flate and PNG Up; other filters are not supported."""
        name = self.resolve(head.get("Filter"))
        name = name[0] if isinstance(name, list) and len(name) == 1 else name
        if name is None:
            return body
        if name != "FlateDecode":
            raise self.v.error("UnsupportedFormat", "stream filter", at)
        raw = self._inflate(body, at)
        parms = self.resolve(head.get("DecodeParms"))
        parms = self.resolve(parms[0]) if isinstance(parms, list) and len(parms) == 1 else parms
        if parms is None:
            return raw
        predictor, width = (parms.get("Predictor", 1), parms.get("Columns", 1)) if isinstance(parms, dict) else (None, None)
        if not _natural(predictor) or not _natural(width) or not width:
            raise self.v.malformed("stream parameters are malformed", at)
        if predictor < 2:
            return raw
        if predictor < 10:
            raise self.v.error("UnsupportedFormat", "stream predictor", at)
        if len(raw) % (width + 1):
            raise self.v.malformed("predicted rows are not whole", at)
        above, out = bytes(width), bytearray()
        for k in range(0, len(raw), width + 1):
            kind, line = raw[k], raw[k + 1 : k + 1 + width]
            if kind not in (0, 2):
                raise self.v.error("UnsupportedFormat", "PNG predictor", at)
            above = line if kind == 0 else bytes((a + b) & 255 for a, b in zip(line, above, strict=True))
            out += above
        return bytes(out)

    def _inflate(self, body: bytes, at: int) -> bytes:
        """All of a zlib stream; one that is cut or passes the limit is an error."""
        most, stream = self.limits.max_allocation_bytes, zlib.decompressobj()
        try:
            raw = stream.decompress(body, most + 1)
        except zlib.error:
            raise self.v.malformed("invalid zlib stream", at) from None
        if len(raw) > most:
            raise self.v.error("LimitExceeded", "decoded stream bytes", at, (most, len(raw)))
        if not stream.eof:
            raise self.v.malformed("zlib stream is cut short", at)
        return raw

    def read_at(self, at: int) -> tuple:
        """Number, value, end of the value and start of the stream (None if there is none) of the object at ``at``, its length unchecked."""
        found = self.known.get(at)
        if found is None:
            m = _HEAD.match(self.data, at)
            if m is None:
                raise self.v.malformed("object header is missing", at)
            value, end = self.parse(self.data, m.end())
            s = _STREAM.match(self.data, end) if isinstance(value, dict) else None
            found = int(m[1]), value, end, s.end() if s else None
            if self.kept + end - at <= KEPT_BYTES:
                self.known[at] = found
                self.kept += end - at
        return found

    def _value_at(self, at: int):
        """The value at ``at`` and where its stream begins and ends, the length checked."""
        _, value, _, start = self.read_at(at)
        if start is None:
            return value, 0, 0
        length = self.resolve(value.get("Length"))
        if not _natural(length) or start + length > len(self.data) or not _ENDSTREAM.match(self.data, start + length):
            raise self.v.malformed("stream length is invalid", at)
        return value, start, start + length

    def _object_at(self, at: int):
        value, start, end = self._value_at(at)
        return value, self.data[start:end]

    def is_stream(self, ref: Ref) -> bool:
        """Whether a reference leads to a stream; members of object streams never are."""
        kind, at, _ = self.rows.get(ref.number, ("free", 0, 0))
        if kind != "plain":
            return False
        return self.read_at(at)[3] is not None

    def resolve(self, value, depth: int = 0):
        """The value a reference leads to; None for free and absent objects."""
        while isinstance(value, Ref):
            kind, a, b = self.rows.get(value.number, ("free", 0, 0))
            if depth > 32 or kind == "free":
                return None
            if kind == "packed":
                value = self._member(value.number, a, b)
            else:
                found = self.known.get(a)
                if found is None:
                    m = _HEAD.match(self.data, a)
                    right = m is not None and int(m[1]) == value.number
                else:
                    right = found[0] == value.number
                if not right:
                    raise self.v.malformed("object does not stand at its offset", a, object=value.number)
                value = found[1] if found is not None and found[3] is None else self._value_at(a)[0]
            depth += 1
        return value

    def _member(self, number: int, pack: int, index: int):
        """Object ``number``, which must stand at ``index`` of the object stream ``pack``; a stream is inflated once."""
        kind, at, _ = self.rows.get(pack, ("free", 0, 0))
        if kind != "plain":
            raise self.v.malformed("object stream is missing", None, object=pack)
        if pack not in self.packs:
            self.packs[pack] = self._pack(pack, at)
        raw, table, first = self.packs[pack]
        if not 2 * index + 1 < len(table) or table[2 * index] != number or first + table[2 * index + 1] > len(raw):
            raise self.v.malformed("object stream does not hold the object", at, object=number)
        return self.parse(raw, first + table[2 * index + 1])[0]

    def _pack(self, pack: int, at: int) -> tuple[bytes, list[int], int]:
        """Bytes, numbers and places of the members, and where they begin; a chain of /Extends must end."""
        head, body = self._object_at(at)
        if not isinstance(head, dict) or head.get("Type") != "ObjStm" or not _natural(first := self.resolve(head.get("First"))) or not _natural(count := self.resolve(head.get("N"))):
            raise self.v.malformed("object stream is malformed", at, object=pack)
        seen, above = {pack}, head.get("Extends")
        while isinstance(above, Ref):
            row = self.rows.get(above.number, ("free", 0, 0))
            if above.number in seen or row[0] != "plain":
                raise self.v.malformed("object streams extend each other in a circle", at, object=pack)
            seen.add(above.number)
            value = self._object_at(row[1])[0]
            above = value.get("Extends") if isinstance(value, dict) else None
        raw = self.unfilter(head, body, at)
        words = raw[:first].split()
        if len(words) != 2 * count or not all(w.isdigit() and len(w) < 12 for w in words):
            raise self.v.malformed("object stream table is malformed", at, object=pack)
        return raw, [int(w) for w in words], first

    def parse(self, data: bytes, at: int, depth: int = 0):
        """One value and where it ends."""
        m = _VALUE.match(data, at)
        if m is None or depth > 64 or m.lastindex == _CLOSE:
            raise self.v.malformed("PDF value is malformed", at)
        if m.lastindex in (_DICT, _LIST):
            return self._items(data, at, m, depth)
        return _scalar(m), m.end()

    def _items(self, data: bytes, at: int, opened: re.Match, depth: int):
        """The dictionary or list that is opened, and where it ends."""
        items, end, close, match = [], opened.end(), b">>" if opened.lastindex == _DICT else b"]", _VALUE.match
        while True:
            m = match(data, end)
            kind = m.lastindex if m is not None else _CLOSE
            if kind == _CLOSE and m is not None and m[_CLOSE] == close:
                break
            if kind == _CLOSE or depth >= 64:
                raise self.v.malformed("PDF value is malformed", end)
            if kind == _DICT or kind == _LIST:
                value, end = self._items(data, end, m, depth + 1)
            else:
                value, end = _scalar(m), m.end()
            items.append(value)
        if close == b"]":
            return items, m.end()
        if len(items) % 2 or not all([type(k) is Name for k in items[::2]]):
            raise self.v.malformed("PDF dictionary is malformed", at)
        found = dict(zip(items[::2], items[1::2], strict=True))
        if len(found) < len(items) // 2:
            self._repeats(items, at)
        return found, m.end()

    def _repeats(self, items: list, at: int) -> None:
        """A key that is repeated is an error, but for a /MediaBox that is repeated with one value."""
        for key in {k for k in items[::2] if items[::2].count(k) > 1}:
            values = [v for k, v in zip(items[::2], items[1::2], strict=True) if k == key]
            if key != "MediaBox" or any(v != values[0] for v in values):
                raise self.v.malformed("PDF dictionary repeats a key", at)
        self.repaired.append((at, "equal MediaBox repeated"))

    def _pages(self, ref, depth: int, above: set, inherited: dict) -> Iterator[dict]:
        """Leaves in document order; ``/Count`` is checked against them."""
        node = self.resolve(ref)
        number = ref.number if isinstance(ref, Ref) else -1
        if not isinstance(node, dict) or depth > MAX_TREE_DEPTH or number in above:
            raise self.v.malformed("page tree is malformed", None, object=max(0, number))
        box = self.resolve(node.get("MediaBox")) or inherited.get("MediaBox")
        if box is not None and not isinstance(box, list):
            raise self.v.malformed("MediaBox is not an array", None, object=max(0, number))
        if node.get("Type") == "Page" or "Kids" not in node:
            yield {"number": number, "generation": ref.generation if isinstance(ref, Ref) else 0, "media_box": box}
            return
        kids = self.resolve(node["Kids"]) or []
        if not isinstance(kids, list):
            raise self.v.malformed("page tree is malformed", None, object=max(0, number))
        found = [p for kid in kids for p in self._pages(kid, depth + 1, above | {number}, {"MediaBox": box})]
        if self.resolve(node.get("Count")) != len(found):
            raise self.v.malformed("page tree count differs from its pages", None, object=max(0, number))
        yield from found

    def objects(self) -> Iterator[dict]:
        for number, (kind, a, b) in sorted(self.rows.items()):
            yield {"number": number, "generation": b if kind == "plain" else 0, "kind": kind, "offset": a}

    def references(self) -> Iterator[tuple[int, int]]:
        """(owner, target) pairs of all live objects."""

        def walk(value):
            if isinstance(value, Ref):
                yield value.number
            for part in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
                yield from walk(part)

        for number, (kind, _, b) in sorted(self.rows.items()):
            if kind != "free":
                for target in sorted(set(walk(self.resolve(Ref(number, b if kind == "plain" else 0))))):
                    yield number, target


def append_outline(data: bytes, bookmarks: list[tuple[int, str, int]], limits: Limits = Limits()) -> bytes:
    """``data`` and an update that adds ``bookmarks`` (depth, title, page index).

    Nothing to add, or an outline that is already there, leaves the bytes as they are.
    """
    pdf = Pdf(data, limits)
    if not bookmarks or pdf.has_outline:
        return data[: pdf.end]
    first = max([*pdf.rows, 0]) + 1
    nodes = [{"parent": 0, "kids": [], "depth": -1}]
    stack = [0]
    for depth, title, page in bookmarks:
        if not title or not 0 <= page < len(pdf.pages) or not 0 <= depth < len(stack):
            raise View(data, "PDF").malformed("bookmark is empty, too deep or outside the document", None)
        del stack[depth + 1 :]
        nodes.append({"parent": stack[-1], "kids": [], "title": title, "page": pdf.pages[page], "place": len(nodes[stack[-1]]["kids"])})
        nodes[stack[-1]]["kids"].append(len(nodes) - 1)
        stack.append(len(nodes) - 1)
    count = [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        count[nodes[k]["parent"]] += count[k] + 1
    texts: dict[int, str] = {}
    for k, node in enumerate(nodes):
        kids = node["kids"]
        parts = [f"/First {first + kids[0]} 0 R /Last {first + kids[-1]} 0 R /Count {count[k]}"] if kids else []
        if k:
            row, place = nodes[node["parent"]]["kids"], node["place"]
            parts += [f"/Title <{utf16_hex(node['title'])}> /Parent {first + node['parent']} 0 R /Dest [{node['page']['number']} {node['page']['generation']} R /Fit]"]
            parts += [f"/Prev {first + row[place - 1]} 0 R"] if place else []
            parts += [f"/Next {first + row[place + 1]} 0 R"] if place + 1 < len(row) else []
        texts[first + k] = "<< " + ("/Type /Outlines " if not k else "") + " ".join(parts) + " >>"
    root = pdf.trailer["Root"]
    texts[root.number] = f"<< {without_keys(pdf, root.number, 'Outlines').decode('latin-1')} /Outlines {first} 0 R >>"
    return update(pdf, texts, first + len(nodes))


def update(pdf: Pdf, texts: dict[int, str], size: int) -> bytes:
    """The file and an update that writes objects anew; numbers from ``size`` on are free.

    A file with packed objects gets a cross-reference stream, since its readers need one to find them.
    """
    body, offsets = bytearray(pdf.data[: pdf.end] + b"\n"), {}
    generations = {n: g for n, (kind, _, g) in pdf.rows.items() if kind == "plain"}
    for number, text in texts.items():
        offsets[number] = len(body)
        body.extend(f"{number} {generations.get(number, 0)} obj\n{text}\nendobj\n".encode("latin-1"))
    table, root = len(body), pdf.trailer["Root"]
    kept = "".join(f" /{k} {t.number} {t.generation} R" for k in ("Info",) if isinstance(t := pdf.trailer.get(k), Ref))
    kept += _next_id(pdf, table)
    kept = f"/Root {root.number} {root.generation} R{kept} /Prev {pdf.startxref}"
    if any(kind == "packed" for kind, _, _ in pdf.rows.values()):
        offsets[size] = table
        rows = b"".join(b"\1" + o.to_bytes(5, "big") + generations.get(n, 0).to_bytes(2, "big") for n, o in sorted(offsets.items()))
        index = " ".join(f"{n} 1" for n in sorted(offsets))
        body += f"{size} 0 obj\n<< /Type /XRef /Size {size + 1} /W [1 5 2] /Index [{index}] {kept} /Length {len(rows)} >>\nstream\n".encode("latin-1") + rows + b"\nendstream\nendobj\n"
    else:
        body += b"xref\n" + b"".join(f"{n} 1\n{o:010d} {generations.get(n, 0):05d} n \n".encode() for n, o in sorted(offsets.items()))
        body += f"trailer\n<< /Size {size} {kept} >>\n".encode("latin-1")
    body += f"startxref\n{table}\n%%EOF\n".encode()
    if len(body) > pdf.limits.max_output_bytes:
        raise pdf.v.error("LimitExceeded", "output bytes", None, (pdf.limits.max_output_bytes, len(body)))
    return bytes(body)


def fnv128(raw: bytes) -> int:
    value = FNV_START
    for octet in raw:
        value = (value ^ octet) * FNV_PRIME & (1 << 128) - 1
    return value


def _next_id(pdf: Pdf, table: int) -> str:
    """The /ID of an update: the file's first identifier stays, the second follows from the old ones and
    the places of the update; a file without /ID gets none, a referenced one is kept."""
    old = pdf.trailer.get("ID")
    if isinstance(old, Ref):
        return f" /ID {old.number} {old.generation} R"
    if not isinstance(old, list) or len(old) != 2 or not all(isinstance(x, bytes) and x[:1] in (b"(", b"<") for x in old):
        return ""
    mark = fnv128(pdf.id_text + pdf.end.to_bytes(8, "little") + table.to_bytes(8, "little"))
    return f" /ID [{old[0].decode('latin-1')} <{mark:032X}>]"


def entry(pdf: Pdf, source: bytes, start: int, key: str) -> bytes:
    """The bytes of one value of the dictionary at ``start``; none if it has no such key."""
    at = _TOKEN.match(source, start).end()
    while (m := _TOKEN.match(source, at)) and m[1] != b">>":
        name, at = pdf.parse(source, at)
        _, after = pdf.parse(source, at)
        if name == key:
            return source[at:after].strip(_SPACE)
        at = after
    return b""


def without_keys(pdf: Pdf, number: int, *keys: str, again: bool = False) -> bytes:
    """The inside of the dictionary of object ``number`` without entries; with ``again``, without those that come a second time."""
    kind, at, index = pdf.rows[number]
    source = pdf.data
    if kind == "plain":
        start = _HEAD.match(source, at).end()
    else:
        pdf.resolve(Ref(number, 0))
        source, members, first = pdf.packs[at]
        start = first + members[2 * index + 1]
    at = _TOKEN.match(source, start).end()
    begin, out, seen = at, b"", set()
    while (m := _TOKEN.match(source, at)) and m[1] != b">>":
        name, after = pdf.parse(source, at)
        _, after = pdf.parse(source, after)
        if name in keys or again and name in seen:
            out, begin = out + source[begin:at], after
        seen.add(name)
        at = after
    return (out + source[begin:at]).strip(_SPACE)
