"""Checks of an indexed PDF: where objects stand, what they refer to, boxes, outline and named destinations.

The reader of ``quire.formats.pdf`` stops at what it cannot follow; these checks tell what is
wrong with a file that can be read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from quire.formats.errors import FormatError
from quire.formats.fragment import _BLANK, _ENDOBJ, _ENDSTREAM, targets
from quire.formats.pdf import _HEAD, Name, Pdf, Ref

MAX_DEPTH = 256
#: Beginnings of the problems with which a PDF is not copied.
REFUSED = ("object overlaps", "reference to absent", "page has no valid")
_SECTION = re.compile(rb"(?:xref[\0\t\n\x0c\r ].*?)?startxref\s+\d+\s+%%EOF", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.))", re.S)


def raw_string(token) -> bytes | None:
    """The bytes of a string token, literal or hex; None if it is no string."""
    if not isinstance(token, bytes) or token[:1] not in (b"(", b"<"):
        return None
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] else _ESCAPES.get(m[3], m[3]), token[1:-1])


def text_string(token) -> str | None:
    raw = raw_string(token)
    if raw is None:
        return None
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def object_end(pdf: Pdf, at: int) -> int:
    """Where the object at ``at`` ends, endobj included."""
    _, value, end, start = pdf.read_at(at)
    if start is not None:
        closed = _ENDSTREAM.match(pdf.data, start + (pdf.resolve(value.get("Length")) or 0))
        end = closed.end() if closed else end
    closed = _ENDOBJ.match(pdf.data, end)
    if closed is None:
        raise pdf.v.malformed("endobj is missing", end)
    return closed.end()


def spans(pdf: Pdf) -> Iterator[dict]:
    """``number, offset, end`` of the objects that stand in the file by themselves, in its order.

    ``gap_problem`` is where something else than blanks, older revisions and cross-reference
    sections stands before an object.
    """
    before = 0
    for number, (_, at, _) in sorted(((n, r) for n, r in pdf.rows.items() if r[0] == "plain"), key=lambda x: x[1][1]):
        pdf.resolve(Ref(number, 0))
        end = object_end(pdf, at)
        yield {"number": number, "offset": at, "end": end, "gap_problem": _gap(pdf, before, at) if before and before <= at else None}
        before = max(before, end)


def _gap(pdf: Pdf, at: int, end: int) -> int | None:
    while (at := _BLANK.match(pdf.data, at, end).end()) < end:
        section, head = _SECTION.match(pdf.data, at, end), _HEAD.match(pdf.data, at, end)
        try:
            after = section.end() if section else object_end(pdf, at) if head and int(head[1]) in pdf.rows else at
        except FormatError:
            return at
        if after <= at:
            return at
        at = after
    return None


def named_destinations(pdf: Pdf) -> Iterator[dict]:
    """``name, page_index, problem`` of the old dictionary and of the name tree; names must rise within their limits."""
    places = {p["number"]: k for k, p in enumerate(pdf.pages)}

    def row(name: str, value) -> dict:
        value = pdf.resolve(value)
        value = pdf.resolve(value.get("D")) if isinstance(value, dict) else value
        page = places.get(value[0].number) if isinstance(value, list) and value and isinstance(value[0], Ref) else None
        return {"name": name, "page_index": page, "problem": None if page is not None else "destination is not a page"}

    old = pdf.resolve(pdf.catalog.get("Dests"))
    for name, value in old.items() if isinstance(old, dict) else ():
        yield row(str(name), value)
    names = pdf.resolve(pdf.catalog.get("Names"))
    todo = [(names["Dests"], 0)] if isinstance(names, dict) and "Dests" in names else []
    seen, last = set(), None
    while todo:
        ref, depth = todo.pop()
        node, number = pdf.resolve(ref), ref.number if isinstance(ref, Ref) else None
        if not isinstance(node, dict) or number in seen or depth > 64:
            yield {"name": None, "page_index": None, "problem": "name tree is malformed"}
            continue
        seen |= {number} - {None}
        todo += [(k, depth + 1) for k in reversed(pdf.resolve(node.get("Kids")) or [])]
        pairs, limits = pdf.resolve(node.get("Names")) or [], [raw_string(x) for x in pdf.resolve(node.get("Limits")) or []]
        for key, value in zip(pairs[::2], pairs[1::2], strict=False):
            raw = raw_string(key)
            found = row(text_string(key), value)
            if raw is None or last is not None and raw <= last or len(limits) == 2 and not limits[0] <= raw <= limits[1]:
                found["problem"] = "name is out of order or outside its limits"
            last = raw if raw is not None else last
            yield found


def outline(pdf: Pdf) -> Iterator[dict]:
    """``ordinal, number, depth, title, page_index, problem`` of the entries in order; a broken link ends its row of siblings."""
    root = pdf.catalog.get("Outlines")
    top = pdf.resolve(root)
    if not isinstance(top, dict) or not isinstance(top.get("First"), Ref):
        return
    places, names = {p["number"]: k for k, p in enumerate(pdf.pages)}, {r["name"]: r["page_index"] for r in named_destinations(pdf)}
    number = root.number if isinstance(root, Ref) else None
    stack, seen, ordinal = [(top["First"], None, number, top.get("Last"), 0)], set(), 0
    while stack:
        ref, previous, parent, last, depth = stack.pop()
        node = pdf.resolve(ref)
        if not isinstance(node, dict) or ref.number in seen or depth >= MAX_DEPTH:
            yield {"ordinal": ordinal, "number": ref.number, "depth": depth, "problem": "entry is missing, repeated or too deep"}
            continue
        seen.add(ref.number)
        link = lambda k: node[k].number if isinstance(node.get(k), Ref) else None  # noqa: B023, E731
        following = node.get("Next")
        problem = "parent link differs" if link("Parent") != parent else "previous link differs" if link("Prev") != previous else None
        if problem is None and not isinstance(following, Ref) and isinstance(last, Ref) and last.number != ref.number:
            problem = "last link differs"
        title, page = text_string(pdf.resolve(node.get("Title"))), _destination(pdf, node, places, names)
        if problem is None and (title is None or page is None and ("Dest" in node or "A" in node)):
            problem = "title is missing" if title is None else "destination is not a page"
        yield {"ordinal": ordinal, "number": ref.number, "depth": depth, "title": title, "page_index": page, "problem": problem, "previous": previous, "parent": parent}
        ordinal += 1
        if isinstance(following, Ref):
            stack.append((following, ref.number, parent, last, depth))
        if isinstance(node.get("First"), Ref):
            stack.append((node["First"], None, ref.number, node.get("Last"), depth + 1))


def _destination(pdf: Pdf, node: dict, places: dict, names: dict) -> int | None:
    action = pdf.resolve(node.get("A"))
    goal = pdf.resolve(node.get("Dest")) or (pdf.resolve(action.get("D")) if isinstance(action, dict) and action.get("S") == "GoTo" else None)
    if isinstance(goal, list):
        return places.get(goal[0].number) if goal and isinstance(goal[0], Ref) else None
    return names.get(str(goal) if isinstance(goal, Name) else text_string(goal))


def _has_contents(pdf: Pdf, page: dict) -> bool:
    """Whether a page has a stream, or a list of streams, or nothing; absent objects are told of elsewhere."""
    node = pdf.resolve(Ref(page["number"], page["generation"]))
    value = node.get("Contents") if isinstance(node, dict) else None
    if value is None or isinstance(value, Ref) and (pdf.is_stream(value) or pdf.resolve(value) is None):
        return True
    parts = pdf.resolve(value)
    return isinstance(parts, list) and all(isinstance(x, Ref) and (pdf.is_stream(x) or pdf.resolve(x) is None) for x in parts)


def problems(pdf: Pdf) -> Iterator[dict]:
    """``number, offset, problem`` of what is wrong, in order of the kinds of checks."""
    furthest = 0
    for s in spans(pdf):
        if s["offset"] < furthest:
            yield {"number": s["number"], "offset": s["offset"], "problem": "object overlaps the one before it"}
        elif s["gap_problem"] is not None:
            yield {"number": s["number"], "offset": s["gap_problem"], "problem": "bytes between objects are not blank"}
        furthest = max(furthest, s["end"])
    for number, (kind, at, generation) in sorted(pdf.rows.items()):
        value = pdf.resolve(Ref(number, generation if kind == "plain" else 0)) if kind != "free" else None
        absent = {t for t in targets(value) if pdf.rows.get(t, ("free",))[0] == "free"}
        for target in sorted(absent) if absent else ():
            parent = value.get("Parent") if isinstance(value, dict) else None
            stale = isinstance(parent, Ref) and parent.number == target and target in pdf.rows and list(targets(value)).count(target) == 1
            if not stale:
                yield {"number": number, "offset": at if kind == "plain" else None, "problem": f"reference to absent object {target}"}
    for page in pdf.pages:
        box = page["media_box"]
        box = [pdf.resolve(x) for x in box] if isinstance(box, list) else None
        if not box or len(box) != 4 or not all(isinstance(x, int | float) for x in box) or box[0] == box[2] or box[1] == box[3]:
            yield {"number": page["number"], "offset": None, "problem": "page has no valid MediaBox"}
        if not _has_contents(pdf, page):
            yield {"number": page["number"], "offset": None, "problem": "page contents are not streams"}
    for row in outline(pdf):
        if row["problem"]:
            yield {"number": row["number"], "offset": None, "problem": f"outline: {row['problem']}"}
    for row in named_destinations(pdf):
        if row["problem"]:
            yield {"number": None, "offset": None, "problem": f"named destination: {row['problem']}"}
    rest = _BLANK.match(pdf.data, pdf.end).end()
    if rest < len(pdf.data):
        yield {"number": None, "offset": rest, "problem": "bytes after the end of the file"}
