"""PDF bodies without header, table or trailer, and whole files made of them again.

A body is framed object by object. Pages are listed from outside; what stands above them in
the page tree may be absent and is then supplied.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from quire.formats import caj
from quire.formats.errors import FormatError, Limits, View
from quire.formats.pdf import _HEAD, _TOKEN, Pdf, Ref, append_outline

_BLANK = re.compile(rb"(?:[\0\t\n\x0c\r ]|%[^\r\n]*)*")
_STREAM = re.compile(rb"[\0\t\n\x0c\r ]*stream(?:\r\n|\n)")
_ENDSTREAM = re.compile(rb"[\0\t\n\x0c\r ]*endstream")
_ENDOBJ = re.compile(rb"[\0\t\n\x0c\r ]*endobj")
_CLOSED = re.compile(rb"endstream[\0\t\n\x0c\r ]+endobj")
_NEXT = re.compile(rb"endobj(?=[\0\t\n\x0c\r ]+\d+[\0\t\n\x0c\r ]+\d+[\0\t\n\x0c\r ]+obj)")
#: Fixed value: the box of pages whose parents are absent and that have none themselves.
FALLBACK_BOX = "[0 0 612 792]"


def targets(value) -> Iterator[int]:
    """Numbers of the objects a value refers to."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, Ref):
            yield v.number
        elif isinstance(v, dict | list):
            todo += v.values() if isinstance(v, dict) else v


class Fragment(Pdf):
    """Objects of ``data[start:end]`` by number; ``damaged`` are those passed over if that is allowed.

    The first problem in order of bytes is the error. An object that is repeated byte for byte
    counts once; the same number with other bytes is an error.
    """

    def __init__(self, data: bytes, start: int, end: int, limits: Limits = Limits(), allow_damaged: bool = False):
        self.data, self.limits, self.v = data[:end], limits, View(data[:end], "PDF")
        self.rows, self.spans, self.values, self.packs, self.repaired = {}, {}, {}, {}, []
        self.known, self.kept = {}, 0
        #: How many stream lengths were mended.
        self.lengths = 0
        self.damaged: dict[int, int] = {}
        at = _BLANK.match(self.data, start).end()
        while at < end:
            try:
                at = self._frame(at)
            except FormatError:
                if not allow_damaged:
                    raise
                head, after = _HEAD.match(self.data, at), _NEXT.search(self.data, at)
                if head:
                    self.damaged[int(head[1])] = at
                at = after.end() if after else end
            at = _BLANK.match(self.data, at).end()
        for number in list(self.rows):
            try:
                self.values[number] = self._object_at(self.rows[number][1])[0]
            except FormatError:
                if not allow_damaged:
                    raise
                self.damaged[number] = self.rows.pop(number)[1]
                del self.spans[number]
        for number in self.damaged:
            self.rows.pop(number, None)
            self.values.pop(number, None)

    def _frame(self, at: int) -> int:
        """Where the object at ``at`` ends; an indirect length is checked once all objects are known."""
        head = _HEAD.match(self.data, at)
        if head is None:
            raise self.v.malformed("object header is missing", at)
        number = int(head[1])
        value, end = self.parse(self.data, head.end())
        stream = _STREAM.match(self.data, end) if isinstance(value, dict) else None
        if stream:
            length = value.get("Length")
            if isinstance(length, Ref):
                closed = _CLOSED.search(self.data, stream.end())
                end = closed.start() if closed else len(self.data)
            elif isinstance(length, int) and length >= 0:
                end = stream.end() + length
            else:
                raise self.v.malformed("stream length is invalid", at, object=number)
            closed = _ENDSTREAM.match(self.data, end)
            if closed is None and isinstance(length, int):
                closed = self._mended_length(at, number, length, stream.end())
            if closed is None:
                raise self.v.malformed("stream length is invalid", at, object=number)
            end = closed.end()
        closed = _ENDOBJ.match(self.data, end)
        if closed is None:
            raise self.v.malformed("endobj is missing", end, object=number)
        if number in self.rows:
            a, b = self.spans[number]
            if self.data[a:b] != self.data[at : closed.end()]:
                raise self.v.malformed("object number is repeated", at, object=number)
        else:
            self.rows[number], self.spans[number] = ("plain", at, int(head[2])), (at, closed.end())
        return closed.end()

    def _mended_length(self, at: int, number: int, length: int, start: int) -> re.Match | None:
        """Writes the length that the first end of the stream behind its start gives, if it has as many digits; the end."""
        closed = _CLOSED.search(self.data, start)
        head = re.compile(rb"/Length[\0\t\n\x0c\r ]+(%d)(?!\d)" % length).search(self.data, at, start)
        if closed is None or head is None or _HEAD.search(self.data, start, closed.start()):
            return None
        size = closed.start() - start
        size -= 2 if self.data[closed.start() - 2 : closed.start()] == b"\r\n" else 1 if self.data[closed.start() - 1 : closed.start()] in (b"\r", b"\n") else 0
        text = str(size).encode()
        if size < 0 or len(text) != len(head[1]):
            raise self.v.error("UnsupportedFormat", "stream length repair changes the width of an object", at, object=number)
        self.data = self.data[: head.start(1)] + text + self.data[head.end(1) :]
        self.lengths += 1
        return _ENDSTREAM.match(self.data, start + size)

    def without(self, number: int, key: str) -> bytes:
        """The object's bytes without one entry of its dictionary."""
        start, end = self.spans[number]
        at = _TOKEN.match(self.data, _HEAD.match(self.data, start).end()).end()
        while (m := _TOKEN.match(self.data, at)) and m[1] != b">>":
            name, after = self.parse(self.data, at)
            _, after = self.parse(self.data, after)
            if name == key:
                return self.data[start:at] + self.data[after:end]
            at = after
        return self.data[start:end]


class PageTree:
    """What stands above the listed pages: one present root, or nodes to supply.

    ``missing``: for each absent parent, in order of its first page, the kids it must have and
    how many pages are below it; ``root``: the number of the tree's top.
    """

    def __init__(self, body: Fragment, pages: list[int], offsets: list[int], v: View, highest: int):
        nodes = {n: x for n, x in body.values.items() if isinstance(x, dict) and x.get("Type") in ("Page", "Pages")}
        known: dict[int, tuple] = {}
        self.missing: dict[int, dict] = {}
        present = set()
        for page, offset in zip(pages, offsets, strict=True):
            path, node = [], page
            while node not in known:
                if node in path:
                    raise v.malformed("PDF page-tree parent cycle", offset)
                if node not in nodes or node == page and nodes[node].get("Type") != "Page":
                    raise v.malformed("CAJ page object is missing or is not a Page", offset)
                path.append(node)
                parent = nodes[node].get("Parent")
                if not isinstance(parent, Ref):
                    known[node] = ("present", node)
                elif parent.number not in body.rows:
                    known[node] = ("absent", parent.number, node)
                elif parent.number not in nodes:
                    raise v.malformed("PDF page parent is not a Pages object", offset)
                else:
                    node = parent.number
            top = known[node]
            known |= dict.fromkeys(path, top)
            if top[0] == "present":
                present.add(top[1])
                if len(present) > 1:
                    raise v.malformed("CAJ pages have multiple existing roots", offset)
            else:
                group = self.missing.setdefault(top[1], {"kids": {}, "count": 0})
                group["kids"][top[2]] = None
                group["count"] += 1
        if present and self.missing:
            raise v.malformed("CAJ pages have mixed page-tree roots", offsets[0])
        self.root = present.pop() if present else next(iter(self.missing)) if len(self.missing) == 1 else max(highest, *self.missing) + 1

    def supplied(self) -> Iterator[tuple[int, str]]:
        """Numbers and texts of the nodes that are absent."""

        def node(kids, count, parent):
            above = f"/Parent {parent} 0 R" if parent else f"/MediaBox {FALLBACK_BOX}"
            return f"<< /Type /Pages {above} /Count {count} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>"

        several = len(self.missing) > 1
        for number, group in self.missing.items():
            yield number, node(group["kids"], group["count"], self.root if several else 0)
        if several:
            yield self.root, node(self.missing, sum(g["count"] for g in self.missing.values()), 0)


def blank_damaged(body: Fragment, pages: list[int]) -> dict[int, bytes]:
    """Blank pages in place of those that depend on a damaged object; other dependent objects leave the body.

    Damage that reaches a node above pages is an error, since it concerns pages that are whole.
    """
    users = defaultdict(set)
    for owner, value in body.values.items():
        inner = {k: x for k, x in value.items() if k not in ("Parent", "Kids")} if isinstance(value, dict) else value
        for target in targets(inner):
            users[target].add(owner)
    reached, todo, listed = set(body.damaged), list(body.damaged), set(pages)
    while todo:
        node = todo.pop()
        if node not in body.damaged and node in listed:
            continue
        for owner in users[node] - reached:
            reached.add(owner)
            todo.append(owner)
    blank: dict[int, bytes] = {}
    above = {k: n for n, x in body.values.items() if isinstance(x, dict) and x.get("Type") == "Pages" for k in targets(x.get("Kids", []))}
    for node in sorted(reached - listed):
        value = body.values.pop(node, None)
        if isinstance(value, dict) and value.get("Type") == "Pages":
            raise body.v.malformed("damage reaches the page tree", body.rows[node][1], object=node)
        body.rows.pop(node, None)
        body.spans.pop(node, None)
    parents = [p.number if isinstance(p := (body.values.get(n) or {}).get("Parent"), Ref) else above.get(n) for n in pages]
    known = [p for p in parents if p]
    for k, page in enumerate(pages):
        if page in reached:
            parent = parents[k] or next((p for p in reversed(parents[:k]) if p), known[0] if known else None)
            if parent is None:
                raise body.v.malformed("no page is left that names a parent", body.damaged.get(page), object=page)
            box = (body.values.get(page) or {}).get("MediaBox")
            shown = f" /MediaBox [{' '.join(f'{x:g}' for x in box)}]" if isinstance(box, list) and all(isinstance(x, int | float) for x in box) else ""
            blank[page] = f"{page} 0 obj\n<< /Type /Page /Parent {parent} 0 R{shown} >>\nendobj".encode()
            body.rows[page] = ("plain", body.damaged.get(page, 0) or body.rows.get(page, ("", 0))[1], 0)
            body.values[page] = {"Type": "Page", "Parent": Ref(parent, 0)}
            parents[k] = parent
    return blank


def mend_links(body: Fragment, pages: list[int], tree: PageTree) -> dict[int, bytes]:
    """Objects whose references lead nowhere, without the entry at fault.

    Only a link annotation may lose its /Dest to a page that is not listed, or its one absent
    appearance; any other reference to an absent object is an error.
    """
    listed, mended = set(pages), {}
    for owner, value in body.values.items():
        inner = {k: x for k, x in value.items() if not (k == "Parent" and value.get("Type") in ("Page", "Pages"))} if isinstance(value, dict) else value
        absent = sorted({t for t in targets(inner) if t not in body.rows})
        if not absent:
            continue
        link = isinstance(value, dict) and value.get("Subtype") == "Link" and len(absent) == 1 and absent[0] not in tree.missing
        key = next((k for k in ("Dest", "AP") if link and absent[0] in targets(value.get(k))), None)
        rest = {k: x for k, x in value.items() if k != key} if key else {}
        if not key or absent[0] in targets(rest) or absent[0] in listed:
            raise body.v.malformed("indirect reference targets a missing object", body.rows[owner][1], object=owner)
        mended[owner] = body.without(owner, key)
    return mended


def rebuild(data: bytes, limits: Limits = Limits(), *, include_bookmarks: bool = True, allow_damaged: bool = False) -> dict:
    """``pdf, page_count, bookmark_count, repaired_links, omitted_pages`` of a CAJ document.

    Pages come in the order of the page table. ``omitted_pages`` (page_index, offset) are blank
    because something they depend on is damaged; there are none unless ``allow_damaged``.
    """
    found, v = caj.read(data, limits), View(data, "CAJ")
    pages, offsets = [p[2] for p in found["pages"]], [p[0] for p in found["pages"]]
    body = Fragment(data, offsets[0], offsets[-1] + found["pages"][-1][1], limits, allow_damaged)
    changed = blank_damaged(body, pages) if body.damaged else {}
    omitted = [{"page_index": k, "offset": offsets[k]} for k, n in enumerate(pages) if n in changed]
    highest = max([*body.rows, *(t for x in body.values.values() for t in targets(x))])
    tree = PageTree(body, pages, offsets, v, highest)
    mended = mend_links(body, pages, tree)
    changed |= mended
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}

    def write(number: int, generation: int, text: bytes) -> None:
        places[number] = (len(out), generation)
        out.extend(text + b"\n")

    for number, (_, at, generation) in sorted(body.rows.items(), key=lambda r: r[1][1]):
        text = changed.get(number)
        write(number, 0 if number in changed and number not in mended else generation, text if text is not None else body.data[slice(*body.spans[number])])
    for number, text in tree.supplied():
        write(number, 0, f"{number} 0 obj\n{text}\nendobj".encode())
    catalog = max(highest, tree.root, *places) + 1
    write(catalog, 0, f"{catalog} 0 obj\n<< /Type /Catalog /Pages {tree.root} {places[tree.root][1]} R >>\nendobj".encode())
    table = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    run: list[int] = []
    for number in [*sorted(places), None]:
        if run and number != run[-1] + 1:
            out += f"{run[0]} {len(run)}\n".encode() + b"".join(f"{places[n][0]:010d} {places[n][1]:05d} n \n".encode() for n in run)
            run = []
        run.append(number)
    out += f"trailer\n<< /Size {catalog + 1} /Root {catalog} 0 R >>\nstartxref\n{table}\n%%EOF\n".encode()
    written = Pdf(bytes(out), limits)
    if [p["number"] for p in written.pages] != pages:
        raise v.malformed("page tree does not hold the listed pages in order", offsets[0])
    bookmarks = found["bookmarks"] if include_bookmarks else []
    whole = append_outline(bytes(out), bookmarks, limits)
    return {"pdf": whole, "page_count": len(pages), "bookmark_count": len(bookmarks), "repaired_links": len(mended), "repaired_objects": body.lengths, "omitted_pages": omitted}
