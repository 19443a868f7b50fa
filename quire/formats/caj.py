"""CAJ containers: header, page table and outline, all validated.

The page table is read as one structured array. Each rule is a mask over its rows; the
first row that breaks a rule decides, and within a row the first rule.
"""

from __future__ import annotations

import numpy as np

from quire.formats.errors import Limits, View
from quire.formats.text import gb18030

#: Fixed values of the layout.
MAGIC = b"CAJ\0"
PAGE_COUNT, PAGE_TABLE, TOC_COUNT, TOC = 0x10, 0x14, 0x110, 0x114
TOC_BYTES = 308
ROW = np.dtype([("offset", "<u4"), ("length", "<u4"), ("object", "<u4")])


def read(data: bytes, limits: Limits = Limits()) -> dict:
    """``page_count``, ``pages`` (offset, length, page_object_id) and ``bookmarks`` (depth, title, page_index)."""
    v = View(data, "CAJ")
    if v.take(0, 4) != MAGIC:
        v.structure = ""
        raise v.error("UnsupportedFormat", "", None)
    pages = v.number(PAGE_COUNT, 4, signed=True)
    if pages <= 0:
        raise v.malformed("CAJ page count must be positive", PAGE_COUNT)
    if pages > limits.max_pages:
        raise v.error("LimitExceeded", "CAJ pages", PAGE_COUNT, (limits.max_pages, pages))
    table = v.number(PAGE_TABLE, 4)
    entries = v.number(TOC_COUNT, 4, signed=True)
    if entries < 0:
        raise v.malformed("CAJ TOC count is negative", TOC_COUNT)
    if entries > limits.max_bookmarks:
        raise v.error("LimitExceeded", "CAJ bookmarks", TOC_COUNT, (limits.max_bookmarks, entries))
    toc_end = TOC + TOC_BYTES * entries
    if toc_end > v.size:
        whole = max(0, v.size - TOC) // TOC_BYTES
        raise v.malformed("CAJ TOC record is truncated", v.size, record=min(whole, max(0, entries - 1)) + 1)
    if table < toc_end:
        raise v.malformed("CAJ page table overlaps the header or TOC", PAGE_TABLE)
    if table + pages * ROW.itemsize > v.size:
        raise v.malformed("CAJ page table extends beyond source", PAGE_TABLE)
    rows = np.frombuffer(data, ROW, pages, table)
    _check_rows(v, rows, table, limits)
    return {
        "page_count": pages,
        "pages": [(int(r["offset"]), int(r["length"]), int(r["object"])) for r in rows],
        "bookmarks": list(_outline(v, entries, pages)),
    }


def _check_rows(v: View, rows: np.ndarray, table: int, limits: Limits) -> None:
    start, ids = rows["offset"].astype(np.int64), rows["object"]
    end = start + rows["length"]
    gap = np.zeros(len(rows), bool)
    gap[1:] = start[1:] != end[:-1]
    early = np.zeros(len(rows), bool)
    early[0] = start[0] < table + len(rows) * ROW.itemsize
    rules = [
        (ids == 0, 8, "CAJ page object number must be positive"), (gap, 0, "CAJ page spans are not contiguous"),
        (early, 0, "CAJ PDF body overlaps the page table"), (end > v.size, 4, "CAJ page span extends beyond source"),
    ]
    broken = np.flatnonzero(np.any([mask for mask, _, _ in rules], axis=0))
    if len(broken):
        k = int(broken[0])
        field, reason = next((f, r) for mask, f, r in rules if mask[k])
        raise v.malformed(reason, table + k * ROW.itemsize + field, record=k + 1)
    body = int(end[-1] - start[0])
    if body == 0:
        raise v.malformed("CAJ PDF body is empty", table)
    if body > limits.max_input_bytes:
        raise v.error("LimitExceeded", "CAJ PDF input bytes", int(start[0]), (limits.max_input_bytes, body))
    _, first, times = np.unique(ids, return_index=True, return_counts=True)
    if (times > 1).any():
        repeated = np.flatnonzero(ids == ids[first[times > 1][0]])[1]
        raise v.malformed("duplicate CAJ page object number", table + int(repeated) * ROW.itemsize + 8, record=int(repeated) + 1)


def _outline(v: View, entries: int, pages: int):
    """Entries in order; a level may exceed the one before by one at most."""
    above = 0
    for k in range(entries):
        at, record = TOC + k * TOC_BYTES, k + 1
        raw = v.take(at, TOC_BYTES, record=record)
        name = raw[:256].split(b"\0", 1)[0]
        if not name:
            raise v.malformed("empty CAJ TOC title", at, record=record)
        title = gb18030(name)
        if isinstance(title, int):
            raise v.malformed("CAJ TOC title is not valid GB18030", at + title, record=record)
        page = _page_number(v, raw[280:292].split(b"\0", 1)[0], at + 280, record, pages)
        level = int.from_bytes(raw[304:308], "little", signed=True)
        if level <= 0:
            raise v.malformed("CAJ TOC level must be positive", at + 304, record=record)
        if level > above + 1:
            raise v.malformed("CAJ TOC level skips a parent", at + 304, record=record)
        above = level
        yield level - 1, title, page - 1


def _page_number(v: View, text: bytes, at: int, record: int, pages: int) -> int:
    blank = b" \t\n\x0c\r"
    digits = text.strip(blank)
    lead = len(text) - len(text.lstrip(blank))
    if not digits:
        raise v.malformed("empty TOC page number", at, record=record)
    for k, byte in enumerate(digits):
        if not 0x30 <= byte <= 0x39:
            raise v.malformed("TOC page number is not ASCII decimal", at + lead + k, record=record)
        if int(digits[: k + 1]) >= 1 << 32:
            raise v.malformed("TOC page number overflows", at + lead + k, record=record)
    if not 0 < int(digits) <= pages:
        raise v.malformed("TOC page number is outside the document", at, record=record)
    return int(digits)
