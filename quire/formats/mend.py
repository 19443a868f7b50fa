"""Repairs of PDFs that can be read: an update that writes the objects at fault anew.

Only what has one right answer is repaired: a /MediaBox that a node of the page tree repeats with
one value, a page's /Parent that is not the node that lists it, and /Prev and /Last of
outline entries, which follow from the chain of /Next. A file without faults stays as it is, byte for byte.
"""

from __future__ import annotations

from bisect import bisect_right

from quire.formats import pdfcheck
from quire.formats.pdf import Pdf, Ref, update, without_keys


def faults(pdf: Pdf) -> list[tuple[int, str, int | None]]:
    """(object, key, what it must refer to) of all that is repaired, in order of objects; no target where an entry is only removed."""
    found: list[tuple[int, str, int | None]] = []
    starts = sorted((at, number) for number, (kind, at, _) in pdf.rows.items() if kind == "plain")
    for at, _ in pdf.repaired:
        k = bisect_right(starts, (at, 1 << 62)) - 1
        if k >= 0:
            found.append((starts[k][1], "MediaBox", None))
    todo, seen = [pdf.catalog.get("Pages")], set()
    while todo:
        above = todo.pop()
        node = pdf.resolve(above)
        if not isinstance(above, Ref) or not isinstance(node, dict) or above.number in seen:
            continue
        seen.add(above.number)
        for kid in pdf.resolve(node.get("Kids")) or []:
            own, parent = pdf.resolve(kid), None
            if isinstance(kid, Ref) and isinstance(own, dict):
                parent = own.get("Parent")
                if not isinstance(parent, Ref) or parent.number != above.number:
                    found.append((kid.number, "Parent", above.number))
                todo.append(kid)
    for row in pdfcheck.outline(pdf):
        if row["problem"] == "previous link differs":
            found.append((row["number"], "Prev", row["previous"]))
        if row["problem"] == "last link differs":
            found.append((row["parent"], "Last", row["number"]))
    return sorted(set(found), key=str)


def repair(pdf: Pdf) -> tuple[bytes, int]:
    """The file, with an update if something is wrong that has one right answer, and the number of objects written anew."""
    by_object: dict[int, dict[str, int | None]] = {}
    for number, key, target in faults(pdf):
        by_object.setdefault(number, {})[key] = target
    if not by_object:
        return pdf.data, 0
    texts = {}
    for number, keys in sorted(by_object.items()):
        gone = [k for k, target in keys.items() if target is not None or k != "MediaBox"]
        inner = without_keys(pdf, number, *gone, again="MediaBox" in keys).decode("latin-1")
        links = "".join(f" /{k} {t} {pdf.rows[t][2] if pdf.rows[t][0] == 'plain' else 0} R" for k, t in sorted(keys.items()) if t is not None)
        texts[number] = f"<< {inner}{links} >>"
    return update(pdf, texts, max(pdf.rows) + 1), len(texts)
