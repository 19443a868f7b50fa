"""The application-info package of C8 documents: DOI, URL and the number of notes."""

from __future__ import annotations

import re
import xml.parsers.expat
from collections.abc import Iterator
from xml.etree import ElementTree

from quire.formats.errors import FormatError, Limits
from quire.formats.paged import Container

#: Paths of the values that are read.
DOI = ("Package", "FileProperty-Package", "DOI")
URL = ("Package", "FileProperty-Package", "DURL")
NOTE = ("Package", "Note-Package", "NoteItems", "Item")
MAX_DEPTH, MAX_VALUE_BYTES = 16, 4096
#: Fixed values of links: attributes that a list of notes and a link must have; bounds of coordinates and of their number.
NOTES_PROFILE, LINK_PROFILE = {"Version": "1.0", "Unit": "PointsM"}, {"Type": "Link", "LineStyle": "4", "ShowType": "1"}
MAX_COORDINATE, MAX_LINKS = 1_440_000, 8192


def parse(raw: bytes) -> dict:
    """``doi, url, note_count`` of a package; ValueError where it is not as the format has it."""
    text = raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
    if re.search(r"<!(?!--|\[CDATA\[)", re.sub(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>", "", text, flags=re.S)):
        raise ValueError("declarations are not allowed")
    path: list[str] = []
    values: dict[tuple, str] = {}
    notes = 0
    parser = xml.parsers.expat.ParserCreate("utf-8")

    def open_(name, _):
        nonlocal notes
        path.append(name)
        here = tuple(path)
        if len(path) > MAX_DEPTH:
            raise ValueError("nesting is too deep")
        if len(path) == 1 and name != "Package":
            raise ValueError("root is not Package")
        if here[:3] in (DOI, URL):
            if len(here) > 3:
                raise ValueError(f"{here[2]} has child elements")
            if here in values:
                raise ValueError(f"duplicate {here[2]}")
            values[here] = ""
        notes += here == NOTE

    def data(part):
        if tuple(path) in values:
            values[tuple(path)] += part

    parser.StartElementHandler, parser.CharacterDataHandler = open_, data
    parser.EndElementHandler = lambda _: path.pop()
    try:
        parser.Parse(text, True)
    except xml.parsers.expat.ExpatError as error:
        raise ValueError(f"not well-formed: {error}") from None
    out = {}
    for name, key in (("doi", DOI), ("url", URL)):
        value = values.get(key, "").strip()
        if len(value.encode()) > MAX_VALUE_BYTES:
            raise ValueError(f"{name} is too long")
        out[name] = value or None
    return out | {"note_count": notes}


def read(data: bytes, limits: Limits = Limits()) -> dict:
    """The package with ``status`` Read, Ignored (with ``defect``) or Absent; defects are not errors."""
    none = {"doi": None, "url": None, "note_count": None, "defect": None}
    box = Container(data, limits)
    if box.header.variant != "C8":
        return none | {"status": "Absent"}
    try:
        found = box.package()
        return none | {"status": "Absent"} if found is None else none | parse(found[2]) | {"status": "Read"}
    except (FormatError, ValueError) as error:
        return none | {"status": "Ignored", "defect": str(error)}


def links(data: bytes, limits: Limits = Limits()) -> Iterator[dict]:
    """``ordinal, page, rect, color, uri, problem`` of the links a C8 package keeps as notes; they are data and never followed.

    ``rect`` is left, top, right, bottom in points from the upper left; a note of another kind
    has its ``problem`` alone. A damaged package has no rows, ``read`` tells why.
    """
    box = Container(data, limits)
    if read(data, limits)["status"] != "Read":
        return
    ordinal = 0
    for notes in ElementTree.fromstring(box.package()[2]).findall("Note-Package/NoteItems"):
        known = all(notes.get(k) == v for k, v in NOTES_PROFILE.items())
        for note in notes:
            if ordinal == MAX_LINKS:
                raise box.v.error("LimitExceeded", "application-info links", None, (MAX_LINKS, ordinal + 1))
            row = {"ordinal": ordinal}
            try:
                row |= _link(note, known, box.header.page_count)
            except ValueError as error:
                row["problem"] = str(error)
            yield row
            ordinal += 1


def _link(note: ElementTree.Element, known: bool, pages: int) -> dict:
    areas, goals = note.findall("RC"), note.findall("Item")
    if not known or note.tag != "Item" or any(note.get(k) != v for k, v in LINK_PROFILE.items()):
        raise ValueError("note is not a link of the known kind")
    if len(areas) != 1 or len(goals) != 1 or len(note) != 2 or any(len(x) for x in note):
        raise ValueError("link does not have one rectangle and one target")
    page, color = note.get("Page", ""), note.get("Color", "")
    if not re.fullmatch("[0-9]{1,9}", page) or not 0 < int(page) <= pages:
        raise ValueError("page is outside the document")
    if not re.fullmatch("00[0-9A-Fa-f]{6}", color):
        raise ValueError("color is not known")
    sides = [areas[0].get(k, "") for k in "ltrb"]
    if not all(re.fullmatch("-?[0-9]{1,7}", x) and abs(int(x)) <= MAX_COORDINATE for x in sides):
        raise ValueError("coordinate is invalid")
    left, top, right, bottom = (int(x) / 100 for x in sides)
    if left >= right or top >= bottom:
        raise ValueError("rectangle is empty or inverted")
    uri = goals[0].get("Aim", "")
    if goals[0].get("Type") != "UrlLink" or not re.fullmatch("https?://[!-~]*", uri):
        raise ValueError("target is not a web address in ASCII")
    return {"page": int(page), "rect": [left, top, right, bottom], "color": f"{color[6:]}{color[4:6]}{color[2:4]}".lower(), "uri": uri}
