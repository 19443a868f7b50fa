"""PDF files of image pages, and containers whose pages are images."""

from __future__ import annotations

import zlib
from dataclasses import replace

from quire.formats import jpeg, package, pixels
from quire.formats.errors import FormatError, Limits
from quire.formats.paged import Container
from quire.formats.pdf import append_outline
from quire.formats.records import PageText
from quire.formats.text import utf16_hex

#: Keys of the application info in a file's information dictionary; images that a page may place.
INFO_KEYS, MAX_PAGE_IMAGES = {"doi": "CNKI_DOI", "url": "CNKI_URL"}, 8192
#: Points of one container unit, and of a pixel at 300 an inch.
UNIT, PIXEL = 72 / 742, 72 / 300


class Writer:
    """Objects in order of their numbers, then the table of their places."""

    def __init__(self):
        self.body, self.places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []

    def add(self, head: str, stream: bytes | None = None) -> int:
        self.places.append(len(self.body))
        number = len(self.places)
        self.body += f"{number} 0 obj\n".encode()
        if stream is None:
            self.body += head.encode() + b"\nendobj\n"
        else:
            self.body += f"<< {head} /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream\nendobj\n"
        return number

    def finish(self, root: int, info: dict[str, str] | None = None) -> bytes:
        """The file; ``info`` becomes its information dictionary."""
        shown = f" /Info {self.add('<< ' + ' '.join(f'/{k} <{utf16_hex(v)}>' for k, v in info.items()) + ' >>')} 0 R" if info else ""
        table = len(self.body)
        rows = "".join(f"{p:010d} 00000 n \n" for p in self.places)
        self.body += f"xref\n0 {len(self.places) + 1}\n0000000000 65535 f \n{rows}trailer\n<< /Size {len(self.places) + 1} /Root {root} 0 R{shown} >>\nstartxref\n{table}\n%%EOF\n".encode()
        return bytes(self.body)


def number(x: float) -> str:
    """A PDF number without exponent or needless zeros."""
    return f"{x:.6f}".rstrip("0").rstrip(".") if x else "0"


def jpeg_object(data: bytes) -> tuple[str, bytes]:
    """Dictionary and stream of a JPEG image, its bytes as they are."""
    info = jpeg.read(data)
    space = "DeviceGray" if info["color"] == "gray" else "DeviceRGB"
    return f"/Type /XObject /Subtype /Image /Width {info['width']} /Height {info['height']} /ColorSpace /{space} /BitsPerComponent 8 /Filter /DCTDecode", data


def bilevel_object(kind: int, data: bytes, limits: Limits) -> tuple[str, bytes]:
    """Dictionary and stream of a type-0 or type-3 image, decoded; one is black."""
    rows = pixels.read(kind, data, limits)
    head = f"/Type /XObject /Subtype /Image /Width {rows.shape[1]} /Height {rows.shape[0]} /ColorSpace /DeviceGray /BitsPerComponent 1 /Decode [1 0] /Filter /FlateDecode"
    return head, zlib.compress(pixels.packed(rows))


def image_pdf(pages: list[tuple[float, float, list[tuple[tuple[str, bytes], list[float]]]]], info: dict[str, str] | None = None) -> bytes:
    """A file of pages (width, height, images), an image being its object (dictionary, stream) and the matrix that places it."""
    out = Writer()
    first = 3
    tree, kids = 2, []
    out.add("<< /Type /Catalog /Pages 2 0 R >>")
    sizes = [1 + 1 + len(images) for _, _, images in pages]
    for n in sizes:
        kids.append(first)
        first += n
    out.add(f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>")
    for (width, height, images), own in zip(pages, kids, strict=True):
        names = " ".join(f"/I{k} {own + 2 + k} 0 R" for k in range(len(images)))
        out.add(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {number(width)} {number(height)}] /Contents {own + 1} 0 R /Resources << /XObject << {names} >> >> >>")
        draw = "\n".join(f"q {' '.join(map(number, matrix))} cm /I{k} Do Q" for k, (_, matrix) in enumerate(images))
        out.add("", draw.encode())
        for (head, stream), _ in images:
            out.add(head, stream)
    return out.finish(1, info)


def _placed(box: Container, page: dict) -> tuple[list[tuple[int, int, int, int]], tuple[int, int]]:
    """(x, y, width, height) of each image record in container units, and the size of the page."""
    text = PageText(box, page)
    if text.grammar in ("none", "native"):
        raise box.v.error("UnsupportedFormat", f"image coordinates of {text.grammar} text", page["text_offset"], page=page["page_number"])
    places = [tuple(r[k] for k in ("x", "y", "width", "height")) for r in text.records() if r["kind"] == "image"]
    if not places or page["image_count"] % len(places):
        raise box.v.error("UnsupportedFormat", "image descriptor count is not a complete coordinate group", page["text_offset"], page=page["page_number"])
    return places, text.size or box.header.page_size


def _distinct(box: Container, page: dict, group: int) -> tuple[list[dict], int]:
    """The images of the first coordinate group, and how many later ones repeat them byte for byte."""
    found = list(box.images(page))
    body = lambda i: box.v.data[i["payload_offset"] : i["payload_offset"] + i["payload_length"]]
    for k in range(group, len(found)):
        first = found[k % group]
        if first["record_type"] != found[k]["record_type"] or body(first) != body(found[k]):
            raise box.v.error("UnsupportedFormat", "repeated image payload differs", found[k]["payload_offset"], page=page["page_number"], image=found[k]["image_number"])
    return found[:group], len(found) - group


def _page(box: Container, page: dict, limits: Limits) -> tuple[float, float, list, int]:
    """Width, height and images of a page in points, and the number of repeated image records.

    HN-B places one JPEG of type 2 on a page of its own size at 300 pixels an inch.
    """
    variant, number_ = box.header.variant, page["page_number"]
    size, places, repeats, found = box.header.page_size, [], 0, []
    if page["image_count"] > MAX_PAGE_IMAGES:
        raise box.v.error("LimitExceeded", "page image placements", page["row_offset"], (MAX_PAGE_IMAGES, page["image_count"]), page=number_)
    if page["image_count"]:
        if variant == "HN-B":
            found = list(box.images(page))
            if len(found) != 1 or found[0]["record_type"] != 2:
                raise box.v.error("UnsupportedFormat", "HN-B image-bearing rows require exactly one JPEG", page["row_offset"], page=number_)
        else:
            places, size = _placed(box, page)
            found, repeats = _distinct(box, page, len(places))
    width, height = (x * UNIT for x in size)
    images = []
    for k, image in enumerate(found):
        start, kind = image["payload_offset"], image["record_type"]
        payload = box.v.data[start : start + image["payload_length"]]
        try:
            shown = jpeg_object(payload) if kind in (1, 2) else bilevel_object(kind, payload, limits)
            if variant == "HN-B":
                info = jpeg.read(payload)
                width, height = info["width"] * PIXEL, info["height"] * PIXEL
                images.append((shown, [width, 0, 0, -height, 0, height]))
                continue
        except FormatError as error:
            raise replace(error, place=(("page", number_), ("image", image["image_number"]), *error.place)) from None
        x, y, w, h = (c * UNIT for c in places[k])
        if not w or not h:
            raise box.v.malformed("image placement has no extent", page["text_offset"], page=number_, image=image["image_number"])
        images.append((shown, [w, 0, 0, -h, x, height - y] if kind == 2 else [w, 0, 0, h, x, height - y - h]))
    if not width or not height:
        raise box.v.malformed("declared source dimensions must be positive", None, page=number_)
    return width, height, images, repeats


def compose(data: bytes, limits: Limits = Limits(), *, include_bookmarks: bool = True) -> dict:
    """``pdf, page_count, bookmark_count, duplicate_images, no_image_pages`` of a container of image pages.

    No page is dropped; a page without images is blank.
    """
    box = Container(data, limits)
    rows = [_page(box, box.page(k), limits) for k in range(1, box.header.page_count + 1)]
    known = package.read(data, limits)
    out, entries = image_pdf([r[:3] for r in rows], {key: known[k] for k, key in INFO_KEYS.items() if known[k]}), []
    if include_bookmarks and box.header.outline_count:
        entries = [(r["depth"], r["title"], r["page_index"]) for r in box.outline() if r["kind"] == "bookmark" and r["title"]]
        out = append_outline(out, entries, limits)
    if len(out) > limits.max_output_bytes:
        raise box.v.error("LimitExceeded", "output bytes", None, (limits.max_output_bytes, len(out)))
    return {"pdf": out, "page_count": len(rows), "bookmark_count": len(entries), "duplicate_images": sum(r[3] for r in rows), "no_image_pages": sum(not r[2] for r in rows)}
