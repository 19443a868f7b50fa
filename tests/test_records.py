import struct

import fixtures as fx
import pytest

from quire.formats import paged, pdf, records, writer
from quire.formats.errors import FormatError
from quire.operators import documents


def w(*values):
    return struct.pack(f"<{len(values)}H", *values)


def read(data, page=1):
    box = paged.Container(data)
    return list(records.PageText(box, box.page(page)).records())


def fails(data):
    with pytest.raises(FormatError) as e:
        read(data)
    return str(e.value)


def image(x, y, width, height, marked=False):
    return w(0x800A, 0xD300, x | 0xC000 * marked, y, width | 0xC000 * marked, height) + bytes(16)


def hn_page(text, images=()):
    """An HN-A document of one page."""
    data = bytearray(fx.hn_a([], pages=1))
    at = len(data)
    struct.pack_into("<iih", data, at - 20, at, len(text), len(images))
    out = bytes(data) + text
    for kind, payload in images:
        out += struct.pack("<iii", kind, len(out) + 12, len(payload)) + payload
    return out


def hn_b(text):
    head = bytearray(0xD8)
    head[:8] = b"HN\0\0\xc8\0\0\0"
    struct.pack_into("<iI", head, 0x90, 1, 2)
    struct.pack_into("<I", head, 0x88, 0xC8)
    return bytes(head) + struct.pack("<iih", 0xD8 + 20, len(text), 0) + bytes(10) + text


def test_ordered():
    run = w(0x8001, 7, 0x8070, 1, 0x8071, 1)
    rows = read(hn_page(run + w(3, 0xB0A1) + image(1, 2, 3, 4, True) + w(0x8004, 0) + b"opaque", [(2, b"x")]))
    assert [r["kind"] for r in rows] == ["control"] * 3 + ["glyph", "image", "end"]
    assert (rows[3]["x"], rows[3]["y"], rows[3]["code"]) == (3, 7, 0xB0A1)
    assert [rows[4][k] for k in ("x", "y", "width", "height")] == [1, 2, 3, 4]
    assert "unexpected tag" in fails(hn_page(w(0x8001, 7, 0x8071, 1)))
    assert "unexpected tag" in fails(hn_page(run + w(0x8004, 0), [(2, b"x")]))
    assert "missing complete end" in fails(hn_page(run))


def test_tagged():
    rows = read(hn_page(w(0x8003, 100, 0x8003, 200, 0x801C, 1, 0x80CE, 0, 5, 6, 0x8004, 0)))
    assert [r["kind"] for r in rows] == ["control"] * 4 + ["glyph", "end"]
    assert "unexpected tag" in fails(hn_page(w(0x8003, 1, 0x8003, 2, 0x801C, 1, 0x8003, 3, 0x8004, 0)))
    assert "more image records" in fails(hn_page(image(0, 0, 1, 1) + w(0x8004, 0)))
    raw = fx.c8([w(0x800A, 0, 1, 2, 3, 4) + bytes(16) + w(0x8004, 0)], [(1, b"x")])
    assert [r["kind"] for r in read(raw)] == ["image", "end"]
    assert "unexpected tag" in fails(fx.c8([fx.compressed(w(0x9999, 0))]))


def test_fixed():
    glyph = w(0x8070, 10, 0x8071, 11, 0x8001, 12, 13, 14)
    rows = read(fx.c8([fx.compressed(bytes(8) + glyph + image(5, 6, 7, 8) + w(0x8004, 0), True)], [(1, b"x")]))
    assert [(r["kind"], r["x"], r["y"]) for r in rows] == [("glyph", 13, 12), ("image", 5, 6)]
    assert "multiple of 16" in fails(fx.c8([fx.compressed(bytes(21), True)]))
    assert "markers" in fails(fx.c8([fx.compressed(bytes(28), True)]))


def test_image_regions():
    def text(last=0):
        place = w(0x800A, 0, 0, 0, 1, 2) + bytes(16)
        region = b"\x0a\x80\0\0" + w(9, 9, 9, 9) + bytes([0]) + bytes(15)
        return fx.compressed(bytes(8) + place + region + w(0x8004, last), True)

    data = hn_page(text(), [(2, fx.jpeg())])
    assert [(r["kind"], r["width"], r["height"]) for r in read(data)] == [("image", 1, 2)]
    assert "invalid prefix" in fails(hn_page(text(1), [(2, fx.jpeg())])) and "one JPEG" in fails(hn_page(text(), [(1, fx.jpeg())]))
    assert pdf.Pdf(writer.compose(data)["pdf"]).pages[0]["media_box"] == [0, 0, 0.097035, 0.19407]


def test_native():
    body = w(0x8001, 5, 0x8002, 9, 3, 0xB0A1, 0x80CC, 0x0104, 0xE041, 0xE042, 0x8010, 1, 1, 2, 3, 4, 0x81FF, 1, 7, 8)
    link = w(0x810A, 0xD300, 1, 2, 3, 4, 0, 4) + b"a.jp" + bytes(4)
    rows = read(fx.c8([body + w(0x800A, 0xD300, 0xC001, 2, 0xC003, 4) + bytes(16) + link + w(0x8004, 0)], [(2, b"x"), (2, b"y")]))
    assert [r["kind"] for r in rows] == ["control", "control", "glyph", "string", "drawing", "extended", "image", "reference", "end"]
    assert (rows[2]["character"], rows[2]["y"], rows[2]["style"], rows[3]["text"], rows[4]["words"]) == ("啊", 5, 9, "AB", [1, 2, 3, 4])
    assert (rows[6]["x"], rows[6]["width"], rows[7]["name"]) == (1, 3, b"a.jp")
    for text, reason in (
        (w(0x8001, 5, 3, 4), "missing run position or style"), (w(0x8001, 5), "missing end record"), (w(0x8004, 0, 0, 0), "trailing bytes"),
        (w(0x80CC, 0x0103, 0xE019), "encoded-string word"), (w(0x8010, 3), "tag/value"), (w(0x8010, 1, 2), "native record"),
    ):
        assert reason in fails(fx.c8([text]))
    assert [r["style"] for r in read(fx.c8([w(0x8001, 5, 0x8070, 22, 0x8071, 22, 3, 4, 0x8004, 0)])) if r["kind"] == "glyph"] == [0]
    assert [r["kind"] for r in read(hn_b(w(0x8001, 5, 0x8002, 1, 3, 4) + w(0x8004)))] == ["control", "control", "glyph", "end"]
    assert "tag/value" in fails(hn_b(w(0x8067, 0, 0x8004, 0)))


def test_characters():
    char = records.native_character
    assert [char(2, c) for c in (0xB0A1, 0xA0C1, 0xA0B0, 0xAAB1, 0xA0A1, 0xAAA1, 0xFFFF)] == ["啊", "A", "0", "∙", None, None, None]
    assert [char(0, c) for c in (0xB0A1, 0xA980, 0xA9B3, 0xA3B9, 0xA1A1, 0xA1A3, 0xAAB3)] == ["啊", "A", "z", "9", " ", "。", None]
    assert char(1, 0xB0A1) is None and char(None, 0xB0A1) is None


def test_repeated_groups():
    photo = fx.jpeg()
    out = writer.compose(fx.c8([fx.image_text((0, 0, 10, 10))], [(2, photo), (2, photo)]))
    assert out["duplicate_images"] == 1 and out["pdf"].count(b"/DCTDecode") == 1
    for images, reason in (([(2, photo), (2, fx.jpeg(8))], "payload differs"), ([(2, photo)] * 3, "complete coordinate group")):
        with pytest.raises(FormatError, match=reason):
            writer.compose(fx.c8([fx.image_text((0, 0, 10, 10), (1, 1, 1, 1)) if len(images) == 3 else fx.image_text((0, 0, 10, 10))], images))


def test_tables(spark):
    data = fx.c8([w(0x8001, 5, 0x8002, 9, 3, 0xB0A1, 0x8004, 0), w(0x8001, 5), b""])
    files = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    rows = documents.text_records(files).orderBy("page", "ordinal").collect()
    assert [(r.page, r.kind, r.character) for r in rows] == [(1, "control", None), (1, "control", None), (1, "glyph", "啊"), (1, "end", None), (2, "control", None), (2, None, None)]
    assert "missing end record" in rows[-1].page_error
    assert documents.needs_fonts(documents.hnc8_pages(files)).first().native
