import hashlib

import pytest

from quire.formats import build, opentype
from quire.formats.errors import FormatError
from quire.operators import fonts

PLAIN = build.font([500, 600, 700, 800], [(65, 66, 1), (0x4E00, 0x4E00, 3)])


@pytest.mark.parametrize("kind", [4, 12])
def test_glyphs(kind):
    face = opentype.Face(build.font([500, 600, 700, 800], [(65, 66, 1), (0x4E00, 0x4E00, 3)], kind=kind))
    assert list(face.mappings()) == [(65, 1), (66, 2), (0x4E00, 3)]
    assert [face.glyph(c) for c in "AB一C@"] == [(1, 600), (2, 700), (3, 800), None, None]
    assert face.units_per_em == 1000 and face.glyphs == 4 and face.outlines == "glyf" and face.adjustment == 0xB1B0AFBA


def test_mapping_past_the_glyphs_is_none():
    face = opentype.Face(build.font([500, 600], [(65, 70, 1)], kind=12))
    assert face.glyph("A") == (1, 600) and face.glyph("B") is None and list(face.mappings()) == [(65, 1)]


def test_widths_beyond_the_measured_repeat_the_last():
    raw = build.font([500, 600], [(65, 67, 1)], change={"maxp": b"\0\1\0\0\0\4" + bytes(26)})
    assert [opentype.Face(raw).width(k) for k in range(4)] == [500, 600, 600, 600]


@pytest.mark.parametrize(("bits", "allowed"), [(0, True), (2, False), (4, True), (6, True), (8, True), (0x100, False), (0x204, False), (1, False)])
def test_licence_bits(bits, allowed):
    assert opentype.Face(build.font([500], [(65, 65, 0)], licence=bits)).embeddable is allowed


def test_faults():
    for change, kind in (({"fvar": b"1234"}, "UnsupportedFormat"), ({"cmap": None}, "Malformed"), ({"CFF ": b"1234"}, "Malformed"), ({"glyf": None}, "Malformed")):
        with pytest.raises(FormatError) as e:
            opentype.Face(build.font([500], [(65, 65, 0)], change=change))
        assert e.value.kind == kind
    for wrong in ([(66, 70, 1), (65, 65, 1)], [(65, 66, 1), (66, 67, 2)]):
        with pytest.raises(FormatError):
            list(opentype.Face(build.font([500] * 9, wrong, kind=12)).mappings())
    with pytest.raises(FormatError):
        opentype.faces(b"%PDF-1.4")


def test_any_cut_or_changed_byte_is_located_or_read():
    for k in range(len(PLAIN)):
        for raw in (PLAIN[:k], PLAIN[:k] + bytes([PLAIN[k] ^ 0x81]) + PLAIN[k + 1 :]):
            try:
                for at in opentype.faces(raw):
                    face = opentype.Face(raw, at)
                    list(face.mappings())
                    face.glyph("A"), face.embeddable
            except FormatError:
                pass


def test_tables(spark):
    both = build.collection(PLAIN, build.font([500], [(65, 65, 0)], change={"post": None}))
    files = spark.createDataFrame([("a", bytearray(PLAIN)), ("b", bytearray(both)), ("c", bytearray(b"junk")), ("d", None)], "path string, content binary")
    rows = {(r.path, r.face): r for r in fonts.font_faces(files).collect()}
    assert rows["a", 0].glyphs == rows["b", 0].glyphs == 4 and rows["a", 0].embeddable
    assert rows["b", 1].error.reason == "table is missing: post"
    assert rows["c", None].error.kind == rows["d", None].error.kind == "UnsupportedFormat" and len(rows) == 5
    tables = fonts.font_tables(files).filter("path = 'a'").collect()
    assert [t.tag for t in tables] == sorted(t.tag for t in tables) and len(tables) == 10
    assert all(PLAIN[t.offset : t.offset + t.length] == opentype.Face(PLAIN).table(t.tag) for t in tables)
    text = spark.createDataFrame([("a", 65), ("a", 67), ("x", 65)], "font string, character int")
    found = fonts.glyph_lookup(text, fonts.font_characters(files)).collect()
    assert {(r.font, r.character, r.glyph, r.advance) for r in found} == {("a", 65, 1, 600), ("a", 67, None, None), ("x", 65, None, None)}


def test_verified(spark):
    files = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"two")), ("c", bytearray(b"three")), ("e", bytearray(b"?"))], "path string, content binary")
    sha = lambda x: hashlib.sha256(x).hexdigest().upper()
    pack = spark.createDataFrame([("a", 3, sha(b"one")), ("b", 3, sha(b"owt")), ("c", 4, sha(b"three")), ("d", 1, sha(b"d"))], "path string, size long, sha256 string")
    assert {tuple(r) for r in fonts.verified(files, pack).collect()} == {("a", "ok"), ("b", "digest"), ("c", "size"), ("d", "absent"), ("e", "unknown")}
