import json

import fixtures as fx
import pytest

from quire.__main__ import main
from quire.formats import inspection, pdf
from quire.formats.errors import FormatError, error_code
from quire.operators import documents
from quire.sinks import reports

OUTLINE = [("Introduction", b"1", 1), ("Background", b"2", 2), ("Methods", b"2", 1)]


def test_json_and_text(spark):
    found = inspection.read(fx.caj(OUTLINE), "CAJ")
    assert inspection.as_json(found, bookmarks=True) == (
        '{"schema_version":1,"format":"CAJ","variant":null,"conversion_supported":true,"page_count":2,"has_outline":true,"bookmark_count":3,"bookmarks":[{"title":"Introduction","page":1,'
        '"children":[{"title":"Background","page":2,"children":[]}]},{"title":"Methods","page":2,"children":[]}],"outline_warnings":0}'
    )
    assert inspection.as_text(found, bookmarks=True) == "Format: CAJ\nConversion: supported\nPages: 2\nOutline: yes\nBookmarks: 3\n  - Introduction (page 1)\n    - Background (page 2)\n  - Methods (page 2)\n"
    assert json.loads(inspection.as_json(inspection.read(b"TEB", "TEB")))["unsupported_reason"] == "not-implemented"
    assert "\\u0008\\u000c\\n" in inspection.as_json(found | {"bookmarks": [(0, "\b\f\n", 0)]}, bookmarks=True)
    assert "not available for PDF" in inspection.as_text(inspection.read(fx.pdf(), "PDF", pages=True), bookmarks=True, pages=True)
    rows = reports.inspections(spark.createDataFrame([("a", bytearray(fx.caj(OUTLINE))), ("b", bytearray(b"?"))], "path string, content binary")).orderBy("path").collect()
    assert rows[0].text.startswith("Format: CAJ") and rows[1].error.code == 1 and rows[1].json is None


def test_package_and_structure():
    xml = "<Package><FileProperty-Package><DOI>10.1/x</DOI></FileProperty-Package><Note-Package><NoteItems><Item/></NoteItems></Note-Package></Package>".encode()
    data = fx.c8([fx.image_text((0, 0, 5, 5)), b"\x01\x80\0\0", b""], [(2, b"jpg")], package=xml)
    found = inspection.read(data, "C8", pages=True)
    assert found["application_info"] == {"doi": "10.1/x", "url": None, "note_count": 1}
    assert [p["text_framing"] for p in found["pages"]] == ["compresstext", None, "none"] and "missing end record" in found["pages"][1]["text_error"]
    lines = inspection.as_text(found, pages=True).splitlines()
    assert "DOI: 10.1/x" in lines and "Notes: 1" in lines and "Page index: 80+60 (20-byte rows)" in lines
    assert any(line.startswith("Page 1: text 140+") and line.endswith("framing compresstext (3 records, 36 decoded bytes)") for line in lines)
    assert any(line.startswith("Page 2:") and "text error: malformed HN/C8 C8" in line for line in lines)
    two = fx.c8([fx.image_text((0, 0, 5, 5), (1, 1, 1, 1))], [(2, b"a"), (2, b"b"), (2, b"c")])
    assert "complete coordinate group" in inspection.read(two, "C8", pages=True)["pages"][0]["text_error"]
    other = b"KDH 9" + bytes(300)
    found = inspection.read(other, "KDH", pages=True)
    assert found["page_count"] is None and 'KDH signature: "KDH 9\\x00' in inspection.as_text(found, pages=True)
    with pytest.raises(FormatError):
        inspection.read(other, "KDH")


def test_codes():
    code = lambda kind, name: error_code(FormatError(kind, structure=name))
    assert [code("Malformed", n) for n in ("", "PDF", "CAJ", "KDH", "HN/C8 C8", "JBIG2")] == [2, 8, 13, 15, 16, 16]
    assert [code("LimitExceeded", n) for n in ("", "PDF", "CAJ", "KDH")] == [4, 12, 14, 4]
    assert [code(k, "PDF") for k in ("Truncated", "Encrypted", "UnsupportedFormat")] == [3, 9, 10] and code("UnsupportedFormat", "") == 1


def test_command_line(spark, tmp_path, capsys):
    page = "<< /Type /Page /Parent 2 0 R >>"
    good = fx.caj_body([3], [(3, page)], [("一", b"1", 1)])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.caj").write_bytes(good)
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(fx.pdf(1))
    assert main(["convert", str(tmp_path / "in"), "--out", f"file://{tmp_path}/out"], spark) == 0
    made = list((tmp_path / "out").glob("*.pdf"))
    assert len(made) == 1 and pdf.Pdf(made[0].read_bytes()).has_outline
    (tmp_path / "in" / "b.txt").write_bytes(b"plain")
    (tmp_path / "in" / "c.caj").write_bytes(b"CAJ\0")
    assert main(["convert", str(tmp_path / "in"), "--out", f"file://{tmp_path}/out"], spark) == 1
    told = capsys.readouterr().err
    assert "b.txt: unsupported input format" in told and "c.caj: truncated CAJ" in told
    assert main(["inspect", str(tmp_path / "in" / "a.caj"), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["bookmark_count"] == 1
    pair = [str(tmp_path / "pdf"), str(tmp_path / "in" / "a.caj"), "--out", f"file://{tmp_path}/marked"]
    assert main(["add-bookmarks", *pair], spark) == 0
    marked = next((tmp_path / "marked").glob("*.pdf"))
    assert pdf.Pdf(marked.read_bytes()).has_outline
    (tmp_path / "pdf" / "a.pdf").write_bytes(marked.read_bytes())
    assert main(["add-bookmarks", *pair], spark) == 1 and "already has an outline" in capsys.readouterr().err
    assert documents.hnc8_pages(spark.createDataFrame([("x", bytearray(fx.c8([b""])))], "path string, content binary")).first().text_records == 0


def test_links(spark):
    def note(more="", **change):
        a = {"Type": "Link", "Page": "1", "Color": "000000FF", "LineStyle": "4", "ShowType": "1"} | change
        return f"<Item {' '.join(f'{k}=\"{v}\"' for k, v in a.items())}><RC l='100' t='-50' r='250' b='300'/><Item Type='UrlLink' Aim='https://example.org/a' ID='1'/>{more}</Item>"

    notes = [note(), note(Page="9"), note(Type="Text"), note("<RC l='1' t='1' r='2' b='2'/>"), note(Color="FF000000")]
    package = f"<Package><Note-Package><NoteItems Version='1.0' Unit='PointsM'>{''.join(notes)}</NoteItems></Note-Package></Package>".encode()
    files = spark.createDataFrame([("a", bytearray(fx.c8([b""], package=package))), ("b", bytearray(fx.c8([b""], package=b"<Package>")))], "path string, content binary")
    rows = documents.package_links(files).orderBy("ordinal").collect()
    assert (rows[0].page, rows[0].rect, rows[0].color, rows[0].uri, rows[0].problem) == (1, [1.0, -0.5, 2.5, 3.0], "ff0000", "https://example.org/a", None)
    assert [r.problem for r in rows[1:]] == ["page is outside the document", "note is not a link of the known kind", "link does not have one rectangle and one target", "color is not known"]
