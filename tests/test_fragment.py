import fixtures as fx
import pytest

from quire.formats import fragment, pdf
from quire.formats.errors import FormatError
from quire.operators import documents


def page(parent, more=""):
    return f"<< /Type /Page /Parent {parent} 0 R {more}>>"


def stream(body, length=None):
    return b"<< /Length " + str(len(body) if length is None else length).encode() + b" >>\nstream\n" + body + b"\nendstream"


def fails(data, **options):
    with pytest.raises(FormatError) as e:
        fragment.rebuild(data, **options)
    return str(e.value)


def numbers(out):
    return [p["number"] for p in pdf.Pdf(out["pdf"]).pages]


def test_one_absent_parent():
    data = fx.caj_body([5, 3], [(3, page(2)), (5, page(2, "/Contents 7 0 R")), (7, stream(b"q Q"))], [("一", b"2", 1), ("二", b"1", 2)])
    out = fragment.rebuild(data)
    whole = pdf.Pdf(out["pdf"])
    assert numbers(out) == [5, 3] and out["bookmark_count"] == 2 and whole.has_outline
    assert whole.pages[0]["media_box"] == [0, 0, 612, 792]
    assert whole._object_at(whole.rows[7][1])[1] == b"q Q"
    assert not pdf.Pdf(fragment.rebuild(data, include_bookmarks=False)["pdf"]).has_outline


def test_several_absent_parents():
    data = fx.caj_body([3, 5, 4], [(3, page(20)), (5, page(10)), (4, page(10))])
    out = fragment.rebuild(data)
    whole = pdf.Pdf(out["pdf"])
    assert numbers(out) == [3, 5, 4] and whole.catalog["Pages"].number == 21
    # Pages of one absent parent that do not stand together cannot keep the table's order.
    assert "in order" in fails(fx.caj_body([5, 3, 4], [(3, page(20)), (5, page(10)), (4, page(10))]))


def test_present_root():
    tree = [(1, "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 10 20] >>"), (3, page(1)), (4, page(1))]
    assert numbers(fragment.rebuild(fx.caj_body([3, 4], tree))) == [3, 4]
    assert "in order" in fails(fx.caj_body([4, 3], tree))
    assert "mixed page-tree roots" in fails(fx.caj_body([3, 5], [*tree, (5, page(9))]))
    other = [(11, "<< /Type /Pages /Kids [5 0 R] /Count 1 >>"), (5, page(11))]
    assert "multiple existing roots" in fails(fx.caj_body([3, 5], [*tree, *other]))
    assert "parent cycle" in fails(fx.caj_body([3], [(3, page(4)), (4, "<< /Type /Pages /Parent 5 0 R >>"), (5, "<< /Type /Pages /Parent 4 0 R >>")]))
    assert "missing or is not a Page" in fails(fx.caj_body([9], [(3, page(2))]))
    assert "not a Pages object" in fails(fx.caj_body([3], [(3, page(2)), (2, "<< /Type /Font >>")]))


def test_framing():
    indirect = [(3, page(2, "/Contents 7 0 R")), (7, b"<< /Length 8 0 R >>\nstream\nendobj 1\nendstream"), (8, "8")]
    whole = pdf.Pdf(fragment.rebuild(fx.caj_body([3], indirect))["pdf"])
    assert whole._object_at(whole.rows[7][1])[1] == b"endobj 1"
    assert "stream length is invalid" in fails(fx.caj_body([3], [*indirect[:2], (8, "9999")]))
    mended = fragment.rebuild(fx.caj_body([3], [(3, page(2)), (7, stream(b"abc", 2))]))
    assert mended["repaired_objects"] == 1 and pdf.Pdf(mended["pdf"])._object_at(pdf.Pdf(mended["pdf"]).rows[7][1])[1] == b"abc"
    assert "changes the width" in fails(fx.caj_body([3], [(3, page(2)), (7, stream(b"abcdefghijkl", 2))]))
    assert "object header is missing" in fails(fx.caj_body([3], [(3, page(2) + "\nendobj\njunk")]))
    assert numbers(fragment.rebuild(fx.caj_body([3], [(3, page(2)), (3, page(2))]))) == [3]
    assert "repeated" in fails(fx.caj_body([3], [(3, page(2)), (3, page(4))]))


def test_absent_targets():
    link = "<< /Type /Annot /Subtype /Link /Dest [99 0 R /Fit] /Rect [0 0 1 1] >>"
    out = fragment.rebuild(fx.caj_body([3], [(3, page(2, "/Annots [6 0 R]")), (6, link)]))
    assert out["repaired_links"] == 1 and b"99 0 R" not in out["pdf"] and b"/Rect [0 0 1 1]" in out["pdf"]
    assert "targets a missing object" in fails(fx.caj_body([3], [(3, page(2, "/Contents 99 0 R"))]))
    assert "targets a missing object" in fails(fx.caj_body([3], [(3, page(2)), (6, "<< /Subtype /Link /Dest [99 0 R /Fit] /P 99 0 R >>")]))


def test_damaged_pages():
    parts = [(3, page(2, "/Contents 7 0 R")), (7, b"<< /Length 2 >>\nstream\nabc"), (4, page(2, "/Contents 8 0 R")), (8, stream(b"q Q")), (5, "<< /Type /Page /Parent 2 0 R")]
    data = fx.caj_body([3, 4, 5], [*parts, (6, "null")])
    assert "stream length is invalid" in fails(data)
    out = fragment.rebuild(data, allow_damaged=True)
    assert numbers(out) == [3, 4, 5] and [o["page_index"] for o in out["omitted_pages"]] == [0, 2]
    whole = pdf.Pdf(out["pdf"])
    assert "Contents" in whole.resolve(pdf.Ref(4, 0)) and "Contents" not in whole.resolve(pdf.Ref(3, 0))
    shared = [(1, "<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources 7 0 R >>"), (3, page(1)), (7, b"<< /Length 2 >>\nstream\nabc")]
    assert "damage reaches the page tree" in fails(fx.caj_body([3], shared), allow_damaged=True)


def test_caj_tables(spark):
    good = fx.caj_body([3], [(3, page(2, "/Contents 7 0 R")), (7, stream(b"q Q"))], [("一", b"1", 1)])
    bad = fx.caj_body([3], [(3, page(2, "/Contents 7 0 R")), (7, b"<< /Length 2 >>\nstream\nabc")])
    files = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(bad))], "path string, content binary")
    a, b = documents.to_pdf(files).orderBy("path").collect()
    assert (a.page_count, a.bookmark_count, a.omitted_pages, a.error) == (1, 1, [], None) and pdf.Pdf(bytes(a.pdf)).has_outline
    assert b.pdf is None and b.error.kind == "Malformed"
    b = documents.to_pdf(files, allow_damaged=True).filter("path = 'b'").first()
    assert [o.page_index for o in b.omitted_pages] == [0]
    objects = documents.caj_objects(files)
    assert {(r.number, r.kind) for r in objects.filter("path = 'a'").collect()} == {(3, "Page"), (7, "stream")}
    links = documents.caj_references(files)
    assert {(r.owner, r.target) for r in links.filter("path = 'a'").collect()} == {(3, 2), (3, 7)}
    assert [(r.owner, r.target) for r in documents.dangling_references(objects, links).collect()] == [(3, 2)]
