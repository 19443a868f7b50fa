import struct

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from quire.formats import bilevel, caj, jpeg, kdh, package, paged, pdf, text, writer
from quire.formats.errors import FormatError, Limits
from quire.functions import binary
from quire.operators import documents
from quire.sinks import reports
from quire.sources import documents as source
from quire.streaming.ingest import ingest

SIGNATURES = [
    (b"%PDF-1.7", "PDF"), (b"CAJ\0", "CAJ"), (b"KDH 2.00", "KDH"), (b"HN\0\0", "HN"), (b"\xc8\0\0\0\1", "C8"), (b"TEB", "TEB"), (b" %PDF-", "PDF"), (b"\xef\xbb\xbf%PDF-1.4", "PDF"),
    (b"%PDF", None), (b"\xc8\0\0", None), (b"NH\0\0", None), (b" CAJ", None), (b"\nKDH 2.00", None), (b" TEB", None), (b"caj", None), (b"", None),
    (b" " * 1019 + b"%PDF-", "PDF"), (b" " * 1020 + b"%PDF-", None),
    (b"[TARGET]\r\nA1=1\nA2=a+/=\nB1=0\nB2=\nC1=0\nC2=\nD1=22\nD2=bb\nDOCTYPE=NH\n \t\n", "CAA"), (b"[TARGET]\nA1=1\nA2=a\nB1=0\nB2=\nC1=0\nC2=\nD1=2\nD2=b\nDOCTYPE=NH", None),
]


def files(spark, *contents):
    return spark.createDataFrame([(f"f{k:02d}", bytearray(c)) for k, c in enumerate(contents)], "path string, content binary")


def fails(call, *args):
    with pytest.raises(FormatError) as e:
        call(*args)
    return str(e.value)


def test_signatures(spark):
    got = documents.detections(files(spark, *(c for c, _ in SIGNATURES))).orderBy("path").collect()
    assert [r.format for r in got] == [f for _, f in SIGNATURES]
    assert got[6].header_offset == 1 and got[16].header_offset == 1019 and got[8].header_offset is None
    assert (got[0].bytes_read, got[6].bytes_read, got[17].bytes_read) == (5, 6, 1024)


def test_caj():
    found = caj.read(fx.caj([("一", b" 2 ", 1), ("二", b"1", 2), ("三", b"1", 1)]))
    assert found["bookmarks"] == [(0, "一", 1), (1, "二", 0), (0, "三", 0)]
    assert [p[2] for p in found["pages"]] == [5, 9]
    assert fails(caj.read, b"CAJ") == "truncated CAJ at byte 0: expected 4 bytes, available 3"
    assert fails(caj.read, b"NOPE") == "unsupported input format"
    assert fails(caj.read, fx.caj(pages=0)) == "malformed CAJ at byte 16: CAJ page count must be positive"
    assert fails(caj.read, fx.caj([("a", b"1", 1), ("b", b"1", 3)])) == "malformed CAJ at byte 888, record 2: CAJ TOC level skips a parent"
    assert "record 2: CAJ page spans are not contiguous" in fails(caj.read, fx.caj(rows=((0, 40, 5), (41, 9, 6))))
    assert "record 2: duplicate CAJ page object number" in fails(caj.read, fx.caj(rows=((0, 40, 5), (40, 9, 5))))
    assert "record 1: CAJ page object number must be positive" in fails(caj.read, fx.caj(rows=((0, 40, 0), (41, 9, 6))))
    assert "record 1: CAJ TOC title is not valid GB18030" in fails(caj.read, fx.caj([(b"\x81\x30\x81", b"1", 1)]))
    for page, reason in ((b"", "empty TOC page number"), (b"+1", "not ASCII decimal"), (b"3", "outside the document"), (b"99999999999", "overflows")):
        assert reason in fails(caj.read, fx.caj([("a", page, 1)]))
    assert fails(caj.read, fx.caj(), Limits(max_pages=1)) == "CAJ CAJ pages limit exceeded at byte 16: maximum 1, attempted 2"


def test_hn_outline():
    entries = [("a", b"1", 1), ("skip", b"9", 1), ("b", b"2", 5), ("c", b"1", 0), ("d", b"1", 3), (b"\xff", b"1", 1)]
    rows = list(paged.Container(fx.hn_a(entries)).outline(max_depth=3))
    assert [(r["title"], r["depth"], r["page_index"]) for r in rows if r["kind"] == "bookmark"] == [("a", 0, 0), ("b", 1, 1), ("d", 2, 0)]
    assert [(r["ordinal"], r["reason"], r["repair"]) for r in rows if r["kind"] == "defect"] == [
        (1, "destination is outside source pages", "skipped"), (2, "level exceeds the configured depth", "clamped"), (3, "level is zero", "skipped"), (5, "title is not valid GB18030", "skipped"),
    ]


def test_c8_pages():
    data = fx.c8([fx.compressed(b"hello"), fx.compressed(b"x" * 99, True), b"\x01\x80\0\0", b""], [(2, b"jpg"), (0, b"bits")])
    rows = list(paged.probe(data))
    assert [r["framing"] for r in rows] == ["compresstext", "legacy-24", "native", "none"]
    assert [r["decoded_length"] for r in rows] == [5, 99, None, None]
    assert [(i["record_type"], i["payload_length"]) for i in rows[0]["images"]] == [(2, 3), (0, 4)]
    broken = bytearray(data)
    struct.pack_into("<i", broken, 0x50 + 20, -1)
    rows = list(paged.probe(bytes(broken)))
    assert rows[1]["error"] == "malformed HN/C8 C8 at byte 100, page 2: text offset: negative signed value" and "error" not in rows[2]
    assert "page 1, image 1: image type" in next(paged.probe(fx.c8([b""], [(4, b"x")])))["error"]
    assert fails(paged.Container, b"HN\0\0\1\0\0\0").startswith("unsupported HN/C8 at byte 4: HN marker")
    bad = bytearray(fx.c8([fx.compressed(b"hello")]))
    bad[-1] ^= 1
    assert "zlib stream" in next(paged.probe(bytes(bad)))["text_error"]


def test_package():
    xml = "<?xml version='1.0' encoding='UTF-8'?><Package><FileProperty-Package><DOI> 10.1/x </DOI><DURL></DURL></FileProperty-Package><Note-Package><NoteItems><Item/><Item/></NoteItems></Note-Package></Package>"
    assert package.read(fx.c8([b""], package=xml.encode())) == {"doi": "10.1/x", "url": None, "note_count": 2, "defect": None, "status": "Read"}
    assert package.read(fx.c8([b""]))["status"] == "Absent"
    for bad in ("<Other/>", "<Package><FileProperty-Package><DOI>1</DOI><DOI>2</DOI></FileProperty-Package></Package>", "<!DOCTYPE x><Package/>", "<Package>"):
        assert package.read(fx.c8([b""], package=bad.encode()))["status"] == "Ignored"
    assert package.read(fx.c8([b""], package=xml.encode())[:-1] + b"9")["status"] == "Ignored"


def test_kdh_and_pdf():
    body = fx.pdf(3)
    assert kdh.decode(fx.kdh(body + b"junk")) == (body, 4)
    assert "KDH version field is invalid" in fails(kdh.decode, fx.kdh(body, b"\2\0\0\0"))
    assert "ambiguous PDF end" in fails(kdh.decode, fx.kdh(body + body.replace(b"startxref\n", b"startxref\n")[:0] + pdf.append_outline(body, [(0, "t", 0)])[len(body) :]))
    index = pdf.Pdf(body)
    assert len(index.pages) == 3 and not index.has_outline and index.pages[0]["media_box"] == [0, 0, 612, 792]
    out = pdf.append_outline(body, [(0, "题", 0), (1, "b", 2), (0, "c", 1)])
    assert out.startswith(body[:-1]) and pdf.Pdf(out).has_outline and len(pdf.Pdf(out).pages) == 3
    assert pdf.append_outline(out, [(0, "x", 0)]) == out[:-1] and pdf.append_outline(body, []) == body[:-1]
    assert "count differs" in fails(pdf.Pdf, body.replace(b"/Count 3", b"/Count 2"))
    assert "startxref and EOF" in fails(pdf.Pdf, body[:-20])
    assert fails(pdf.Pdf, body.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")).startswith("encrypted PDF")
    assert "bookmark" in fails(pdf.append_outline, body, [(1, "deep", 0)])


def test_text_functions(spark):
    assert text.gb18030("中文".encode("gb18030")) == "中文" and text.gb18030(b"ab\xff") == 2
    assert text.utf16_hex("a中") == "FEFF00614E2D" and text.signature_text(b"K\\\0\xff") == "K\\x5c\\x00\\xff" and text.printable("a\nb") == "a\\u{a}b"
    frame = spark.createDataFrame([(bytearray(b"\x01\x02\x80\xff"),)], "c binary")
    row = frame.select(binary.unsigned(F.col("c"), 0, 2).alias("u"), binary.signed(F.col("c"), 2, 2).alias("s"), binary.unsigned(F.col("c"), 2, 4).alias("n"), binary.utf16_hex(F.lit("a中")).alias("t")).first()
    assert tuple(row) == (0x0201, -128, None, "FEFF00614E2D")
    box = binary.page_box(F.lit(742), F.lit(371))
    row = frame.select(box.alias("b"), binary.image_matrix(box, F.lit(0), F.lit(0), F.lit(742), F.lit(371), F.lit(0)).alias("m")).first()
    assert row.b == [0, 0, 72, 36] and row.m[5] == 0.0


def test_tables(spark, tmp_path):
    contents = {"a.caj": fx.caj(), "b.hn": fx.hn_a([("t", b"1", 1), ("u", b"7", 1)]), "c.c8": fx.c8([fx.compressed(b"hi")], [(2, b"j"), (3, b"k")]), "d.kdh": fx.kdh(fx.pdf(1)), "e.pdf": b"\n" + fx.pdf(2), "f.caj": b"CAJ", "g.txt": b"plain", "h.teb": b"TEB1"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    seen = source.read(spark, str(tmp_path))
    info = {r.path[-5:]: r for r in documents.document_info(seen).collect()}
    assert {k: (r.format, r.page_count, r.has_outline, r.bookmark_count) for k, r in info.items()} == {
        "a.caj": ("CAJ", 2, True, 1), "/b.hn": ("HN", 2, True, 1), "/c.c8": ("C8", 1, None, None), "d.kdh": ("KDH", 1, False, None),
        "f.caj": ("CAJ", None, None, None), "h.teb": ("TEB", None, None, None), "e.pdf": ("PDF", 2, False, None),
    }
    assert "truncated CAJ" in info["f.caj"].error.message
    assert [(r.title, r.page_index) for r in documents.bookmarks(seen).filter("error is null").orderBy("path").collect()] == [("标题", 0), ("t", 0)]
    assert documents.outline_defects(seen).collect()[0].reason == "destination is outside source pages"
    images = documents.hnc8_images(documents.hnc8_pages(seen))
    assert tuple(documents.image_counts(images).first())[1:] == (0, 1, 1)
    objects, refs = documents.pdf_objects(seen), documents.pdf_references(seen)
    assert objects.filter("kind = 'plain'").count() == 7 and documents.dangling_references(objects, refs).count() == 0
    made = documents.to_pdf(seen.filter("path rlike '(pdf|kdh)$'"))
    assert sorted(r.page_count for r in made.collect()) == [1, 2]
    outlines = made.select("path", F.lit(0).alias("ordinal"), F.lit(0).alias("depth"), F.lit("x").alias("title"), F.lit(0).alias("page_index"), F.lit(None).alias("error"))
    done = documents.add_bookmarks(made, outlines)
    assert all(pdf.Pdf(bytes(r.pdf)).has_outline for r in done.collect())
    written = reports.write_files(done, "pdf", f"file://{tmp_path}/out", ".pdf").collect()
    assert len(written) == 2 and all(open(r.written, "rb").read(5) == b"%PDF-" for r in written)
    assert documents.errors(documents.bookmarks(seen), documents.caj_pages(seen)).count() == 1
    assert documents.hnc8_headers(seen).count() == 2 and documents.application_info(seen).filter("status = 'Absent'").count() == 2
    assert documents.pdf_pages(seen).count() == 3


def test_stream_has_the_rows_of_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.caj").write_bytes(fx.caj([("a", b"1", 1)] * (k + 1)))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), documents.bookmarks, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents.bookmarks(source.read(spark, str(tmp_path / "in"))).count() == 6


def test_jpeg():
    assert jpeg.read(fx.jpeg(16, 8)) == {"width": 16, "height": 8, "color": "gray"} and jpeg.read(fx.jpeg(gray=False))["color"] == "ycc"
    for bad, reason in ((fx.jpeg(tail=b"x"), "bytes after EOI"), (fx.jpeg(extra=b"\xff\xee\0\2"), "marker FFEE"), (fx.jpeg().replace(b"\xff\xc0", b"\xff\xc2"), "frame type"), (fx.jpeg()[:-2], "scan has no end"), (fx.jpeg(0, 8), "no extent"), (fx.jpeg().replace(b"\x12\xff\0", b"\x12\xff\xd0"), "restart marker"), (b"x", "SOI")):
        assert reason in jpeg.problem(bad)


def test_image_pages_to_pdf(spark):
    photo = fx.jpeg(gray=False)
    data = fx.c8([fx.image_text((0, 0, 742, 1484), (10, 20, 30, 40)), b""], [(1, photo), (2, fx.jpeg())])
    made = writer.compose(data)
    out = made["pdf"]
    index = pdf.Pdf(out)
    assert made["no_image_pages"] == 1 and made["page_count"] == len(index.pages) == 2 and photo in out and out.count(b"/DCTDecode") == 2
    assert index.pages[0]["media_box"] == [0, 0, 72, 144]
    assert b"q 72 0 0 144 0 0 cm /I0 Do Q" in out and b"q 2.911051 0 0 -3.881402 0.97035 142.059299 cm /I1 Do Q" in out
    assert "page 1, image 1: bitmap header" in fails(writer.compose, fx.c8([fx.image_text((0, 0, 1, 1))], [(3, b"x")]))
    assert "image coordinates of none text" in fails(writer.compose, fx.c8([b""], [(2, photo)]))
    made = documents.to_pdf(files(spark, data, fx.hn_a([("t", b"2", 1)]), fx.c8([fx.image_text((0, 0, 1, 1))], [(0, b"x")]))).orderBy("path").collect()
    assert [r.page_count for r in made] == [2, 2, None] and pdf.Pdf(bytes(made[1].pdf)).has_outline and made[2].error.kind == "Truncated"
    assert [(r.width, r.color, r.problem) for r in documents.jpeg_info(files(spark, data)).collect()] == [(16, "ycc", None), (16, "gray", None)]


def test_bilevel_images(spark):
    assert bilevel.wrapper(fx.bitmap()) == {"width": 33, "height": 4, "stride": 8, "visible_bytes": 5}
    for bad, reason in ((fx.bitmap(0), "width must be positive"), (fx.bitmap(palette=bytes(8)), "palette"), (fx.bitmap()[:40], "truncated image at byte 0"), (fx.bitmap(10**5, 10**5), "pixels limit exceeded")):
        assert reason in fails(bilevel.wrapper, bad)
    assert bilevel.profile(fx.symbols_image()) == "symbols"
    assert bilevel.profile(fx.bitmap() + fx.segment(0, 48, data=struct.pack(">II", 33, 4) + bytes(11)) + fx.segment(1, 38)) == "generic"
    assert "sizes differ" in fails(bilevel.profile, fx.symbols_image(34)) and "segment profile" in fails(bilevel.profile, fx.bitmap())
    read = lambda data: list(bilevel.segments(data, 0))
    assert "do not rise" in fails(read, fx.segment(1, 0) + fx.segment(1, 0)) and "not before it" in fails(read, fx.segment(0, 0, [3]))
    assert "extends beyond source" in fails(read, fx.segment(0, 0, data=b"abc")[:-1])
    data = files(spark, fx.c8([b""], [(0, fx.bitmap()), (3, fx.symbols_image()), (3, b"x" * 50)]))
    got = documents.bilevel_images(data).orderBy("image").collect()
    assert [(r.type, r.width, r.profile, r.problem is None) for r in got] == [(0, 33, None, True), (3, 33, "symbols", True), (3, None, None, False)]
    assert [r.referred_to for r in documents.jbig2_segments(data).filter("number is not null and image = 2").orderBy("number").collect()] == [[], [], [1], [2], []]
