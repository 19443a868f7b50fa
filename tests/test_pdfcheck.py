import fixtures as fx

from quire.formats import pdf, pdfcheck
from quire.operators import documents, relational


def build(*objects, root=1, junk=b""):
    """A file of (number, text); ``junk`` stands before the last object."""
    out, places = b"%PDF-1.4\n", {}
    for k, (number, text) in enumerate(objects):
        out += junk if k == len(objects) - 1 else b""
        places[number] = len(out)
        out += f"{number} 0 obj\n{text}\nendobj\n".encode("latin-1")
    table, top = len(out), max(places) + 1
    rows = b"".join(f"{places[n]:010d} 00000 n \n".encode() if n in places else b"0000000000 00000 f \n" for n in range(1, top))
    return out + f"xref\n0 {top}\n0000000000 65535 f \n".encode() + rows + f"trailer\n<< /Size {top} /Root {root} 0 R >>\nstartxref\n{table}\n%%EOF\n".encode()


BASE = [(2, "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 9 9] >>"), (3, "<< /Type /Page /Parent 2 0 R >>")]


def told(*objects, **options):
    return [r["problem"] for r in pdfcheck.problems(pdf.Pdf(build(*objects, **options)))]


def catalog(more=""):
    return (1, f"<< /Type /Catalog /Pages 2 0 R {more}>>")


def test_whole_files():
    assert told(catalog(), *BASE) == [] and list(pdfcheck.problems(pdf.Pdf(fx.pdf(3)))) == []
    grown = pdf.append_outline(fx.pdf(2), [(0, "一", 0), (1, "b", 1), (0, "c", 1)])
    assert list(pdfcheck.problems(pdf.Pdf(grown))) == []
    assert [(r["depth"], r["title"], r["page_index"]) for r in pdfcheck.outline(pdf.Pdf(grown))] == [(0, "一", 0), (1, "b", 1), (0, "c", 1)]


def test_problems():
    assert told(catalog(), *BASE, junk=b"junk ") == ["bytes between objects are not blank"]
    assert told(catalog(), *BASE, (5, "[9 0 R]")) == ["reference to absent object 9"]
    assert told(catalog(), *BASE, (6, "<< /Parent 5 0 R >>")) == []  # a stale parent in a free slot
    assert told(catalog(), BASE[0], (3, "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 0 9] >>")) == ["page has no valid MediaBox"]
    assert [r["problem"] for r in pdfcheck.problems(pdf.Pdf(fx.pdf(1, b"footer")))] == ["bytes after the end of the file"]


def test_outline():
    entry = lambda title, more: f"<< /Title ({title}) /Dest [3 0 R /Fit] {more} >>"
    parts = [catalog("/Outlines 4 0 R "), *BASE, (4, "<< /First 5 0 R /Last 6 0 R >>")]
    assert told(*parts, (5, entry("a", "/Parent 4 0 R /Next 6 0 R")), (6, entry("b", "/Parent 4 0 R /Prev 5 0 R"))) == []
    assert told(*parts, (5, entry("a", "/Parent 4 0 R /Next 6 0 R")), (6, entry("b", "/Parent 4 0 R"))) == ["outline: previous link differs"]
    assert told(*parts, (5, entry("a", "/Parent 4 0 R /Next 5 0 R")), (6, "null")) == ["outline: entry is missing, repeated or too deep"]
    assert told(*parts, (5, entry("a", "/Parent 4 0 R")), (6, "null")) == ["outline: last link differs"]
    assert told(*parts, (5, "<< /Title (a) /Parent 4 0 R /Dest [2 0 R /Fit] /Next 6 0 R >>"), (6, entry("b", "/Parent 4 0 R /Prev 5 0 R"))) == ["outline: destination is not a page"]


def test_names():
    parts = [catalog("/Names << /Dests 4 0 R >> /Dests << /old [3 0 R /Fit] >> "), *BASE, (4, "<< /Kids [5 0 R 6 0 R] >>")]
    whole = build(*parts, (5, "<< /Limits [(a) (b)] /Names [(a) [3 0 R /Fit] (b) << /D [3 0 R /Fit] >>] >>"), (6, "<< /Limits [(c) (c)] /Names [<63> [3 0 R /Fit]] >>"))
    assert [(r["name"], r["page_index"], r["problem"]) for r in pdfcheck.named_destinations(pdf.Pdf(whole))] == [("old", 0, None), ("a", 0, None), ("b", 0, None), ("c", 0, None)]
    assert told(*parts, (5, "<< /Limits [(a) (b)] /Names [(b) [3 0 R /Fit] (a) [2 0 R /Fit]] >>"), (6, "<< /Names [(z) [3 0 R /Fit]] >>"))[0] == "named destination: name is out of order or outside its limits"


def test_strings():
    assert pdfcheck.text_string(b"(a\\)\\101\\n\\\nb)") == "a)A\nb" and pdfcheck.text_string(b"<FEFF4E2D>") == "中" and pdfcheck.text_string(b"<6>") == "`" and pdfcheck.text_string(1) is None


def test_tables(spark):
    files = spark.createDataFrame([("a", bytearray(build(catalog(), *BASE, (5, "[9 0 R]")))), ("b", bytearray(b"%PDF-1.4"))], "path string, content binary")
    rows = documents.pdf_problems(files).orderBy("path").collect()
    assert [(r.number, r.problem) for r in rows] == [(5, "reference to absent object 9"), (None, None)] and rows[1].error.code == 8
    assert relational.overlaps(documents.pdf_spans(files).filter("error is null"), ["path"], ["offset"], "offset", "end").count() == 0
    assert documents.pdf_outlines(files).filter("error is null").count() == 0 == documents.named_destinations(files).filter("error is null").count()


def test_contents():
    page = lambda more: (3, f"<< /Type /Page /Parent 2 0 R /Contents {more} >>")
    stream, wrong = (4, "<< /Length 1 >>\nstream\nq\nendstream"), ["page contents are not streams"]
    for more, rest, problems in (
        ("4 0 R", [stream], []),
        ("[4 0 R]", [stream], []),
        ("[]", [stream], []),
        ("null", [stream], []),
        ("5 0 R", [stream, (5, "[4 0 R 4 0 R]")], []),
        ("(q)", [stream], wrong),
        ("5 0 R", [stream, (5, "<< /Length 1 >>")], wrong),
        ("5 0 R", [stream, (5, "[4 0 R 2 0 R]")], wrong),
        ("[[4 0 R]]", [stream], wrong),
        ("9 0 R", [stream], ["reference to absent object 9"]),
    ):
        assert told(catalog(), BASE[0], page(more), *rest) == problems, more


def test_update_keeps_the_first_identifier():
    assert pdf.fnv128(b"") == 0x6C62272E07BB014262B821756295C58D and pdf.fnv128(b"a") == 0xD228CB696F1A8CAF78912B704E4A8964
    named = fx.pdf(2).replace(b"/Root 1 0 R", b"/ID [ <AB01> (\\(x\xff) ] /Root 1 0 R")
    once = pdf.Pdf(pdf.append_outline(named, [(0, "a", 0)]))
    first, second = once.trailer["ID"]
    mark = pdf.fnv128(b"[ <AB01> (\\(x\xff) ]" + len(named.rstrip()).to_bytes(8, "little") + once.startxref.to_bytes(8, "little"))
    assert first == b"<AB01>" and second == b"<%032X>" % mark and once.id_text == b"[<AB01> " + second + b"]" and not list(pdfcheck.problems(once))
    twice = pdf.Pdf(pdf.update(once, {}, 99))
    assert twice.trailer["ID"][0] == first and twice.trailer["ID"][1] != second
    assert "ID" not in pdf.Pdf(pdf.append_outline(fx.pdf(2), [(0, "a", 0)])).trailer
    assert b"/ID" not in pdf.append_outline(fx.pdf(2).replace(b"/Root 1 0 R", b"/ID [(a)] /Root 1 0 R"), [(0, "a", 0)]).rsplit(b"trailer")[-1]
