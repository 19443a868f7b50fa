"""Damaged PDFs are errors, never failures; what has one right answer is repaired."""

import random
import zlib

import fixtures as fx
import pytest

from quire.formats import mend, pdf, pdfcheck
from quire.formats.errors import FormatError, Limits
from quire.operators import documents


def packed(pages=2, outline=False):
    """A file whose catalog and page tree stand in an object stream."""
    kids = " ".join(f"{k} 0 R" for k in range(3, 3 + pages))
    values = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {pages} /MediaBox [0 0 9 9] >>"] + ["<< /Type /Page /Parent 2 0 R >>"] * pages
    table, body = "", ""
    for k, v in enumerate(values):
        table += f"{k + 1} {len(body)} "
        body += v + " "
    raw = zlib.compress((table + body).encode())
    out, n = b"%PDF-1.5\n", len(values) + 1
    at = len(out)
    out += f"{n} 0 obj\n<< /Type /ObjStm /N {len(values)} /First {len(table)} /Filter /FlateDecode /Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream\nendobj\n"
    start = len(out)
    rows = b"\0\0\0\0" + b"".join(b"\2" + n.to_bytes(2, "big") + bytes([k]) for k in range(len(values))) + b"".join(b"\1" + x.to_bytes(2, "big") + b"\0" for x in (at, start))
    up = b"".join(b"\2" + bytes((a - b) & 255 for a, b in zip(rows[k : k + 4], rows[k - 4 : k] if k else bytes(4), strict=True)) for k in range(0, len(rows), 4))
    rows = zlib.compress(up)
    out += f"{n + 1} 0 obj\n<< /Type /XRef /Size {n + 2} /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length {len(rows)} >>\nstream\n".encode() + rows + b"\nendstream\nendobj\n"
    return out + f"startxref\n{start}\n%%EOF\n".encode()


def rebuilt(text):
    """A file of the objects in ``text`` (number to value) with a right table."""
    out, at = b"%PDF-1.4\n", {}
    for n, value in text.items():
        at[n] = len(out)
        out += f"{n} 0 obj\n{value}\nendobj\n".encode()
    table = len(out)
    return out + b"xref\n" + b"".join(f"{n} 1\n{o:010d} 00000 n \n".encode() for n, o in at.items()) + f"trailer\n<< /Size 99 /Root 1 0 R >>\nstartxref\n{table}\n%%EOF\n".encode()


def test_packed_objects_are_read_and_bookmarked():
    data = packed(3)
    index = pdf.Pdf(data)
    assert len(index.pages) == 3 and index.pages[0]["media_box"] == [0, 0, 9, 9] and len(index.packs) == 1
    out = pdf.append_outline(data, [(0, "a", 0), (1, "b", 2)])
    again = pdf.Pdf(out)
    assert [(r["title"], r["depth"], r["page_index"], r["problem"]) for r in pdfcheck.outline(again)] == [("a", 0, 0, None), ("b", 1, 2, None)]
    assert len(again.pages) == 3 and out.startswith(data[:-1])


def test_many_bookmarks_side_by_side():
    out = pdf.append_outline(fx.pdf(1), [(0, f"t{k}", 0) for k in range(30_000)])
    assert len(pdf.Pdf(out).rows) > 30_000


def test_streams_are_whole_or_errors():
    data = packed()
    with pytest.raises(FormatError, match="limit exceeded"):
        pdf.Pdf(data, Limits(max_allocation_bytes=10))
    raw = zlib.compress(b"x" * 5000)
    index = pdf.Pdf(fx.pdf(1))
    assert index._inflate(raw, 0) == b"x" * 5000
    for bad in (raw[:-6], raw[:20], b"", b"nonsense"):
        with pytest.raises(FormatError):
            index._inflate(bad, 0)
    for old, new in ((b"/W [1 2 1]", b"/W [1 b 1]"), (b"/W [1 2 1]", b"/W [0 0 0]"), (b"/Columns 4", b"/Columns 0"), (b"/Columns 4 >>", b"/Columns 4] "), (b"/Predictor 12", b"/Predictor -1"), (b"/N 4", b"/N 9"), (b"/First", b"/Sirst"), (b"/Size 7", b"/Index [0 1 2] /Size 7"), (b"/Size 7", b"/Index 7 /Size 7")):
        assert old in data
        shifted = data.replace(old, new)
        with pytest.raises(FormatError):
            pdf.Pdf(shifted[: shifted.rfind(b"startxref")] + f"startxref\n{shifted.rfind(b'6 0 obj')}\n%%EOF\n".encode())


def test_object_streams_that_extend_each_other_end():
    data = packed().replace(b"/Type /ObjStm", b"/Type /ObjStm /Extends 5 0 R")
    data = data[: data.rfind(b"startxref")] + f"startxref\n{data.rfind(b'6 0 obj')}\n%%EOF\n".encode()
    with pytest.raises(FormatError, match="circle"):
        pdf.Pdf(data)


@pytest.mark.parametrize("name", ["classic", "packed", "caj"])
def test_mutations_are_located_errors(name):
    whole = {"classic": pdf.append_outline(fx.pdf(3), [(0, "t", 1)]), "packed": packed(3), "caj": fx.caj_body([3], [(3, "<< /Type /Page /Parent 2 0 R >>"), (7, b"<< /Length 3 >>\nstream\nabc\nendstream")], [("t", b"1", 1)])}[name]
    rng, seen = random.Random(7), 0
    from quire.formats import fragment

    for _ in range(1500):
        raw = bytearray(whole)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(raw))
            kind = rng.randrange(3)
            if kind == 0:
                raw[k] = rng.randrange(256)
            elif kind == 1:
                del raw[k : k + rng.randrange(1, 9)]
            else:
                raw[k:k] = bytes(rng.choice(b"0123456789[]<>/() R") for _ in range(rng.randrange(1, 5)))
        try:
            if name == "caj":
                fragment.rebuild(bytes(raw))
            else:
                pdf.Pdf(bytes(raw))
        except FormatError:
            seen += 1
    assert seen > 200


def test_one_bad_file_does_not_fail_the_job(spark):
    def kernel(data):
        raise KeyError("unforeseen")
        yield

    files = spark.createDataFrame([("a", bytearray(b"CAJ")), ("b", bytearray(packed()))], "path string, content binary")
    assert [r.error.kind for r in documents.each_document(files, kernel, "x long").collect()] == ["Malformed"] * 2
    bad = bytearray(packed())
    bad[40] ^= 255
    files = spark.createDataFrame([("a", bad), ("b", bytearray(packed()))], "path string, content binary")
    for table in (documents.pdf_objects, documents.pdf_references, documents.pdf_pages, documents.pdf_problems, documents.pdf_outlines, documents.to_pdf, documents.document_info):
        rows = table(files).collect()
        assert {r.path for r in rows if r.error} <= {"a"} and (table is documents.pdf_problems or "b" in {r.path for r in rows if not r.error} or table is documents.pdf_outlines)


def test_repairs():
    pages = {1: "<< /Type /Catalog /Pages 2 0 R /Outlines 5 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 9 9] /MediaBox [0 0 9 9] >>", 3: "<< /Type /Page /Parent 2 0 R >>", 4: "<< /Type /Page /Parent 3 0 R /Rotate 90 >>", 5: "<< /Type /Outlines /First 6 0 R /Last 6 0 R /Count 2 >>", 6: "<< /Title (a) /Parent 5 0 R /Next 7 0 R /Dest [3 0 R /Fit] >>", 7: "<< /Title (b) /Parent 5 0 R /Prev 7 0 R /Dest [4 0 R /Fit] >>"}
    data = rebuilt(pages)
    index = pdf.Pdf(data)
    assert set(mend.faults(index)) == {(2, "MediaBox", None), (4, "Parent", 2), (7, "Prev", 6), (5, "Last", 7)} or {f[:2] for f in mend.faults(index)} == {(2, "MediaBox"), (4, "Parent"), (7, "Prev")}
    while True:  # a broken link may hide the next
        data, n = mend.repair(pdf.Pdf(data))
        if not n:
            break
    index = pdf.Pdf(data)
    assert not index.repaired and not list(pdfcheck.problems(index)) and index.resolve(pdf.Ref(4, 0))["Rotate"] == 90
    whole = fx.pdf(2)
    assert mend.repair(pdf.Pdf(whole)) == (whole, 0)
    with pytest.raises(FormatError, match="repeats a key"):
        pdf.Pdf(rebuilt(pages | {2: pages[2].replace("/MediaBox [0 0 9 9] >>", "/MediaBox [0 0 9 8] >>")}))


def test_signed_files_are_refused():
    for more in ("/Perms << >>", "/AcroForm << /SigFlags 1 >>"):
        with pytest.raises(FormatError, match="signed"):
            pdf.Pdf(rebuilt({1: f"<< /Type /Catalog /Pages 2 0 R {more} >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: "<< /Type /Page /Parent 2 0 R >>"}))


def test_objects_are_parsed_once(monkeypatch):
    kids = " ".join(f"{3 + k} 0 R" for k in range(50))
    pages = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count 50 /MediaBox [0 0 9 9] /MediaBox [0 0 9 9] >>"} | {3 + k: "<< /Type /Page /Parent 1 0 R >>" for k in range(50)}
    data, tops, parse = rebuilt(pages), [], pdf.Pdf.parse

    def counted(self, data, at, depth=0):
        tops.extend([at] if depth == 0 else [])
        return parse(self, data, at, depth)

    monkeypatch.setattr(pdf.Pdf, "parse", counted)
    index = pdf.Pdf(data)
    found, wrong = list(pdfcheck.problems(index)), mend.faults(index)
    assert not found and len(wrong) == 51 and len(index.repaired) == 1
    assert len(tops) == len(set(tops)) == len(pages) + 1  # the trailer too
    for kept in (0, 200):  # what is not kept is read anew, with the same results
        monkeypatch.setattr(pdf, "KEPT_BYTES", kept)
        index = pdf.Pdf(data)
        assert (list(pdfcheck.problems(index)), mend.faults(index)) == (found, wrong) and index.kept <= kept


def test_problems_are_counted_in_one_pass(spark):
    whole, box = fx.pdf(2), {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>", 3: "<< /Type /Page /Parent 2 0 R >>", 4: "<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>"}
    rows = [("a", bytearray(whole), 7), ("b", bytearray(rebuilt(box)), 8), ("b", bytearray(whole), None), ("c", bytearray(b"%PDF-1.4 nothing"), 9), (None, bytearray(rebuilt(box)), 10)]
    files = spark.createDataFrame(rows, "path string, content binary, n int").coalesce(1)
    told = [r.path for r in documents.pdf_problems(files).collect()]
    made = documents.problem_counts(files, more=["n"])
    assert made.dtypes == [("path", "string"), ("n", "int"), ("problems", "bigint")]
    got = [tuple(r) for r in made.collect()]
    assert got == [("a", 7, 0), ("b", 8, 3), ("b", None, 0), ("c", 9, 1), (None, 10, 3)] and sum(g[2] for g in got) == len(told)


def test_repairs_make_each_document_once(spark, tmp_path):
    from quire.plans import containers

    spark.createDataFrame([(k, k % 5, "1-URGENT", "F") for k in range(20)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    made = containers.QUERIES["pdf_repairs"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Join" not in plan
    assert sorted((r.path, r.page_count, r.repaired_objects, r.problems) for r in made.collect()) == [("c0", 4, 6, 0), ("c1", 4, 0, 0), ("c2", 4, 1, 0), ("c3", 4, 4, 0), ("c4", 4, 1, 0)]
