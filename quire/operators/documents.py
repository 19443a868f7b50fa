"""Documents as tables: detection, containers, outlines, pages, images, PDF objects and errors.

Each function takes file rows (path, content) and returns a DataFrame. Detection is a
built-in expression. Kernels run in Arrow batches, one document a call; a document that
cannot be read gives a row with its error and never fails the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from quire.formats import bilevel, caj, fragment, inspection, jpeg, kdh, mend, package, paged, pdf, pdfcheck, pixels, records, writer
from quire.formats.errors import FormatError, Limits, error_code
from quire.operators.relational import dangling, first_match

#: Signatures in the order they are tried.
SIGNATURES = [(b"%PDF-", "PDF"), (b"CAJ", "CAJ"), (b"KDH", "KDH"), (b"HN", "HN"), (b"\xc8\0\0\0", "C8"), (b"TEB", "TEB")]
SEARCHED = 1024
#: Rows, and bytes of binary values, after which a kernel's rows are handed on.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20
#: Fixed value: lines of a CAA target descriptor, each closed, then blanks alone.
CAA = r"^\[TARGET\]\r?\nA1=[0-9]+\r?\nA2=[A-Za-z0-9+/=]+\r?\nB1=0\r?\nB2=\r?\nC1=0\r?\nC2=\r?\nD1=[0-9]+\r?\nD2=[A-Za-z0-9+/=]+\r?\nDOCTYPE=(NH|KDH)\r?\n[ \t\r\n]*$"
CONVERTIBLE = ("PDF", "CAJ", "KDH", "HN", "C8")


def detect_format(content: Column) -> Column:
    """The format's name by signature, never by file name; null if none matches."""
    start = F.decode(F.substring(content, 1, SEARCHED), "ISO-8859-1")
    marker = F.instr(start, "%PDF-")
    return F.coalesce(first_match(content, SIGNATURES, None), F.when(start.rlike(CAA), "CAA"), F.when(marker > 0, "PDF"))


def detections(files: DataFrame) -> DataFrame:
    """``path, format, header_offset, bytes_read, convertible``; unknown files have a null format."""
    at_start = first_match(F.col("content"), SIGNATURES, None)
    marker = F.instr(F.decode(F.substring("content", 1, SEARCHED), "ISO-8859-1"), "%PDF-")
    name = detect_format(F.col("content"))
    read = F.when(at_start.isNotNull(), F.least(F.lit(5), F.octet_length("content"))).otherwise(F.least(F.lit(SEARCHED), F.octet_length("content")))
    offset = F.when(name.isNull(), None).when(at_start.isNull() & (name == "PDF"), marker - 1).otherwise(0)
    return files.select("path", name.alias("format"), offset.cast("long").alias("header_offset"), read.cast("long").alias("bytes_read"), F.coalesce(name.isin(*CONVERTIBLE), F.lit(False)).alias("convertible"))


def error_row(error: Exception) -> dict:
    """The columns of a row that tells what was wrong with a document, or a part of it."""
    e = error if isinstance(error, FormatError) else FormatError("Malformed", f"document cannot be read ({type(error).__name__})")
    return e.row | {"error": {"kind": e.kind, "code": error_code(e), "offset": e.offset, "reason": e.reason, "message": str(e)}}


def each_document(files: DataFrame, kernel: Callable[..., Iterator[dict]], schema: str, *, more: list[str] | None = None) -> DataFrame:
    """Rows of ``kernel`` for each file, with its path; ``error`` columns tell why there are none.

    The kernel gets the content and the columns named in ``more``.
    """
    more = more or []
    full = f"path string, {schema}, error struct<kind:string,code:int,offset:long,reason:string,message:string>"
    names = [f.name for f in _parse_datatype_string(full).fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(_parse_datatype_string(full))

    def run(batches):
        for batch in batches:
            others, rows, held = [c.to_pylist() for c in batch.columns[2:]], [], 0
            for path, content, *rest in zip(batch.column(0).to_pylist(), batch.column(1), *others, strict=True):
                try:
                    for row in kernel(content.as_py() or b"", *rest):
                        rows.append({"path": path} | row)
                        held += sum(len(x) for x in row.values() if isinstance(x, bytes))
                        if len(rows) >= BATCH_ROWS or held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], kinds)
                            rows, held = [], 0
                except Exception as error:  # damaged bytes may break a kernel in ways it does not foresee: that is the document's error
                    rows.append({"path": path} | error_row(error))
            if rows:
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], kinds)

    return files.select("path", "content", *more).mapInArrow(run, full)


def _of(files: DataFrame, *formats: str) -> DataFrame:
    return files.filter(detect_format(F.col("content")).isin(*formats))


def caj_pages(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    def kernel(data):
        for k, (offset, length, number) in enumerate(caj.read(data, limits)["pages"]):
            yield {"page_index": k, "offset": offset, "length": length, "page_object_id": number}

    return each_document(_of(files, "CAJ"), kernel, "page_index long, offset long, length long, page_object_id long")


def bookmarks(files: DataFrame, limits: Limits = Limits(), max_depth: int = 64) -> DataFrame:
    """CAJ and HN-A outlines in one table: ordinal, depth, title, page_index."""

    def kernel(data):
        if data[:3] == b"CAJ":
            for k, (depth, title, page) in enumerate(caj.read(data, limits)["bookmarks"]):
                yield {"ordinal": k, "depth": depth, "title": title, "page_index": page}
            return
        box = paged.Container(data, limits)
        if box.header.variant == "HN-A":
            yield from ({k: r[k] for k in ("ordinal", "depth", "title", "page_index")} for r in box.outline(max_depth) if r["kind"] == "bookmark")

    return each_document(_of(files, "CAJ", "HN"), kernel, "ordinal int, depth long, title string, page_index long")


def outline_defects(files: DataFrame, limits: Limits = Limits(), max_depth: int = 64) -> DataFrame:
    """HN-A entries that were skipped or clamped."""

    def kernel(data):
        box = paged.Container(data, limits)
        if box.header.variant == "HN-A":
            yield from ({k: r[k] for k in ("ordinal", "offset", "reason", "repair")} for r in box.outline(max_depth) if r["kind"] == "defect")

    return each_document(_of(files, "HN"), kernel, "ordinal int, offset long, reason string, repair string")


def hnc8_headers(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    def kernel(data):
        h = paged.Container(data, limits).header
        yield {"variant": h.variant, "native_mode": h.native_mode, "native_origin": h.native_origin and list(h.native_origin), "page_size": list(h.page_size), "page_count": h.page_count, "page_index": {"offset": h.page_index[0], "length": h.page_index[1]}}

    return each_document(_of(files, "HN", "C8"), kernel, "variant string, native_mode long, native_origin array<int>, page_size array<int>, page_count long, page_index struct<offset:long,length:long>")


def hnc8_pages(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each page with its images, framing and its own error."""

    return each_document(_of(files, "HN", "C8"), _page_kernel(limits), "page long, text_offset long, text_length long, image_count long, images array<struct<type:long,offset:long,length:long>>, text_framing string, text_records long, text_decoded_length long, text_error string, page_error string")


def _page_kernel(limits: Limits) -> Callable[[bytes], Iterator[dict]]:
    def kernel(data):
        for row in inspection.page_rows(data, limits):
            yield row | {"page_error": row.pop("error")}

    return kernel


def hnc8_images(pages: DataFrame) -> DataFrame:
    """One row for each image descriptor of ``hnc8_pages``."""
    return pages.select("path", "page", F.posexplode("images").alias("image", "i")).select("path", "page", (F.col("image") + 1).alias("image"), "i.*")


def image_counts(images: DataFrame) -> DataFrame:
    """Images of each document by codec."""
    return images.groupBy("path").agg(F.count_if(F.col("type") == 0).alias("type0"), F.count_if(F.col("type").isin(1, 2)).alias("jpeg"), F.count_if(F.col("type") == 3).alias("type3"))


def text_records(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The records of each page's text in order; ``page_error`` tells where a page's grammar ends early."""

    def kernel(data):
        box = paged.Container(data, limits)
        for k in range(1, box.header.page_count + 1):
            n = 0
            try:
                for n, r in enumerate(records.PageText(box, box.page(k)).records(), 1):
                    yield {"page": k, "ordinal": n} | r
            except FormatError as error:
                yield {"page": k, "ordinal": n + 1, "page_error": str(error)}

    return each_document(_of(files, "HN", "C8"), kernel, "page long, ordinal long, offset long, kind string, tag int, value int, x int, y int, width int, height int, style int, code int, character string, text string, name binary, words array<int>, page_error string")


def needs_fonts(pages: DataFrame) -> DataFrame:
    """``path, native, unknown_pages``: whether the first page with text of ``hnc8_pages`` is native text."""
    first = F.expr("min_by(text_framing, page) filter (where text_length > 0)")
    return pages.filter("error is null").groupBy("path").agg(F.coalesce(first == "native", F.lit(False)).alias("native"), F.count_if(F.col("page_error").isNotNull() | F.col("text_error").isNotNull()).alias("unknown_pages"))


def native_font_modes(needs: DataFrame, headers: DataFrame) -> DataFrame:
    """``path, native_mode`` of the documents of ``needs_fonts`` that need fonts: the mode decides which."""
    return needs.filter("native").select("path").join(headers.filter("error is null").select("path", "native_mode"), "path")


def page_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``path, page, links`` for every page that can be read: its links (ordinal, rect, color, uri) in their order, none an empty array."""
    own = links.filter("error is null and problem is null").groupBy("path", "page").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rect", "color", "uri"))).alias("links"))
    none = F.array().cast("array<struct<ordinal:int,rect:array<double>,color:string,uri:string>>")
    return pages.filter("error is null and page_error is null").select("path", "page").join(own, ["path", "page"], "left").withColumn("links", F.coalesce("links", none))


def conversion_totals(made: DataFrame) -> DataFrame:
    """Sums over all documents of ``to_pdf``: converted, failed, pages, bytes, bookmarks, repairs and blank pages."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return made.agg(
        F.count_if(F.col("error").isNull()).alias("converted"), F.count_if(F.col("error").isNotNull()).alias("failed"), total("page_count").alias("pages"), total("output_bytes").alias("bytes"),
        total("bookmark_count").alias("bookmarks"), total("repaired_links").alias("links"), total("repaired_objects").alias("objects"), total(F.size("omitted_pages")).alias("blank_pages"),
    )


def checksums(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """``path, size, sha256, matches``: files held against pinned sizes and hashes (path, size, sha256); null where none is pinned."""
    seen = files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256")).alias("f")
    p = pinned.select("path", F.col("size").alias("_size"), F.lower("sha256").alias("_sha"))
    return seen.join(p, "path", "left").select("path", "size", "sha256", ((F.col("size") == F.col("_size")) & (F.col("sha256") == F.col("_sha"))).alias("matches"))


def application_info(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return each_document(_of(files, "HN", "C8"), lambda data: iter([package.read(data, limits)]), "doi string, url string, note_count long, status string, defect string")


def package_links(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The links that C8 packages keep as notes: page, place in points, color and address."""
    return each_document(_of(files, "C8"), lambda data: package.links(data, limits), "ordinal int, page long, rect array<double>, color string, uri string, problem string")


def _pdf_bytes(data: bytes, limits: Limits) -> bytes:
    if data[:3] == b"KDH":
        return kdh.decode(data, limits)[0]
    return data[max(0, data[:SEARCHED].find(b"%PDF-")) :]


def jpeg_info(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Size and colour of each JPEG image of HN and C8 documents, with what is wrong with it."""

    def kernel(data):
        box = paged.Container(data, limits)
        for k in range(1, box.header.page_count + 1):
            for i in box.images(box.page(k)):
                if i["record_type"] in (1, 2):
                    body = data[i["payload_offset"] : i["payload_offset"] + i["payload_length"]]
                    problem = jpeg.problem(body)
                    info = {} if problem else jpeg.read(body)
                    yield {"page": k, "image": i["image_number"], "width": info.get("width"), "height": info.get("height"), "color": info.get("color"), "problem": problem}

    return each_document(_of(files, "HN", "C8"), kernel, "page long, image long, width long, height long, color string, problem string")


def bilevel_images(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Size of each type-0 and type-3 image, the segment profile of type 3, and what is wrong with it."""

    def kernel(data):
        box = paged.Container(data, limits)
        for k in range(1, box.header.page_count + 1):
            for i in box.images(box.page(k)):
                if i["record_type"] in (0, 3):
                    body = data[i["payload_offset"] : i["payload_offset"] + i["payload_length"]]
                    row = {"page": k, "image": i["image_number"], "type": i["record_type"]}
                    try:
                        row |= bilevel.wrapper(body, limits)
                        row["profile"] = bilevel.profile(body) if i["record_type"] == 3 else None
                    except FormatError as error:
                        row["problem"] = str(error)
                    yield row

    return each_document(_of(files, "HN", "C8"), kernel, "page long, image long, type long, width long, height long, stride long, visible_bytes long, profile string, problem string")


def decoded_images(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pixels of each type-0 and type-3 image: rows of eight pixels a byte, one being black; ``problem`` if it cannot be decoded.

    Payloads are cut out where a document is read, then spread, so that one long document does
    not keep one task busy; whole documents are not shuffled.
    """
    def payloads(data):
        box = paged.Container(data, limits)
        for k in range(1, box.header.page_count + 1):
            try:
                for i in box.images(box.page(k)):
                    if i["record_type"] in (0, 3):
                        yield {"page": k, "image": i["image_number"], "type": i["record_type"], "payload": data[i["payload_offset"] : i["payload_offset"] + i["payload_length"]]}
            except FormatError:
                continue  # ``hnc8_pages`` tells what is wrong with the page

    rows = each_document(_of(files, "HN", "C8"), payloads, "page long, image long, type long, payload binary").filter("error is null").drop("error")
    spread = rows.repartition(F.col("path"), F.col("page"), F.col("image"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                body = row.pop("payload")
                try:
                    found = pixels.read(row["type"], body, limits)
                    row |= {"height": found.shape[0], "width": found.shape[1], "rows": pixels.packed(found), "problem": None}
                except FormatError as error:
                    row |= {"height": None, "width": None, "rows": None, "problem": str(error)}
                yield pa.RecordBatch.from_pylist([row], kinds)

    schema = "path string, page long, image long, type long, height long, width long, rows binary, problem string"
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return spread.mapInArrow(run, schema)


def jbig2_segments(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The JBIG2 segments of type-3 images; offsets count from the payload's start."""

    def kernel(data):
        box = paged.Container(data, limits)
        for k in range(1, box.header.page_count + 1):
            for i in box.images(box.page(k)):
                if i["record_type"] == 3:
                    body = data[i["payload_offset"] : i["payload_offset"] + i["payload_length"]]
                    yield from ({"page": k, "image": i["image_number"]} | s for s in bilevel.segments(body))

    return each_document(_of(files, "HN", "C8"), kernel, "page long, image long, number long, type long, name string, page_association long, referred_to array<long>, data_offset long, data_length long")


def to_pdf(files: DataFrame, limits: Limits = Limits(), *, include_bookmarks: bool = True, allow_damaged: bool = False) -> DataFrame:
    """``pdf`` of PDF files (checked; byte for byte, from their header on, if nothing has to be repaired), of KDH wrappers, of CAJ documents
    rebuilt from their objects, and of HN and C8 documents whose pages are images.

    ``omitted_pages`` of CAJ documents are blank, since what they depend on is damaged; without
    ``allow_damaged`` such a document is an error.
    """

    def kernel(data):
        if data[:3] == b"CAJ":
            row = fragment.rebuild(data, limits, include_bookmarks=include_bookmarks, allow_damaged=allow_damaged)
            yield row | {"output_bytes": len(row["pdf"])}
            return
        if data[:2] == b"HN" or data[:4] == b"\xc8\0\0\0":
            row = writer.compose(data, limits, include_bookmarks=include_bookmarks)
            yield row | {"output_bytes": len(row["pdf"])}
            return
        body = _pdf_bytes(data, limits)
        index = pdf.Pdf(body, limits)
        for row in pdfcheck.problems(index):
            if row["problem"].startswith(pdfcheck.REFUSED):
                raise index.v.malformed(row["problem"], row["offset"], **({"object": row["number"]} if row["number"] is not None else {}))
        body, repaired = mend.repair(index)
        yield {"pdf": body, "page_count": len(index.pages), "output_bytes": len(body), "repaired_objects": repaired}

    return each_document(_of(files, "PDF", "CAJ", "KDH", "HN", "C8"), kernel, "pdf binary, page_count long, output_bytes long, bookmark_count long, repaired_links long, duplicate_images long, no_image_pages long, omitted_pages array<struct<page_index:long,offset:long>>, repaired_objects long")


def _fragment(data: bytes, limits: Limits) -> fragment.Fragment:
    rows = caj.read(data, limits)["pages"]
    return fragment.Fragment(data, rows[0][0], rows[-1][0] + rows[-1][1], limits)


def caj_objects(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The PDF objects of CAJ documents; ``kind`` is the /Type of a dictionary, ``stream`` or the sort of value."""

    def kernel(data):
        body = _fragment(data, limits)
        for number, (_, at, generation) in sorted(body.rows.items()):
            value = body.values[number]
            kind = value.get("Type") or ("stream" if "Length" in value else "dictionary") if isinstance(value, dict) else type(value).__name__
            yield {"number": number, "generation": generation, "kind": str(kind), "offset": at, "length": body.spans[number][1] - at}

    return each_document(_of(files, "CAJ"), kernel, "number long, generation long, kind string, offset long, length long")


def caj_references(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Which object of a CAJ document refers to which, each pair once."""

    def kernel(data):
        for owner, value in sorted(_fragment(data, limits).values.items()):
            yield from ({"owner": owner, "target": t} for t in sorted(set(fragment.targets(value))))

    return each_document(_of(files, "CAJ"), kernel, "owner long, target long")


def pdf_objects(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return each_document(_of(files, "PDF", "KDH"), lambda data: pdf.Pdf(_pdf_bytes(data, limits), limits).objects(), "number long, generation long, kind string, offset long")


def pdf_references(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    def kernel(data):
        yield from ({"owner": a, "target": b} for a, b in pdf.Pdf(_pdf_bytes(data, limits), limits).references())

    return each_document(_of(files, "PDF", "KDH"), kernel, "owner long, target long")


def pdf_pages(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    def kernel(data):
        for k, p in enumerate(pdf.Pdf(_pdf_bytes(data, limits), limits).pages):
            yield {"page_index": k, "number": p["number"], "generation": p["generation"], "media_box": [float(x) for x in p["media_box"]] if p["media_box"] else None}

    return each_document(_of(files, "PDF", "KDH"), kernel, "page_index long, number long, generation long, media_box array<double>")


def pdf_spans(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Where each object of a PDF begins and ends; ``overlaps`` of ``quire.operators.relational`` finds those that run into others."""
    return _checked(files, pdfcheck.spans, "number long, offset long, end long, gap_problem long", limits)


def pdf_outlines(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The outline entries of PDFs with what is wrong with their links."""
    return _checked(files, pdfcheck.outline, "ordinal int, number long, depth long, title string, page_index long, problem string", limits)


def named_destinations(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _checked(files, pdfcheck.named_destinations, "name string, page_index long, problem string", limits)


def pdf_problems(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What is wrong with PDFs that can be read; the ``error`` of those that cannot."""
    return _checked(files, pdfcheck.problems, "number long, offset long, problem string", limits)


def problem_counts(files: DataFrame, limits: Limits = Limits(), *, more: list[str] | None = None) -> DataFrame:
    """``path, problems`` and the columns named in ``more``: how many rows ``pdf_problems`` has of each PDF, a row a file, without a join."""

    def kernel(data, *others):
        count = 0
        try:
            for _ in pdfcheck.problems(pdf.Pdf(_pdf_bytes(data, limits), limits)):
                count += 1
        except Exception:  # as in each_document: a file that cannot be read is one row
            count += 1
        yield dict(zip(more or [], others, strict=True)) | {"problems": count}

    schema = "".join(f"`{n}` {files.schema[n].dataType.simpleString()}, " for n in more or []) + "problems long"
    return each_document(_of(files, "PDF", "KDH"), kernel, schema, more=more).drop("error")


def _checked(files: DataFrame, check: Callable[[pdf.Pdf], Iterator[dict]], schema: str, limits: Limits) -> DataFrame:
    return each_document(_of(files, "PDF", "KDH"), lambda data: check(pdf.Pdf(_pdf_bytes(data, limits), limits)), schema)


def dangling_references(objects: DataFrame, references: DataFrame) -> DataFrame:
    """References of a file to objects it does not have."""
    live = objects.filter("kind != 'free' and error is null").select(F.col("path").alias("p"), "number")
    return dangling(references.filter("error is null").select("path", "owner", "target"), live, {"path": "p", "target": "number"})


def document_info(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each recognised file; null means unknown, not zero. Image payloads are not read."""

    def kernel(data):
        head = data[:4]
        if head[:3] == b"CAJ":
            found = caj.read(data, limits)
            n = len(found["bookmarks"])
            yield {"page_count": found["page_count"], "has_outline": n > 0, "bookmark_count": n}
        elif head[:2] == b"HN" or head == b"\xc8\0\0\0":
            box = paged.Container(data, limits)
            h = box.header
            rows = list(box.outline()) if h.variant == "HN-A" else None
            n = None if rows is None else sum(r["kind"] == "bookmark" for r in rows)
            yield {"variant": h.variant, "page_count": h.page_count, "has_outline": None if n is None else n > 0, "bookmark_count": n, "outline_defects": None if n is None else len([r for r in rows if r["kind"] == "defect"])}
        elif head[:3] == b"KDH" or b"%PDF-" in data[:SEARCHED]:
            index = pdf.Pdf(_pdf_bytes(data, limits), limits)
            yield {"page_count": len(index.pages), "has_outline": index.has_outline}
        else:
            yield {}

    def named(data, name):
        try:
            for row in kernel(data):
                yield row | {"format": name}
        except FormatError as error:
            error.row = {"format": name}
            raise

    known = files.select("path", "content", detect_format(F.col("content")).alias("name")).filter("name is not null")
    return each_document(known, named, "format string, variant string, page_count long, has_outline boolean, bookmark_count long, outline_defects long", more=["name"])


def add_bookmarks(pdfs: DataFrame, outlines: DataFrame, limits: Limits = Limits(), *, refuse_existing: bool = False) -> DataFrame:
    """Outlines (path, ordinal, depth, title, page_index) written into the PDFs (path, pdf) of the same path.

    A PDF that has an outline keeps it, or is an error if ``refuse_existing``; so is one without entries then.
    """
    entries = outlines.filter("error is null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "depth", "title", "page_index"))).alias("entries"))

    def append(data, rows, absent):
        if absent:
            raise FormatError("Malformed", "no document")
        if refuse_existing and not rows:
            raise FormatError("Malformed", "source has no bookmarks")
        if refuse_existing and pdf.Pdf(data, limits).has_outline:
            raise FormatError("Malformed", "PDF already has an outline")
        yield {"pdf": pdf.append_outline(data, [(r["depth"], r["title"], r["page_index"]) for r in rows or ()], limits)}

    joined = pdfs.join(entries, "path", "left").select("path", F.col("pdf").alias("content"), "entries", F.col("pdf").isNull().alias("absent"))
    return each_document(joined, append, "pdf binary", more=["entries", "absent"]).select("path", "pdf", F.coalesce(F.nullif(F.col("error.reason"), F.lit("")), F.col("error.message")).alias("error"))


def errors(*tables: DataFrame) -> DataFrame:
    """The errors of several tables, one row each."""
    parts = [t.filter("error is not null").select("path", "error.*") for t in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
