"""Container operators on documents built from the driver's tables, with what they must find as SQL on the same tables.

Every customer with orders is one document in each format, and every order one page, one outline
entry and some images of it; suppliers are bilevel images. Documents are built as files would
be read (path, content), so the operators see nothing but bytes; SQL derives the places,
lengths, texts and errors from the tables and the layouts of the formats. A customer has few orders, so no
document is large. ``FAULTS`` are built in: damaged streams, dead links, absent objects,
entries that lead nowhere and pages that cannot be read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.formats import build, encoders
from quire.functions import binary
from quire.operators import documents, fonts
from quire.sinks import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Every so many customers, a document has a fault of the kind.
FAULTS = {"damaged stream": 5, "dead link": 7, "absent object": 4, "negative offset": 6}
JPEG = build.jpeg()
#: Characters of the native codes from 0xB0A1 on.
NATIVE = bytes(x for k in range(20) for x in (0xB0, 0xA1 + k)).decode("gb18030")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


def _built(spark: SparkSession, sf_dir: str, make: Callable[[int, list[dict]], bytes]) -> DataFrame:
    """``path, content``: a document for each customer's orders (o_orderkey, o_orderpriority, o_orderstatus) in order of their keys."""
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("orders"))

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            done = [(f"c{c}", make(c, orders)) for c, orders in rows]
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.binary())], ["path", "content"])

    return orders.mapInArrow(run, "path string, content binary")


#: Orders with their place in the customer's document; ``n`` is its number of pages.
ORDERS = """o AS (SELECT o_custkey AS c, 'c' || o_custkey AS path, o_orderkey AS k, o_orderstatus AS st, o_orderpriority || ' ' || o_orderkey AS content,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""


def _content(order: dict) -> str:
    return f"{order['o_orderpriority']} {order['o_orderkey']}"


# CAJ


def _caj(c: int, orders: list[dict]) -> bytes:
    spans = []
    for i, order in enumerate(orders):
        own, text = f"{10 + 2 * i} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>\nendobj\n", _content(order)
        if i == 0 and c % FAULTS["damaged stream"] == 0:
            own += f"{11 + 2 * i} 0 obj\n<< /Length 1 >>\nstream\n{text}\nendobj\n"
        else:
            own += f"{11 + 2 * i} 0 obj\n<< /Length {len(text)} >>\nstream\n{text}\nendstream\nendobj\n"
        if i == len(orders) - 1 and c % FAULTS["dead link"] == 0:
            own += f"{12 + 2 * i} 0 obj\n<< /Type /Annot /Subtype /Link /Dest [9999 0 R /Fit] >>\nendobj\n"
        spans.append(own.encode())
    outline = b"".join(build.toc(f"订单 {o['o_orderkey']}", str(i + 1).encode(), 1 + i % 3) for i, o in enumerate(orders))
    head = bytearray(0x114)
    head[:4] = b"CAJ\0"
    table = 0x114 + len(outline)
    struct.pack_into("<iI", head, 0x10, len(spans), table)
    struct.pack_into("<i", head, 0x110, len(orders))
    at, rows = table + 12 * len(spans), b""
    for i, own in enumerate(spans):
        rows += struct.pack("<III", at, len(own), 10 + 2 * i)
        at += len(own)
    return bytes(head) + outline + rows + b"".join(spans)


CAJ_SPANS = (
    "WITH "
    + ORDERS
    + """, t AS (SELECT *, length((10 + 2 * i) || ' 0 obj_<< /Type /Page /Parent 2 0 R /Contents ' || (11 + 2 * i) || ' 0 R >>_endobj_')
      + CASE WHEN i = 0 AND c % 5 = 0 THEN length((11 + 2 * i) || ' 0 obj_<< /Length 1 >>_stream_' || content || '_endobj_')
             ELSE length((11 + 2 * i) || ' 0 obj_<< /Length ' || length(content) || ' >>_stream_' || content || '_endstream_endobj_') END
      + CASE WHEN i = n - 1 AND c % 7 = 0 THEN length((12 + 2 * i) || ' 0 obj_<< /Type /Annot /Subtype /Link /Dest [9999 0 R /Fit] >>_endobj_') ELSE 0 END AS bytes FROM o),
    p AS (SELECT *, 276 + 308 * n + 12 * n + coalesce(sum(bytes) OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM t)
"""
)


@query(CAJ_SPANS + "SELECT path, i AS page_index, CAST(pos AS BIGINT) AS \"offset\", CAST(bytes AS BIGINT) AS length, 10 + 2 * i AS page_object_id FROM p")
def caj_pages(spark, sf_dir):
    """The page table of CAJ documents."""
    return documents.caj_pages(_built(spark, sf_dir, _caj)).filter("error is null").drop("error")


@query("WITH " + ORDERS + "SELECT path, CAST(i AS INTEGER) AS ordinal, i % 3 AS depth, '订单 ' || k AS title, i AS page_index FROM o")
def caj_bookmarks(spark, sf_dir):
    """Outlines of CAJ documents, titles in GB18030."""
    return documents.bookmarks(_built(spark, sf_dir, _caj)).filter("error is null").drop("error")


@query(CAJ_SPANS + "SELECT path, n AS page_count, n AS bookmark_count, CASE WHEN c % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS repaired_links, CASE WHEN c % 5 = 0 THEN '0@' || pos ELSE '' END AS omitted FROM p WHERE i = 0")
def caj_conversions(spark, sf_dir):
    """CAJ documents as PDF: pages that depend on a damaged object are blank, dead links are mended."""
    made = documents.to_pdf(_built(spark, sf_dir, _caj), allow_damaged=True)
    omitted = F.array_join(F.transform("omitted_pages", lambda p: F.concat_ws("@", p.page_index, p.offset)), ",")
    return made.filter("error is null").select("path", "page_count", "bookmark_count", "repaired_links", omitted.alias("omitted"))


@query("WITH " + ORDERS + "SELECT path, i AS page_index, 10 + 2 * i AS number, '0 0 612 792' AS box FROM o")
def caj_rebuilt_pages(spark, sf_dir):
    """The pages of PDFs rebuilt from CAJ documents, under a tree that the body lacks."""
    made = documents.to_pdf(_built(spark, sf_dir, _caj), allow_damaged=True).filter("error is null").select("path", F.col("pdf").alias("content"))
    return _boxes(documents.pdf_pages(made))


@query(
    "WITH " + ORDERS + """SELECT path, 10 + 2 * i AS owner, 2 AS target FROM o WHERE c % 5 <> 0
    UNION ALL SELECT path, 10 + 2 * i, 11 + 2 * i FROM o WHERE c % 5 <> 0 UNION ALL SELECT path, 12 + 2 * i, 9999 FROM o WHERE c % 5 <> 0 AND c % 7 = 0 AND i = n - 1"""
)
def caj_references(spark, sf_dir):
    """References among the objects of undamaged CAJ bodies, those to absent ones included."""
    return documents.caj_references(_built(spark, sf_dir, _caj)).filter("error is null").drop("error")


@query("WITH " + ORDERS + "SELECT path, 'stream length is invalid' AS reason, 'Malformed' AS kind, CAST(8 AS INTEGER) AS code FROM o WHERE c % 5 = 0 AND i = 0")
def caj_damage(spark, sf_dir):
    """Why a strict reading of damaged CAJ bodies ends, with its code."""
    return documents.errors(documents.caj_objects(_built(spark, sf_dir, _caj))).select("path", "reason", "kind", "code")


# PDF and KDH


def _pdf(c: int, orders: list[dict]) -> bytes:
    n = len(orders)
    kids = " ".join(f"{3 + i} 0 R" for i in range(n))
    parts = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {n} /MediaBox [0 0 {100 + n} 792] >>"]
    for i in range(n):
        parts.append(f"<< /Type /Page /Parent 2 0 R /Contents {900 if i == n - 1 and c % FAULTS['absent object'] == 0 else 3 + n + i} 0 R >>")
    parts += [f"<< /Length {len(_content(o))} >>\nstream\n{_content(o)}\nendstream" for o in orders]
    out, places = "%PDF-1.4\n", []
    for k, part in enumerate(parts):
        places.append(len(out))
        out += f"{k + 1} 0 obj\n{part}\nendobj\n"
    rows = "".join(f"{p:010d} 00000 n \n" for p in places)
    return f"{out}xref\n0 {len(parts) + 1}\n0000000000 65535 f \n{rows}trailer\n<< /Size {len(parts) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


PDF_OBJECTS = (
    "WITH "
    + ORDERS
    + """, b AS (
      SELECT c, path, n, 1 AS number, '1 0 obj_<< /Type /Catalog /Pages 2 0 R >>_endobj_' AS body FROM o WHERE i = 0
      UNION ALL SELECT c, path, n, 2, '2 0 obj_<< /Type /Pages /Kids [' || string_agg((3 + i) || ' 0 R', ' ' ORDER BY i) || '] /Count ' || n || ' /MediaBox [0 0 ' || (100 + n) || ' 792] >>_endobj_' FROM o GROUP BY c, path, n
      UNION ALL SELECT c, path, n, 3 + i, (3 + i) || ' 0 obj_<< /Type /Page /Parent 2 0 R /Contents ' || CASE WHEN i = n - 1 AND c % 4 = 0 THEN 900 ELSE 3 + n + i END || ' 0 R >>_endobj_' FROM o
      UNION ALL SELECT c, path, n, 3 + n + i, (3 + n + i) || ' 0 obj_<< /Length ' || length(content) || ' >>_stream_' || content || '_endstream_endobj_' FROM o),
    f AS (SELECT *, 9 + coalesce(sum(length(body)) OVER (PARTITION BY c ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM b)
"""
)


@query(PDF_OBJECTS + """SELECT path, CAST(number AS BIGINT) AS number, CAST(0 AS BIGINT) AS generation, 'plain' AS kind, CAST(pos AS BIGINT) AS "offset" FROM f
    UNION ALL SELECT path, 0, 65535, 'free', 0 FROM f WHERE number = 1""")  # fmt: skip
def pdf_objects(spark, sf_dir):
    """The cross-reference rows of PDFs."""
    found = documents.pdf_objects(_built(spark, sf_dir, _pdf)).filter("error is null").drop("error")
    return found.withColumn("generation", F.when(F.col("kind") == "free", 65535).otherwise(F.col("generation")).cast("long"))


@query(PDF_OBJECTS + """SELECT path, CAST(number AS BIGINT) AS number, CAST(pos AS BIGINT) AS "offset", CAST(pos + length(body) - 1 AS BIGINT) AS "end" FROM f""")
def pdf_spans(spark, sf_dir):
    """Where the objects of PDFs begin and end; nothing stands between them."""
    return documents.pdf_spans(_built(spark, sf_dir, _pdf)).filter("error is null and gap_problem is null").select("path", "number", "offset", "end")


PDF_REFERENCES = "WITH " + ORDERS + """, r AS (SELECT c, path, 1 AS owner, 2 AS target FROM o WHERE i = 0 UNION ALL SELECT c, path, 2, 3 + i FROM o UNION ALL SELECT c, path, 3 + i, 2 FROM o
    UNION ALL SELECT c, path, 3 + i, CASE WHEN i = n - 1 AND c % 4 = 0 THEN 900 ELSE 3 + n + i END FROM o) """  # fmt: skip


@query(PDF_REFERENCES + "SELECT path, CAST(owner AS BIGINT) AS owner, CAST(target AS BIGINT) AS target FROM r")
def pdf_references(spark, sf_dir):
    """Which object of a PDF refers to which."""
    return documents.pdf_references(_built(spark, sf_dir, _pdf)).filter("error is null").drop("error")


@query(PDF_REFERENCES + "SELECT path, CAST(owner AS BIGINT) AS owner, CAST(target AS BIGINT) AS target FROM r WHERE target = 900")
def pdf_dangling_references(spark, sf_dir):
    """References of PDFs to objects that they lack."""
    files = _built(spark, sf_dir, _pdf)
    return documents.dangling_references(documents.pdf_objects(files), documents.pdf_references(files))


@query("WITH " + ORDERS + "SELECT path, i AS page_index, 3 + i AS number, '0 0 ' || (100 + n) || ' 792' AS box FROM o")
def pdf_pages(spark, sf_dir):
    """Pages of PDFs in order, with the box they inherit."""
    return _boxes(documents.pdf_pages(_built(spark, sf_dir, _pdf)))


def _boxes(pages: DataFrame) -> DataFrame:
    box = F.array_join(F.transform("media_box", lambda x: x.cast("int").cast("string")), " ")
    return pages.filter("error is null").select("path", "page_index", "number", box.alias("box"))


@query("WITH " + ORDERS + "SELECT path, 2 + n AS number, 'reference to absent object 900' AS problem FROM o WHERE i = 0 AND c % 4 = 0")
def pdf_problems(spark, sf_dir):
    """What is wrong with PDFs that can be read."""
    return documents.pdf_problems(_built(spark, sf_dir, _pdf)).filter("error is null").select("path", "number", "problem")


@query(
    PDF_OBJECTS + """, w AS (SELECT path, c, n, '%PDF-1.4_' || string_agg(body, '' ORDER BY number) AS objects, string_agg(lpad(CAST(pos AS VARCHAR), 10, '0') || ' 00000 n _', '' ORDER BY number) AS places, count(*) AS m FROM f GROUP BY path, c, n),
    x AS (SELECT path, c, n, replace(objects || 'xref_0 ' || (m + 1) || '_0000000000 65535 f _' || places || 'trailer_<< /Size ' || (m + 1) || ' /Root 1 0 R >>_startxref_' || length(objects) || '_%%EOF_', '_', chr(10)) AS whole FROM w)
    SELECT path, n AS page_count, CAST(length(whole) AS BIGINT) AS output_bytes, sha256(whole) AS pdf_sha256, CAST(NULL AS VARCHAR) AS reason FROM x WHERE c % 4 <> 0
    UNION ALL SELECT path, NULL, NULL, NULL, 'reference to absent object 900' FROM x WHERE c % 4 = 0"""
)
def kdh_conversions(spark, sf_dir):
    """The PDFs inside KDH wrappers, byte for byte, but for those that are not whole."""
    made = documents.to_pdf(_built(spark, sf_dir, lambda c, orders: build.kdh(_pdf(c, orders))))
    return made.select("path", "page_count", "output_bytes", F.sha2("pdf", 256).alias("pdf_sha256"), F.col("error.reason").alias("reason"))


@query("WITH " + ORDERS + "SELECT path, CAST(i AS INTEGER) AS ordinal, i % 3 AS depth, '订单 ' || k AS title, i AS page_index, CAST(NULL AS VARCHAR) AS problem FROM o")
def added_bookmarks(spark, sf_dir):
    """Outlines of CAJ documents written into the PDFs of the same path, read again and checked."""
    pdfs = _built(spark, sf_dir, _pdf).withColumnRenamed("content", "pdf")
    done = documents.add_bookmarks(pdfs, documents.bookmarks(_built(spark, sf_dir, _caj))).filter("error is null")
    return documents.pdf_outlines(done.select("path", F.col("pdf").alias("content"))).select("path", "ordinal", "depth", "title", "page_index", "problem")


# HN and C8


def _hn(c: int, orders: list[dict]) -> bytes:
    return build.hn_a([(f"订单 {o['o_orderkey']}", str(i + 1 + (5 * len(orders) if o["o_orderstatus"] == "P" else 0)).encode(), 1 + o["o_orderkey"] % 5) for i, o in enumerate(orders)], len(orders))


HN_ENTRIES = "WITH " + ORDERS + """, e AS (SELECT *, 1 + k % 5 AS level, lag(1 + k % 5, 1, 0) OVER (PARTITION BY c ORDER BY i) AS above FROM o),
    j AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i) - 1 AS q FROM e WHERE st <> 'P'),
    w AS (SELECT *, q + least(1, min(level - q) OVER (PARTITION BY c ORDER BY i)) AS written FROM j)
"""  # fmt: skip


@query(HN_ENTRIES + "SELECT path, CAST(i AS INTEGER) AS ordinal, CAST(written - 1 AS BIGINT) AS depth, '订单 ' || k AS title, i AS page_index FROM w")
def hn_bookmarks(spark, sf_dir):
    """Outlines of HN documents: entries that lead nowhere are left out, levels that skip are clamped."""
    return documents.bookmarks(_built(spark, sf_dir, _hn)).filter("error is null").drop("error")


@query(HN_ENTRIES + """SELECT path, CAST(i AS INTEGER) AS ordinal, 348 + 308 * i + 280 AS "offset", 'destination is outside source pages' AS reason, 'skipped' AS repair FROM e WHERE st = 'P'
    UNION ALL SELECT path, CAST(i AS INTEGER), 348 + 308 * i + 304, 'level skips a parent', 'clamped' FROM w WHERE level > above + 1 AND written < level""")
def hn_outline_defects(spark, sf_dir):
    """Entries of HN outlines that were skipped or clamped, with their bytes."""
    return documents.outline_defects(_built(spark, sf_dir, _hn)).filter("error is null").drop("error")


def _c8(c: int, orders: list[dict]) -> bytes:
    n = len(orders)
    head = bytearray(0x50)
    head[:4] = b"\xc8\0\0\0"
    struct.pack_into("<iI", head, 8, n, 2)
    struct.pack_into("<HH", head, 32, 742, 1484)
    rows, body, at = b"", b"", 0x50 + 20 * n
    for i in range(n):
        places = b"".join(b"\x0a\x80\0\xd3" + struct.pack("<HHHH", 10 * j, 20, 100, 50) + bytes(16) for j in range(i % 3))
        plain = b"\x10\x20\xa1\xb0" + places + b"\x04\x80\0\0"
        text = b"COMPRESSTEXT" + struct.pack("<I", len(plain)) + zlib.compress(plain, 0)  # stored, so its length is known
        rows += struct.pack("<iih", -1 if i == 0 and c % FAULTS["negative offset"] == 0 else at + len(body), len(text), i % 3) + bytes(10)
        body += text
        for _ in range(i % 3):
            body += struct.pack("<iii", 2, at + len(body) + 12, len(JPEG)) + JPEG
    items = "".join(f'<Item Type="Link" LineStyle="4" ShowType="1" Page="{i + 1}" Color="00332211"><RC l="100" t="200" r="{300 + 100 * i}" b="400"/><Item Type="UrlLink" Aim="https://example.org/{o["o_orderkey"]}"/></Item>' for i, o in enumerate(orders))
    package = f'<Package><FileProperty-Package><DOI>10.1/{c}</DOI></FileProperty-Package><Note-Package><NoteItems Version="1.0" Unit="PointsM">{items}</NoteItems></Note-Package></Package>'.encode()
    out = bytes(head) + rows + body
    packed = zlib.compress(package)
    return out + struct.pack("<II", len(package), len(packed)) + packed + b"APPINFOSIGN " + str(len(out)).encode()


C8_PAGES = (
    "WITH "
    + ORDERS
    + f""", t AS (SELECT *, 8 + 28 * (i % 3) AS plain, 16 + 11 + 8 + 28 * (i % 3) AS bytes FROM o),
    p AS (SELECT *, CAST(80 + 20 * n + coalesce(sum(bytes + (i % 3) * (12 + {len(JPEG)})) OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, c % 6 = 0 AND i = 0 AS bad FROM t)
"""
)


@query(C8_PAGES + """SELECT path, i + 1 AS page, CASE WHEN NOT bad THEN pos END AS text_offset, CASE WHEN NOT bad THEN bytes END AS text_length, CASE WHEN NOT bad THEN i % 3 END AS image_count, CASE WHEN NOT bad THEN 'compresstext' END AS text_framing,
    CASE WHEN NOT bad THEN 2 + i % 3 END AS text_records, CASE WHEN NOT bad THEN plain END AS text_decoded_length, CASE WHEN bad THEN 'malformed HN/C8 C8 at byte 80, page 1: text offset: negative signed value' END AS page_error FROM p""")  # fmt: skip
def hnc8_pages(spark, sf_dir):
    """Pages of C8 documents with the framing of their texts; one that cannot be read tells why and hides no other."""
    return documents.hnc8_pages(_built(spark, sf_dir, _c8)).select("path", "page", "text_offset", "text_length", "image_count", "text_framing", "text_records", "text_decoded_length", "page_error")


@query(C8_PAGES + f"""SELECT path, i + 1 AS page, j AS image, CAST(2 AS BIGINT) AS type, CAST(pos + bytes + 12 + (j - 1) * (12 + {len(JPEG)}) AS BIGINT) AS "offset", CAST({len(JPEG)} AS BIGINT) AS length FROM p, (VALUES (1), (2)) v(j) WHERE j <= i % 3""")
def hnc8_images(spark, sf_dir):
    """Images of C8 pages, one descriptor after the other."""
    return documents.hnc8_images(documents.hnc8_pages(_built(spark, sf_dir, _c8)))


@query(C8_PAGES + "SELECT path, CAST(0 AS BIGINT) AS type0, CAST(sum(i % 3) AS BIGINT) AS jpeg, CAST(0 AS BIGINT) AS type3 FROM p GROUP BY path HAVING sum(i % 3) > 0")
def image_counts(spark, sf_dir):
    """Images of each document by codec."""
    return documents.image_counts(documents.hnc8_images(documents.hnc8_pages(_built(spark, sf_dir, _c8))))


@query("WITH " + ORDERS + "SELECT path, 'C8' AS variant, CAST(2 AS BIGINT) AS native_mode, '742x1484' AS page_size, n AS page_count, '80+' || (20 * n) AS page_index FROM o WHERE i = 0 UNION ALL SELECT path, 'HN-A', NULL, '100x200', n, (348 + 308 * n) || '+' || (20 * n) FROM o WHERE i = 0")
def hnc8_headers(spark, sf_dir):
    """Headers of C8 and HN documents."""
    heads = documents.hnc8_headers(_built(spark, sf_dir, _c8).union(_built(spark, sf_dir, _hn))).filter("error is null")
    return heads.select("path", "variant", "native_mode", F.array_join(F.transform("page_size", lambda x: x.cast("string")), "x").alias("page_size"), "page_count", F.concat_ws("+", "page_index.offset", "page_index.length").alias("page_index"))


@query(
    C8_PAGES + """, g AS (SELECT *, plain FROM p WHERE NOT bad)
    SELECT path, i + 1 AS page, CAST(1 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS "offset", 'glyph' AS kind, CAST(8208 AS INTEGER) AS tag, CAST(45217 AS INTEGER) AS value, CAST(8208 AS INTEGER) AS x, CAST(NULL AS INTEGER) AS width FROM g
    UNION ALL SELECT path, i + 1, 1 + j, 4 + 28 * (j - 1), 'image', 32778, 54016, 10 * (j - 1), 100 FROM g, (VALUES (1), (2)) v(j) WHERE j <= i % 3
    UNION ALL SELECT path, i + 1, 2 + i % 3, 4 + 28 * (i % 3), 'end', 32772, 0, NULL, NULL FROM g"""
)
def text_records(spark, sf_dir):
    """Glyphs, image places and ends in the texts of C8 pages."""
    return documents.text_records(_built(spark, sf_dir, _c8)).filter("error is null and page_error is null").select("path", "page", "ordinal", "offset", "kind", "tag", "value", "x", "width")


@query(C8_PAGES + f"""SELECT path, i + 1 AS page, j AS image, CAST(16 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, 'gray' AS color FROM p, (VALUES (1), (2)) v(j) WHERE j <= i % 3 AND c % 6 <> 0""")
def jpeg_info(spark, sf_dir):
    """Size and colour of the JPEG images of documents whose pages can all be read."""
    return documents.jpeg_info(_built(spark, sf_dir, _c8)).filter("error is null and problem is null").drop("error", "problem")


@query(C8_PAGES + """, s AS (SELECT path, c, n, count(*) FILTER (WHERE i % 3 = 0) AS blank FROM p GROUP BY path, c, n)
    SELECT path, n AS page_count, blank AS no_image_pages, CAST(0 AS BIGINT) AS duplicate_images, CAST(NULL AS VARCHAR) AS error FROM s WHERE c % 6 <> 0 UNION ALL SELECT path, NULL, NULL, NULL, 'text offset: negative signed value' FROM s WHERE c % 6 = 0""")  # fmt: skip
def image_conversions(spark, sf_dir):
    """C8 documents of image pages as PDF."""
    return documents.to_pdf(_built(spark, sf_dir, _c8)).select("path", "page_count", "no_image_pages", "duplicate_images", F.col("error.reason").alias("error"))


@query("WITH " + ORDERS + "SELECT path, i AS page_index, '0 0 72 144' AS box FROM o WHERE c % 6 <> 0")
def image_pdf_pages(spark, sf_dir):
    """Pages of PDFs composed of images, in points."""
    made = documents.to_pdf(_built(spark, sf_dir, _c8)).filter("error is null").select("path", F.col("pdf").alias("content"))
    return _boxes(documents.pdf_pages(made)).drop("number")


@query("WITH " + ORDERS + "SELECT path, '10.1/' || c AS doi, n AS note_count, 'Read' AS status FROM o WHERE i = 0")
def application_info(spark, sf_dir):
    """What the packages of C8 documents say of them."""
    return documents.application_info(_built(spark, sf_dir, _c8)).filter("error is null").select("path", "doi", "note_count", "status")


@query("WITH " + ORDERS + "SELECT path, CAST(i AS INTEGER) AS ordinal, i + 1 AS page, '1 2 ' || (3 + i) || ' 4' AS rect, '112233' AS color, 'https://example.org/' || k AS uri FROM o")
def package_links(spark, sf_dir):
    """Links that C8 packages keep as notes."""
    found = documents.package_links(_built(spark, sf_dir, _c8)).filter("error is null and problem is null")
    return found.select("path", "ordinal", "page", F.array_join(F.transform("rect", lambda x: x.cast("int").cast("string")), " ").alias("rect"), "color", "uri")


def _native(c: int, orders: list[dict]) -> bytes:
    return build.c8([struct.pack("<HHHHHHHH", 0x8001, 100 + i, 0x8002, 1, 7, (0xB0A1 + o["o_orderkey"] % 20), 0x8004, 0) for i, o in enumerate(orders)])


@query("WITH " + ORDERS + f"""SELECT path, i + 1 AS page, CAST(8 AS BIGINT) AS "offset", CAST(7 AS INTEGER) AS x, CAST(100 + i AS INTEGER) AS y, CAST(45217 + k % 20 AS INTEGER) AS code, substr('{NATIVE}', CAST(1 + k % 20 AS INTEGER), 1) AS character FROM o""")
def native_glyphs(spark, sf_dir):
    """Glyphs of native pages with their places and characters."""
    return documents.text_records(_built(spark, sf_dir, _native)).filter("error is null and kind = 'glyph'").select("path", "page", "offset", "x", "y", "code", "character")


@query("WITH " + ORDERS + "SELECT path, true AS native, CAST(0 AS BIGINT) AS unknown_pages FROM o WHERE i = 0 UNION ALL SELECT 'x' || path, false, CAST(CASE WHEN c % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) FROM o WHERE i = 0")
def needs_fonts(spark, sf_dir):
    """Whether documents are native text, which needs fonts."""
    images = _built(spark, sf_dir, _c8).select(F.concat(F.lit("x"), "path").alias("path"), "content")
    return documents.needs_fonts(documents.hnc8_pages(_built(spark, sf_dir, _native).union(images)))


@query("WITH " + ORDERS + "SELECT path, CAST(2 AS BIGINT) AS native_mode FROM o WHERE i = 0")
def native_font_modes(spark, sf_dir):
    """The mode of documents that need fonts."""
    images = _built(spark, sf_dir, _c8).select(F.concat(F.lit("x"), "path").alias("path"), "content")
    files = _built(spark, sf_dir, _native).union(images)
    return documents.native_font_modes(documents.needs_fonts(documents.hnc8_pages(files)), documents.hnc8_headers(files))


@query(C8_PAGES + "SELECT path, i + 1 AS page, CASE WHEN i % 2 = 0 THEN i || ' https://example.org/' || k ELSE '' END AS links FROM p WHERE NOT bad")
def page_links(spark, sf_dir):
    """The links of each page, found by page."""
    files = _built(spark, sf_dir, _c8)
    links = documents.package_links(files).filter("page % 2 = 1")
    found = documents.page_links(documents.hnc8_pages(files), links)
    return found.select("path", "page", F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x.ordinal, x.uri)), ",").alias("links"))


@query(CAJ_SPANS + "SELECT CAST(count(*) FILTER (WHERE i = 0) AS BIGINT) AS converted, CAST(0 AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) AS BIGINT) AS bookmarks, CAST(count(*) FILTER (WHERE i = 0 AND c % 7 = 0) AS BIGINT) AS links, CAST(0 AS BIGINT) AS objects, CAST(count(*) FILTER (WHERE i = 0 AND c % 5 = 0) AS BIGINT) AS blank_pages FROM p")
def conversion_totals(spark, sf_dir):
    """What converting CAJ documents came to in all."""
    return documents.conversion_totals(documents.to_pdf(_built(spark, sf_dir, _caj), allow_damaged=True)).drop("bytes")


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 = 1 END AS matches FROM documents WHERE text IS NOT NULL")
def checksums(spark, sf_dir):
    """Files held against pinned hashes."""
    docs = _table(spark, sf_dir, "documents").filter("text is not null")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    pinned = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 3 == 2, "x").otherwise("")), 256).alias("sha256"))
    return documents.checksums(files, pinned).select(F.col("path").cast("long").alias("doc_id"), "size", "matches")


@query("WITH " + ORDERS + "SELECT path, 'FEFF' || regexp_replace(upper(hex(encode('10.1/' || c))), '(..)', '00\\1', 'g') AS doi FROM o WHERE i = 0 AND c % 6 <> 0")
def output_application_info(spark, sf_dir):
    """The DOI that PDFs of C8 documents carry in their information dictionary."""
    made = documents.to_pdf(_built(spark, sf_dir, _c8)).filter("error is null")
    return made.select("path", F.regexp_extract(F.decode("pdf", "ISO-8859-1"), "/CNKI_DOI <([0-9A-F]+)>", 1).alias("doi"))


def _faulty(c: int, orders: list[dict]) -> bytes:
    """A PDF whose pages name a wrong parent (every third), whose tree repeats its box (every other) and whose outline has wrong links (every fifth)."""
    n = len(orders)
    box = "/MediaBox [0 0 9 9] " * (1 + (c % 2 == 0))
    kids = " ".join(f"{3 + i} 0 R" for i in range(n))
    parts = ["<< /Type /Catalog /Pages 2 0 R /Outlines 900 0 R >>".replace("900", str(3 + n)), f"<< /Type /Pages /Kids [{kids}] /Count {n} {box}>>"]
    parts += [f"<< /Type /Page /Parent {1 if c % 3 == 0 else 2} 0 R >>" for _ in range(n)]
    first = 4 + n
    parts.append(f"<< /Type /Outlines /First {first} 0 R /Last {first + (n - 1 if c % 5 else 0)} 0 R /Count {n} >>")
    for i in range(n):
        links = (f"/Prev {first + i - 1} 0 R " if i else "") + (f"/Next {first + i + 1} 0 R " if i + 1 < n else "")
        parts.append(f"<< /Title (t{i}) /Parent {3 + n} 0 R {links}/Dest [{3 + i} 0 R /Fit] >>")
    out, places = "%PDF-1.4\n", []
    for k, part in enumerate(parts):
        places.append(len(out))
        out += f"{k + 1} 0 obj\n{part}\nendobj\n"
    rows = "".join(f"{p:010d} 00000 n \n" for p in places)
    return f"{out}xref\n0 {len(parts) + 1}\n0000000000 65535 f \n{rows}trailer\n<< /Size {len(parts) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


@query("WITH " + ORDERS + "SELECT path, n AS page_count, CAST(CASE WHEN c % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c % 3 = 0 THEN n ELSE 0 END + CASE WHEN c % 5 = 0 AND n > 1 THEN 1 ELSE 0 END AS BIGINT) AS repaired_objects, CAST(0 AS BIGINT) AS problems FROM o WHERE i = 0")
def pdf_repairs(spark, sf_dir):
    """PDFs whose faults have one right answer, repaired by an update and checked again."""
    made = documents.to_pdf(_built(spark, sf_dir, _faulty)).filter("error is null").select("path", "page_count", "repaired_objects", F.col("pdf").alias("content"))
    return documents.problem_counts(made, more=["page_count", "repaired_objects"])


# Reports, errors, detection, functions


@query("WITH " + ORDERS + """, f AS (SELECT path, n, c FROM o WHERE i = 0)
    SELECT path, 'CAJ' AS format, NULL AS variant, n AS page_count, true AS has_outline, n AS bookmark_count FROM f UNION ALL SELECT path, 'KDH', NULL, n, false, NULL FROM f
    UNION ALL SELECT path, 'C8', 'C8', n, NULL, NULL FROM f UNION ALL SELECT path, 'HN', 'HN-A', n, max(st <> 'P'), count(*) FILTER (WHERE st <> 'P') FROM o GROUP BY path, n""")  # fmt: skip
def document_info(spark, sf_dir):
    """What is known of documents of several formats without converting them."""
    files = [_built(spark, sf_dir, make) for make in (_caj, _c8, _hn, lambda c, orders: build.kdh(_pdf(c, orders)))]
    every = files[0].union(files[1]).union(files[2]).union(files[3])
    return documents.document_info(every).filter("error is null").select("path", "format", "variant", "page_count", "has_outline", "bookmark_count")


@query("WITH " + ORDERS + """SELECT path, '{"schema_version":1,"format":"CAJ","variant":null,"conversion_supported":true,"page_count":' || n || ',"has_outline":true,"bookmark_count":' || n || ',"outline_warnings":0}' AS json,
    'Format: CAJ' || chr(10) || 'Conversion: supported' || chr(10) || 'Pages: ' || n || chr(10) || 'Outline: yes' || chr(10) || 'Bookmarks: ' || n || chr(10) AS text FROM o WHERE i = 0""")  # fmt: skip
def document_reports(spark, sf_dir):
    """Reports on CAJ documents as JSON and as text."""
    return reports.inspections(_built(spark, sf_dir, _caj)).filter("error is null").select("path", "json", "text")


def _broken(c: int, orders: list[dict]) -> bytes:
    whole = bytearray(_caj(1, orders))
    kind = c % 5
    if kind == 0:
        return bytes(whole[:3])
    if kind == 1:
        struct.pack_into("<i", whole, 0x10, 0)
    if kind == 2:
        struct.pack_into("<i", whole, 0x110, -1)
    if kind == 3:
        struct.pack_into("<i", whole, 0x114 + 304, 2)
    if kind == 4:
        struct.pack_into("<I", whole, 0x114 + 308 * len(orders) + 8, 0)
    return bytes(whole)


@query("WITH " + ORDERS + """SELECT path, CASE c % 5 WHEN 0 THEN 'Truncated' ELSE 'Malformed' END AS kind, CAST(CASE c % 5 WHEN 0 THEN 3 ELSE 13 END AS INTEGER) AS code,
    CAST(CASE c % 5 WHEN 0 THEN 0 WHEN 1 THEN 16 WHEN 2 THEN 272 WHEN 3 THEN 580 ELSE 276 + 308 * n + 8 END AS BIGINT) AS "offset",
    CASE c % 5 WHEN 0 THEN 'truncated CAJ at byte 0: expected 4 bytes, available 3' WHEN 1 THEN 'malformed CAJ at byte 16: CAJ page count must be positive' WHEN 2 THEN 'malformed CAJ at byte 272: CAJ TOC count is negative'
      WHEN 3 THEN 'malformed CAJ at byte 580, record 1: CAJ TOC level skips a parent' ELSE 'malformed CAJ at byte ' || (276 + 308 * n + 8) || ', record 1: CAJ page object number must be positive' END AS message FROM o WHERE i = 0""")  # fmt: skip
def located_errors(spark, sf_dir):
    """Errors of broken documents with kind, code, byte and record; both tables tell the same."""
    files = _built(spark, sf_dir, _broken)
    return documents.errors(documents.caj_pages(files), documents.bookmarks(files)).select("path", "kind", "code", "offset", "message")


#: Beginnings of files by remainder, with the format they show and where it begins.
STARTS = [("%PDF-1.7", "PDF", 0), ("CAJ", "CAJ", 0), ("KDH 2.00", "KDH", 0), ("HN", "HN", 0), ("TEB", "TEB", 0), ("  %PDF-", "PDF", 2), (" CAJ", None, None), ("%PDF", None, None)]
_PADDED = "repeat(' ', CAST(doc_id % 30 + 1000 AS INTEGER)) || '%PDF-'"


@query(
    "SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN {repr(f) if f else 'NULL'}" for k, (_, f, _) in enumerate(STARTS)) + " ELSE CASE WHEN doc_id % 30 < 20 THEN 'PDF' END END AS format, CAST(CASE doc_id % 9 "
    + " ".join(f"WHEN {k} THEN {'NULL' if at is None else at}" for k, (_, _, at) in enumerate(STARTS)) + " ELSE CASE WHEN doc_id % 30 < 20 THEN doc_id % 30 + 1000 END END AS BIGINT) AS header_offset, coalesce(CASE doc_id % 9 "
    + " ".join(f"WHEN {k} THEN {str(f in ('PDF', 'CAJ', 'KDH', 'HN')).lower()}" for k, (_, f, _) in enumerate(STARTS)) + " ELSE doc_id % 30 < 20 END, false) AS convertible FROM documents"
)
def detections(spark, sf_dir):
    """Formats by signature: at the start, or a PDF marker within the first 1,024 bytes."""
    start = F.lit(None).cast("string")
    for k, (text, _, _) in enumerate(STARTS):
        start = F.when(F.col("doc_id") % 9 == k, text).otherwise(start)
    whole = F.concat(F.coalesce(start, F.expr(_PADDED)), F.lit(" "), F.coalesce("text", F.lit("")))
    files = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(whole, "UTF-8").alias("content"))
    return documents.detections(files).select(F.col("path").cast("long").alias("doc_id"), "format", "header_offset", "convertible")


@query("""WITH h AS (SELECT *, upper(md5(c_name)) AS h FROM customer), v AS (SELECT *, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS u, CAST('0x' || substr(h, 31, 2) || substr(h, 29, 2) AS BIGINT) AS w FROM h)
    SELECT c_custkey, u AS word, CASE WHEN w >= 32768 THEN w - 65536 ELSE w END AS half, CAST(NULL AS BIGINT) AS past, 'FEFF' || regexp_replace(upper(hex(encode(c_name))), '(..)', '00\\1', 'g') AS title,
      round((CAST(c_custkey % 1000 + 1 AS DOUBLE)) * (CAST(72 AS DOUBLE) / 742), 6) AS width, round(1484 * (CAST(72 AS DOUBLE) / 742) - 20 * (CAST(72 AS DOUBLE) / 742), 6) AS top FROM v""")  # fmt: skip
def binary_fields(spark, sf_dir):
    """Little-endian fields, text strings and places, as columns without leaving the JVM."""
    rows = _table(spark, sf_dir, "customer").withColumn("content", F.unhex(F.md5("c_name")))
    box = binary.page_box(F.col("c_custkey") % 1000 + 1, F.lit(1484))
    matrix = binary.image_matrix(box, F.lit(0), F.lit(20), F.lit(100), F.lit(50), F.lit(2))
    c = F.col("content")
    return rows.select("c_custkey", binary.unsigned(c, 0, 4).alias("word"), binary.signed(c, 14, 2).alias("half"), binary.unsigned(c, 15, 2).alias("past"), binary.utf16_hex(F.col("c_name")).alias("title"), F.round(box[2], 6).alias("width"), F.round(matrix[5], 6).alias("top"))


# Bilevel images


def _pictures(name: str) -> bytes:
    """Three images of 32 by 4 pixels, which are the bits of the name's MD5: coded by rows, as one region, and with a bar as symbol over it."""
    import hashlib

    bits = [[b >> (7 - k) & 1 for b in hashlib.md5(name.encode()).digest()[4 * y : 4 * y + 4] for k in range(8)] for y in range(4)]
    bar = [[1] * 8, [1] * 8]
    info = build.segment(0, 48, data=struct.pack(">II", 32, 4) + bytes(11))
    region = encoders.generic_region(bits)
    symbols = [encoders.direct_dictionary([[[1, 0] * 4, [0, 1] * 4]]), encoders.refined_dictionary([[[1, 0] * 4, [0, 1] * 4]], bar, 0, 0, 0), encoders.text_region(32, 4, [(0, 0, [(0, 0, 0)])]), region]
    parts = zip([(1, 0, ()), (2, 0, (1,)), (3, 6, (2,)), (4, 38, ())], symbols, strict=True)
    images = [(0, build.bitmap(32, 4) + encoders.type0_body(bits)), (3, build.bitmap(32, 4) + info + build.segment(1, 38, data=region)), (3, build.bitmap(32, 4) + info + b"".join(build.segment(n, k, r, d) for (n, k, r), d in parts))]
    return build.c8([build.image_text((0, 0, 100, 50))], images)


def _picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([_pictures(x) for x in names], pa.binary())], ["path", "content"])

    return _table(spark, sf_dir, "supplier").select("s_name").mapInArrow(run, "path string, content binary")


@query("""WITH h AS (SELECT s_name AS path, md5(s_name) AS h FROM supplier)
    SELECT path, CAST(j AS BIGINT) AS image, CASE WHEN j < 3 THEN h ELSE 'ff' || substr(h, 3, 6) || 'ff' || substr(h, 11) END AS rows FROM h, (VALUES (1), (2), (3)) v(j)""")
def decoded_images(spark, sf_dir):
    """Pixels of bilevel images: rows in QM code, a JBIG2 region, and symbols, refined and placed, under a region."""
    return documents.decoded_images(_picture_files(spark, sf_dir)).filter("problem is null").select("path", "image", F.lower(F.hex("rows")).alias("rows"))


@query("SELECT s_name AS path, CAST(j AS BIGINT) AS image, CASE j WHEN 2 THEN 'generic' WHEN 3 THEN 'symbols' END AS profile, CAST(32 AS BIGINT) AS width, CAST(4 AS BIGINT) AS stride FROM supplier, (VALUES (1), (2), (3)) v(j)")
def bilevel_profiles(spark, sf_dir):
    """Size and segment profile of bilevel images, without decoding them."""
    return documents.bilevel_images(_picture_files(spark, sf_dir)).filter("error is null and problem is null").select("path", "image", "profile", "width", "stride")


@query("""WITH s(number, name, refers) AS (VALUES (0, 48, ''), (1, 0, ''), (2, 0, '1'), (3, 6, '2'), (4, 38, '')) SELECT s_name AS path, CAST(number AS BIGINT) AS number, CAST(name AS BIGINT) AS type, refers FROM supplier, s""")
def jbig2_segments(spark, sf_dir):
    """Segments of images with symbols, and the segments they refer to."""
    found = documents.jbig2_segments(_picture_files(spark, sf_dir)).filter("error is null and image = 3")
    return found.select("path", "number", "type", F.array_join(F.transform("referred_to", lambda x: x.cast("string")), ",").alias("refers"))


# Fonts


def _font(c: int, orders: list[dict]) -> bytes:
    """A collection of two faces: a glyph for each order under the character 0x4E00 + its place; faults in the second."""
    widths = [0, *(200 + order["o_orderkey"] % 500 for order in orders)]
    runs = [(0x4E00 + i, 0x4E00 + i, i + 1) for i in range(len(orders))]
    second = build.font(widths, runs, units=2048, licence=2 * (c % 2), kind=12, change={"post": None} if c % 5 == 0 else {})
    return build.collection(build.font(widths, runs, licence=0x100 * (c % 3 == 0)), second)


@query("WITH " + ORDERS + """SELECT path, CAST(i AS INTEGER) + 19968 AS character, CAST(i AS INTEGER) + 1 AS glyph, CAST(200 + k % 500 AS INTEGER) AS advance, f AS face
    FROM o, (VALUES (0), (1)) v(f) WHERE f = 0 OR c % 5 <> 0""")
def font_characters(spark, sf_dir):
    """Characters, glyphs and widths of both faces of collections, by maps of segments and of groups."""
    return fonts.font_characters(_built(spark, sf_dir, _font)).filter("error is null").drop("error")


@query("WITH " + ORDERS + """SELECT path, f AS face, CASE WHEN f = 0 THEN 1000 WHEN c % 5 <> 0 THEN 2048 END AS units_per_em, CASE WHEN f = 0 OR c % 5 <> 0 THEN CAST(n AS INTEGER) + 1 END AS glyphs,
    CASE WHEN f = 0 THEN c % 3 <> 0 WHEN c % 5 <> 0 THEN c % 2 = 0 END AS embeddable, CASE WHEN f = 1 AND c % 5 = 0 THEN 'table is missing: post' END AS error FROM o, (VALUES (0), (1)) v(f) WHERE i = 0""")
def font_faces(spark, sf_dir):
    """Faces of collections and what their licences allow; a face without a table is an error, its neighbour is read."""
    return fonts.font_faces(_built(spark, sf_dir, _font)).select("path", "face", "units_per_em", "glyphs", "embeddable", F.col("error.reason").alias("error"))
