"""Documents built from the layouts of the formats: input for tests, benchmarks and the container queries."""

import struct
import zlib


def toc(title, page, level):
    raw = bytearray(308)
    name = title.encode("gb18030") if isinstance(title, str) else title
    raw[: len(name)] = name
    raw[280 : 280 + len(page)] = page
    raw[304:308] = struct.pack("<i", level)
    return bytes(raw)


def caj(entries=(("标题", b"1", 1),), rows=((0, 40, 5), (40, 20, 9)), pages=None):
    head = bytearray(0x114)
    head[:4] = b"CAJ\0"
    outline = b"".join(toc(*e) for e in entries)
    table = 0x114 + len(outline)
    body = table + 12 * len(rows)
    struct.pack_into("<iI", head, 0x10, len(rows) if pages is None else pages, table)
    struct.pack_into("<i", head, 0x110, len(entries))
    return bytes(head) + outline + b"".join(struct.pack("<III", body + o, n, k) for o, n, k in rows) + b"x" * max(o + n for o, n, _ in rows)


def caj_body(pages, objects, entries=()):
    """A document of PDF objects (number, text or bytes); ``pages`` are the numbers in the page table."""
    body = b"".join(f"{n} 0 obj\n".encode() + (t if isinstance(t, bytes) else t.encode()) + b"\nendobj\n" for n, t in objects)
    head = bytearray(0x114)
    head[:4] = b"CAJ\0"
    outline = b"".join(toc(*e) for e in entries)
    table = 0x114 + len(outline)
    start = table + 12 * len(pages)
    struct.pack_into("<iI", head, 0x10, len(pages), table)
    struct.pack_into("<i", head, 0x110, len(entries))
    cut = [start] + [start] * (len(pages) - 1) + [start + len(body)]
    return bytes(head) + outline + b"".join(struct.pack("<III", a, b - a, n) for a, b, n in zip(cut, cut[1:], pages, strict=False)) + body


def hn_a(entries, pages=2):
    head = bytearray(0x15C)
    head[:8] = b"HN\0\0\x90\x01\0\0"
    struct.pack_into("<i", head, 0x90, pages)
    struct.pack_into("<HH", head, 0x90 + 24, 100, 200)
    struct.pack_into("<i", head, 0x158, len(entries))
    outline = b"".join(toc(*e) for e in entries)
    index = 0x15C + len(outline)
    end = index + 20 * pages
    return bytes(head) + outline + b"".join(struct.pack("<iih", end, 0, 0) + bytes(10) for _ in range(pages))


def c8(texts, images=(), package=None, mode=2):
    """One page for each text; ``images`` (type, payload) belong to the first page."""
    head = bytearray(0x50)
    head[:4] = b"\xc8\0\0\0"
    struct.pack_into("<i", head, 8, len(texts))
    struct.pack_into("<I", head, 12, mode)
    struct.pack_into("<HH", head, 32, 742, 1484)
    at, rows, body = 0x50 + 20 * len(texts), b"", b""
    for k, text in enumerate(texts):
        own = list(images) if k == 0 else []
        rows += struct.pack("<iih", at + len(body), len(text), len(own)) + bytes(10)
        body += text
        for kind, payload in own:
            body += struct.pack("<iii", kind, at + len(body) + 12, len(payload)) + payload
    out = bytes(head) + rows + body
    if package is not None:
        packed = zlib.compress(package)
        out += struct.pack("<II", len(package), len(packed)) + packed + b"APPINFOSIGN " + str(len(out)).encode()
    return out


def compressed(text, legacy=False):
    frame = b"COMPRESSTEXT" + struct.pack("<I", len(text)) + zlib.compress(text)
    return (b"\x03\x80\1\0\x03\x80\2\0" if legacy else b"") + frame


def pdf(pages=2, extra=b""):
    kids = " ".join(f"{3 + k} 0 R" for k in range(pages))
    parts = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {pages} /MediaBox [0 0 612 792] >>"]
    parts += ["<< /Type /Page /Parent 2 0 R >>"] * pages
    out, offsets = b"%PDF-1.4\n", []
    for k, part in enumerate(parts):
        offsets.append(len(out))
        out += f"{k + 1} 0 obj\n{part}\nendobj\n".encode()
    table = len(out)
    out += f"xref\n0 {len(parts) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{o:010d} 00000 n \n".encode() for o in offsets)
    return out + f"trailer\n<< /Size {len(parts) + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF\n".encode() + extra


def kdh(body, version=b"\0\0\x02\0"):
    head = bytearray(254)
    head[:32] = b"KDH 2.00 Copyright(C) 2000 CAJCD"
    head[0x28:0x2C] = version
    key = b"FZHMEI"
    return bytes(head) + bytes(b ^ key[k % 6] for k, b in enumerate(body))


def jpeg(width=16, height=8, gray=True, extra=b"", tail=b""):
    """A file with the structure of a baseline JPEG; its scan is not meant to be decoded."""
    n = 1 if gray else 3
    segment = lambda kind, body: bytes([255, kind]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xDB, b"\0" + bytes(64)) + extra
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n)))
    out += segment(0xC4, b"\0" + bytes([1]) + bytes(15) + b"\0") + segment(0xC4, b"\x10" + bytes([1]) + bytes(15) + b"\0")
    return out + segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0") + b"\x12\xff\0\x34" + b"\xff\xd9" + tail


def image_text(*places):
    """Compressed page text that ends with an image record for each place (x, y, width, height)."""
    return compressed(b"\x10\x20\xa1\xb0" + b"".join(b"\x0a\x80\0\xd3" + struct.pack("<HHHH", *p) + bytes(16) for p in places) + b"\x04\x80\0\0")


def bitmap(width=33, height=4, palette=b"\xff\xff\xff\0\0\0\0\0"):
    return struct.pack("<IiiHHIIiiII", 40, width, height, 1, 1, 0, 0, 0, 0, 2, 0) + palette


def segment(number, kind, referred=(), data=b"", page=1):
    return struct.pack(">IBB", number, kind, len(referred) << 5) + bytes(referred) + bytes([page]) + struct.pack(">I", len(data)) + data


def symbols_image(width=33, height=4):
    info = struct.pack(">II", width, height) + bytes(11)
    return bitmap() + segment(0, 48, data=info) + segment(1, 0) + segment(2, 0, [1], b"ab") + segment(3, 6, [2], b"c") + segment(4, 38)


def _checksum(raw):
    raw += bytes(-len(raw) % 4)
    return sum(struct.unpack(f">{len(raw) // 4}I", raw)) & 0xFFFFFFFF


def character_map(runs, kind=4):
    """A cmap of Unicode; ``runs`` are (first, last, first glyph), rising."""
    if kind == 12:
        groups = b"".join(struct.pack(">III", *r) for r in runs)
        body = struct.pack(">HHIII", 12, 0, 16 + len(groups), 0, len(runs)) + groups
    else:
        rows = [*((a, b, (g - a) & 0xFFFF) for a, b, g in runs), (0xFFFF, 0xFFFF, 1)]
        column = lambda values: struct.pack(f">{len(rows)}H", *values)
        lists = column(r[1] for r in rows) + b"\0\0" + column(r[0] for r in rows) + column(r[2] for r in rows) + column(0 for _ in rows)
        body = struct.pack(">HHHHHHH", 4, 14 + len(lists), 0, 2 * len(rows), 0, 0, 0) + lists
    return struct.pack(">HHHHI", 0, 1, 3, 10 if kind == 12 else 1, 12) + body


def font(widths, runs, units=1000, licence=0, kind=4, change=()):
    """A font whose glyphs have the widths given and no outlines; ``change`` replaces tables, or takes them away (None)."""
    head = bytearray(54)
    struct.pack_into(">I", head, 8, 0xB1B0AFBA)
    struct.pack_into(">H", head, 18, units)
    tables = {
        "OS/2": struct.pack(">HhHHH", 4, 500, 400, 5, licence) + bytes(86),
        "cmap": character_map(runs, kind),
        "glyf": b"\0\0\0\0",
        "head": bytes(head),
        "hhea": bytes(34) + struct.pack(">H", len(widths)),
        "hmtx": b"".join(struct.pack(">Hh", w, 0) for w in widths),
        "loca": bytes(2 * len(widths) + 2),
        "maxp": struct.pack(">IH", 0x00010000, len(widths)) + bytes(26),
        "name": struct.pack(">HHH", 0, 0, 6),
        "post": struct.pack(">I", 0x00030000) + bytes(28),
    } | dict(change)
    tables = sorted((t, raw) for t, raw in tables.items() if raw is not None)
    at, directory, body = 12 + 16 * len(tables), b"", b""
    for tag, raw in tables:
        directory += tag.encode() + struct.pack(">III", _checksum(raw), at + len(body), len(raw))
        body += raw + bytes(-len(raw) % 4)
    return b"\0\1\0\0" + struct.pack(">HHHH", len(tables), 0, 0, 0) + directory + body


def collection(*fonts):
    """Fonts as the faces of one file."""
    at, places, out = 12 + 4 * len(fonts), [], b""
    for raw in fonts:
        places.append(at + len(out))
        moved = bytearray(raw)
        for row in range(12, 12 + 16 * struct.unpack_from(">H", raw, 4)[0], 16):
            struct.pack_into(">I", moved, row + 8, struct.unpack_from(">I", raw, row + 8)[0] + at + len(out))
        out += moved
    return b"ttcf\0\1\0\0" + struct.pack(f">I{len(fonts)}I", len(fonts), *places) + out
