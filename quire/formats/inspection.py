"""What is known of one document without converting it, as one value, as JSON and as text."""

from __future__ import annotations

import json
import re

from quire.formats import caj, kdh, package, paged, pdf, records
from quire.formats.errors import FormatError, Limits
from quire.formats.text import printable, signature_text

#: Reasons why a known format is not converted; how the text report puts it.
NOT_CONVERTED = {"CAA": "target-descriptor", "TEB": "not-implemented"}
SUPPORT = {"CAA": "not supported (target descriptor; obtain the referenced document)", "TEB": "not supported", "HN": "experimental", "C8": "experimental"}
YES_NO = {True: "yes", False: "no", None: "unknown"}
_TAIL = re.compile(rb"APPINFOSIGN (\d+)$")


def tree(bookmarks: list[tuple[int, str, int]]) -> list[dict]:
    """Bookmarks (depth, title, page index) below each other; a depth that skips a level joins the deepest open one."""
    root: list[dict] = []
    open_ = [root]
    for depth, title, page in bookmarks:
        del open_[min(depth, len(open_) - 1) + 1 :]
        open_[-1].append({"title": title, "page": page + 1, "children": []})
        open_.append(open_[-1][-1]["children"])
    return root


def read(data: bytes, format_: str, limits: Limits = Limits(), *, pages: bool = False) -> dict:
    """``variant, page_count, has_outline, bookmarks, outline_warnings, application_info, structure, pages`` of a document.

    None is unknown. With ``pages``, a KDH signature that is not supported is reported, not an error.
    """
    out = dict.fromkeys(("variant", "page_count", "has_outline", "bookmarks", "outline_warnings", "application_info", "structure", "pages")) | {"format": format_}
    if format_ == "CAJ":
        found = caj.read(data, limits)
        out |= {"page_count": found["page_count"], "has_outline": bool(found["bookmarks"]), "bookmarks": found["bookmarks"], "outline_warnings": 0}
    elif format_ in ("HN", "C8"):
        box = paged.Container(data, limits)
        h = box.header
        out |= {"variant": h.variant, "page_count": h.page_count}
        if h.variant == "HN-A":
            rows = list(box.outline())
            marks = [(r["depth"], r["title"], r["page_index"]) for r in rows if r["kind"] == "bookmark"]
            out |= {"has_outline": bool(marks), "bookmarks": marks, "outline_warnings": len(rows) - len(marks)}
        found = package.read(data, limits)
        if found["status"] == "Read":
            out["application_info"] = {k: found[k] for k in ("doi", "url", "note_count")}
        if pages:
            out |= {"structure": _structure(data, h), "pages": list(page_rows(data, limits))}
    elif format_ in ("KDH", "PDF"):
        supported = data[: len(kdh.SIGNATURE)] == kdh.SIGNATURE
        if format_ == "KDH" and pages:
            out["structure"] = {"kdh_signature": signature_text(data[: len(kdh.SIGNATURE)]), "kdh_signature_supported": supported}
        if format_ == "PDF" or supported or not pages:
            index = pdf.Pdf(kdh.decode(data, limits)[0] if format_ == "KDH" else data[max(0, data.find(b"%PDF-", 0, 1024)) :], limits)
            out |= {"page_count": len(index.pages), "has_outline": index.has_outline}
    return out


def _structure(data: bytes, h: paged.Header) -> dict:
    tail = _TAIL.search(data[-64:])
    start = int(tail[1]) if tail else 0
    info = {"offset": start, "length": len(data) - start if start <= len(data) else None} if tail else None
    return {"page_index_offset": h.page_index[0], "page_index_length": h.page_index[1], "page_row_bytes": h.row_bytes, "native_mode": h.native_mode, "native_origin": h.native_origin and list(h.native_origin), "page_size": list(h.page_size), "application_info": info}


def page_rows(data: bytes, limits: Limits = Limits()):
    """A row for each page of an HN or C8 document; texts are checked record by record."""
    box = paged.Container(data, limits)
    for row in paged.probe(data, limits):
        out = {"page": row["page_number"]} | {k: row.get(k) for k in ("text_offset", "text_length", "image_count")}
        out["images"] = [{"type": i["record_type"], "offset": i["payload_offset"], "length": i["payload_length"]} for i in row.get("images", ())]
        out |= dict.fromkeys(("text_framing", "text_records", "text_decoded_length", "text_error")) | {"error": row.get("error")}
        if not out["error"]:
            try:
                page = box.page(row["page_number"])
                text = records.PageText(box, page)
                found = [r["kind"] for r in text.records()]
                places = found.count("image") + found.count("reference")
                if text.grammar not in ("none", "native") and page["image_count"] and (not places or page["image_count"] % places):
                    raise box.v.error("UnsupportedFormat", "image descriptor count is not a complete coordinate group", page["text_offset"], page=page["page_number"])
                inflated = text.framing in ("compresstext", "legacy-24")
                count = found.count("glyph") if text.grammar == "fixed" else len(found)
                out |= {"text_framing": text.framing, "text_records": count, "text_decoded_length": len(text.body) if inflated else None}
            except FormatError as error:
                out["text_error"] = str(error)
        yield out


def as_json(found: dict, *, bookmarks: bool = False, pages: bool = False) -> str:
    """Schema version 1 in its order of fields; what was not asked for or does not apply is left out."""
    marks, name = found["bookmarks"], found["format"]
    out = {"schema_version": 1, "format": name, "variant": found["variant"], "conversion_supported": name not in NOT_CONVERTED, "page_count": found["page_count"], "has_outline": found["has_outline"], "bookmark_count": None if marks is None else len(marks)}
    if bookmarks:
        out["bookmarks"] = None if marks is None else tree(marks)
    out["outline_warnings"] = found["outline_warnings"]
    if name in NOT_CONVERTED:
        out["unsupported_reason"] = NOT_CONVERTED[name]
    if found["application_info"]:
        out["application_info"] = found["application_info"]
    if pages:
        out |= {"structure": found["structure"], "pages": found["pages"]}
    text = json.dumps(out, ensure_ascii=False, separators=(",", ":"))
    return re.sub(r"\\(.)", lambda m: {"b": "\\u0008", "f": "\\u000c"}.get(m[1], m[0]), text)


def as_text(found: dict, *, bookmarks: bool = False, pages: bool = False) -> str:
    name, marks, info = found["format"], found["bookmarks"], found["application_info"]
    out = [f"Format: {name}"] + ([f"Variant: {found['variant']}"] if found["variant"] else [])
    out += [f"Conversion: {SUPPORT.get(name, 'supported')}", f"Pages: {'unknown' if found['page_count'] is None else found['page_count']}", f"Outline: {YES_NO[found['has_outline']]}"]
    if marks is not None:
        out.append(f"Bookmarks: {len(marks)}")
        out += [f"Outline warnings: {found['outline_warnings']}"] if found["outline_warnings"] else []
        out += [f"{'  ' * (depth + 1)}- {printable(title)} (page {page + 1})" for depth, title, page in marks if bookmarks]
    elif bookmarks:
        out.append(f"Bookmarks: listing is not available for {name} input")
    if info:
        out += [f"{label}: {printable(info[k])}" for label, k in (("DOI", "doi"), ("URL", "url")) if info[k]] + [f"Notes: {info['note_count']}"]
    if pages:
        out += _structure_lines(found) if found["structure"] else []
        out += [f"Page structure: not available for {name} input"] if found["pages"] is None else [_page_line(p) for p in found["pages"]]
    return "\n".join(out) + "\n"


def _structure_lines(found: dict) -> list[str]:
    s = found["structure"]
    if "kdh_signature" in s:
        return [f'KDH signature: "{s["kdh_signature"]}" ({"supported" if s["kdh_signature_supported"] else "unsupported"})']
    pair = lambda p: "unknown" if p is None else f"{p[0]} {p[1]}"
    tail = s["application_info"]
    place = "none" if tail is None else f"declared at {tail['offset']}, outside the input" if tail["length"] is None else f"{tail['length']} bytes at {tail['offset']}"
    return [f"Page index: {s['page_index_offset']}+{s['page_index_length']} ({s['page_row_bytes']}-byte rows)", f"Native mode: {'unknown' if s['native_mode'] is None else s['native_mode']}", f"Native origin: {pair(s['native_origin'])}", f"Page size: {pair(s['page_size'])}", f"Application info: {place}"]


def _page_line(p: dict) -> str:
    parts = []
    if p["text_offset"] is not None:
        images = ", ".join(f"type {i['type']} at {i['offset']}+{i['length']}" for i in p["images"])
        parts += [f"text {p['text_offset']}+{p['text_length']}", f"images [{images}]"]
    if p["text_framing"] is not None:
        inflated = "" if p["text_decoded_length"] is None else f", {p['text_decoded_length']} decoded bytes"
        parts.append(f"framing {p['text_framing']} ({p['text_records']} records{inflated})")
    parts += [f"text error: {p['text_error']}"] if p["text_error"] else []
    parts += [f"error: {p['error']}"] if p["error"] else []
    return f"Page {p['page']}: " + ", ".join(parts)
