"""Fonts as tables: faces, their tables and their character maps, and characters that no font has.

Files are rows (path, content) of fonts or collections; a face that cannot be read gives a
row with its error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.formats import opentype
from quire.formats.errors import Limits
from quire.operators.documents import each_document, error_row


def _each_face(files: DataFrame, kernel: Callable[[bytes, int], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of ``kernel`` for each face of each file; one damaged face does not hide the others."""

    def every(data):
        for k, at in enumerate(opentype.faces(data)):
            try:
                for row in kernel(data, at):
                    yield {"face": k} | row
            except Exception as error:
                yield error_row(error) | {"face": k}

    return each_document(files, every, f"face int, {schema}")


def font_faces(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``path, face, units_per_em, glyphs, outlines, embeddable, adjustment, error``, a row for each face."""

    def kernel(data, at):
        f = opentype.Face(data, at, limits)
        yield {"units_per_em": f.units_per_em, "glyphs": f.glyphs, "outlines": f.outlines, "embeddable": f.embeddable, "adjustment": f.adjustment}

    return _each_face(files, kernel, "units_per_em int, glyphs int, outlines string, embeddable boolean, adjustment long")


def font_tables(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``path, face, tag, checksum, offset, length, error``, a row for each table of each face."""

    def kernel(data, at):
        for tag, (checksum, offset, length) in opentype.Face(data, at, limits).tables.items():
            yield {"tag": tag, "checksum": checksum, "offset": offset, "length": length}

    return _each_face(files, kernel, "tag string, checksum long, offset long, length long")


def font_characters(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``path, face, character, glyph, advance, error``: the best character map of each face; advances in units of the face."""

    def kernel(data, at):
        f = opentype.Face(data, at, limits)
        for code, glyph in f.mappings():
            yield {"character": code, "glyph": glyph, "advance": f.width(glyph)}

    return _each_face(files, kernel, "character int, glyph int, advance int")


def glyph_lookup(text: DataFrame, characters: DataFrame) -> DataFrame:
    """``text`` (with columns font, character) with the glyph and advance of that font's first face; null where it has none."""
    known = characters.filter("error is null and face = 0").select(F.col("path").alias("font"), "character", "glyph", "advance")
    return text.join(known, ["font", "character"], "left")


def verified(files: DataFrame, pack: DataFrame) -> DataFrame:
    """``path, status``: whether files match the sizes and SHA-256 of ``pack`` (path, size, sha256).

    ok, size, digest, absent (only in the pack) or unknown (only among the files).
    """
    have = files.select("path", F.octet_length("content").alias("_size"), F.sha2("content", 256).alias("_sha"))
    listed = pack.select("path", F.col("size").alias("_want"), F.lower("sha256").alias("_digest"), F.lit(True).alias("_listed"))
    status = F.when(F.col("_listed").isNull(), "unknown").when(F.col("_sha").isNull(), "absent").when(~F.col("_size").eqNullSafe(F.col("_want")), "size").when(~F.col("_sha").eqNullSafe(F.col("_digest")), "digest").otherwise("ok")
    return have.join(listed, "path", "full").select("path", status.alias("status"))
