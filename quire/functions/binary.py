"""Column functions on binary content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

from quire.formats import kdh, text


def unsigned(content: Column, offset: int, width: int) -> Column:
    """A little-endian unsigned field of up to seven bytes, without leaving the JVM; null past the end."""
    octet = lambda k: F.conv(F.hex(F.substring(content, offset + k + 1, 1)), 16, 10).cast("long")
    value = sum((octet(k) * (1 << 8 * k) for k in range(1, width)), octet(0))
    return F.when(F.octet_length(content) >= offset + width, value)


def signed(content: Column, offset: int, width: int) -> Column:
    value, size = unsigned(content, offset, width), 1 << 8 * width
    return F.when(value >= size // 2, value - size).otherwise(value)


@pandas_udf(StringType())
def gb18030(raw: pd.Series) -> pd.Series:
    """Strict GB18030; null for invalid bytes."""
    return raw.map(lambda x: None if x is None or isinstance(out := text.gb18030(bytes(x)), int) else out)


@pandas_udf(StringType())
def printable(value: pd.Series) -> pd.Series:
    return value.map(lambda x: None if x is None else text.printable(x))


@pandas_udf(StringType())
def signature_text(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else text.signature_text(bytes(x)))


@pandas_udf(BinaryType())
def kdh_unmask(raw: pd.Series) -> pd.Series:
    """The bytes after a KDH header without their key."""
    return raw.map(lambda x: None if x is None else kdh.unmask(bytes(x)))


def utf16_hex(title: Column) -> Column:
    """A PDF text string in hex."""
    return F.concat(F.lit("FEFF"), F.hex(F.encode(title, "UTF-16BE")))


#: Fixed value: points of one container unit, and of a pixel at 300 per inch.
UNIT_POINTS, PIXEL_POINTS = 72 / 742, 72 / 300


def page_box(width: Column, height: Column, native_mode: Column | None = None) -> Column:
    """Page size in points from container units; mode 0 adds ten points to either side; null if a side is zero."""
    more = F.when(native_mode == 0, 10.0).otherwise(0.0) if native_mode is not None else F.lit(0.0)
    return F.when((width > 0) & (height > 0), F.array(F.lit(0.0), F.lit(0.0), width * UNIT_POINTS + more, height * UNIT_POINTS + more))


def image_matrix(box: Column, x: Column, y: Column, width: Column, height: Column, record_type: Column) -> Column:
    """The matrix that places an image; all but type 2 start at the lower edge and grow upward."""
    w, h = width * UNIT_POINTS, height * UNIT_POINTS
    left, top = box[0] + x * UNIT_POINTS, box[3] - y * UNIT_POINTS
    return F.when(record_type == 2, F.array(w, F.lit(0.0), F.lit(0.0), -h, left, top)).otherwise(F.array(w, F.lit(0.0), F.lit(0.0), h, left, top - h))
