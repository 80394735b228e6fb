"""Scalar column expressions."""
from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F

from precinct.schema import UNKNOWN, WHITE_SPACE


def strip(col: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def not_nan(col: Column) -> Column:
    """The number, or NULL for NaN."""
    return F.when(~F.isnan(col), col)


def norm_text(col: Column, upper: bool = True) -> Column:
    trimmed = strip(col)
    return F.upper(trimmed) if upper else F.lower(trimmed)


def title(col: Column) -> Column:
    return F.initcap(F.lower(col))


def zero_pad(col: Column, width: int = 2) -> Column:
    return F.lpad(col.cast("string"), width, "0")


def prefix(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def fmt_count(col: Column) -> Column:
    """Thousands separators."""
    return F.format_number(col, 0)


def fmt_pct(share: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100.0)


def mix_key(*cols: Column, sep: str = "|") -> Column:
    return F.concat_ws(sep, *cols)


def weekday0(ts: Column) -> Column:
    """Weekday with Monday = 0."""
    return F.weekday(ts)


def to_day(ts: Column) -> Column:
    return F.to_date(ts)


def cyclic(col: Column, period: int, offset: int = 0) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle of ``period`` steps."""
    angle = (col - F.lit(offset)).cast("double") * F.lit(2.0 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def bin_floor(col: Column, width: float) -> Column:
    return F.floor(col / F.lit(float(width))).cast("long")


def bin_centre(bin_col: Column, width: float) -> Column:
    return (bin_col + F.lit(0.5)) * F.lit(float(width))


def grid_cell(lat: Column, lon: Column) -> Column:
    """Cell of 0.005 x 0.006 degrees on coordinates rounded to 3 places.

    Works on thousandths as whole numbers, so a coordinate on a cell edge always
    falls into the cell it opens.  Missing coordinates form their own cell.
    """
    row = F.floor(F.round(lat * 1000.0) / 5.0).cast("long").cast("string")
    column = F.floor(F.round(lon * 1000.0) / 6.0).cast("long").cast("string")
    return F.coalesce(F.concat(row, F.lit("_"), column), F.lit(UNKNOWN))


def hour_block(ts: Column, hours: int = 6) -> Column:
    return F.floor(F.hour(ts) / F.lit(hours)).cast("int")


def log1p(col: Column) -> Column:
    return F.log1p(col)


def rot45(lat: Column, lon: Column) -> tuple[Column, Column]:
    return lat + lon, lat - lon


def code_text(col: Column) -> Column:
    """Whole-number code as text; unparsable or missing becomes ``Unknown``."""
    return F.coalesce(col.try_cast("double").try_cast("long").cast("string"), F.lit(UNKNOWN))


def argmax(array: Column) -> Column:
    """Zero-based position of the first largest element."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def vector_size(col: Column) -> Column:
    return F.size(vector_to_array(col))


def row_text(*cols: Column, sep: str = "|") -> Column:
    """One text per row with an explicit mark for NULL (so shifted NULLs differ)."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])


def hex_number(text: Column, digits: int) -> Column:
    """Leading hex digits of the md5 of a text as a whole number (at most 15 digits)."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def row_hash(*cols: Column) -> Column:
    """60-bit hash of a row that other engines can reproduce."""
    return hex_number(row_text(*cols), 15)


def fingerprint(*cols: Column) -> Column:
    """128 bits of a row as a struct of two hashes; NULL is a value of its own, as in grouping."""
    marked = [c for col in cols for c in (col.isNull(), col)]
    return F.struct(F.xxhash64(F.lit(1), *marked).alias("h1"), F.xxhash64(F.lit(2), *reversed(marked)).alias("h2"))


def fold_of(id_col: Column, folds: int) -> Column:
    """Deterministic fold of a record from the hash of its id."""
    return (hex_number(id_col.cast("string"), 8) % F.lit(folds)).cast("int")
