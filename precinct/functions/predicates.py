"""Boolean column expressions used by filters and quality rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from precinct.schema import MISSING, WHITE_SPACE

TRUE_TEXT = ("true", "1", "1.0")
FALSE_TEXT = ("false", "0", "0.0")


def out_of_range(col: Column, low, high) -> Column:
    """``col < low OR col > high``; NULL is not out of range."""
    return F.coalesce((col < F.lit(low)) | (col > F.lit(high)), F.lit(False))


def between(col: Column, low, high) -> Column:
    return col.between(F.lit(low), F.lit(high))


def coordinate_missing(lat: Column, lon: Column) -> Column:
    return lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon)


def in_window(ts: Column, low: str | None, high: str | None) -> Column:
    """Half-open window ``[low, high)`` on a wall-clock timestamp; a bound may be None."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (ts >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        keep = keep & (ts < F.lit(high).cast("timestamp_ntz"))
    return keep


def blank_or_null(col: Column) -> Column:
    return col.isNull() | (F.btrim(col, F.lit(WHITE_SPACE)) == "")


def is_finite(col: Column) -> Column:
    """False for NaN and for both infinities; NULL stays NULL."""
    bound = F.lit(float("inf"))
    return (col > -bound) & (col < bound)


def is_infinite(col: Column) -> Column:
    bound = F.lit(float("inf"))
    return F.coalesce((col == bound) | (col == -bound), F.lit(False))


def missing_label(col: Column, label: str = MISSING) -> Column:
    """Text form of a grouping column with an explicit group for NULL."""
    return F.coalesce(col.cast("string"), F.lit(label))


def parse_bool(col: Column) -> Column:
    """True for true / 1 / 1.0 in any case; everything else, NULL included, is False."""
    return F.coalesce(F.lower(F.btrim(col.cast("string"), F.lit(WHITE_SPACE))).isin(*TRUE_TEXT), F.lit(False))


def case(branches: list[tuple[Column, object]], default) -> Column:
    """First matching branch wins; ``default`` when none does."""
    (first, value), *rest = branches
    chain = F.when(first, value)
    for condition, result in rest:
        chain = chain.when(condition, result)
    return chain.otherwise(default)
