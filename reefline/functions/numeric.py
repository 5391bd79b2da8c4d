"""Numeric helpers: guarded text-to-number, safe division, ceiling as double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number in text: optional sign, digits with optional fraction, optional
# exponent; or NaN / Inf.  ``try_cast`` alone would also accept Java suffixes
# such as ``'1d'``; the guard makes those missing.
NUMBER_PATTERN = r"^\s*[-+]?((\d+\.?\d*)|(\.\d+))([eE][-+]?\d+)?\s*$|^\s*NaN\s*$|^\s*[-+]?Inf\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_number(c) -> Column:
    """Text to double; anything that is not a number becomes NULL (never throws)."""
    txt = _col(c).cast("string")
    return F.when(txt.rlike(NUMBER_PATTERN), F.trim(txt).try_cast("double"))


def safe_div(a, b) -> Column:
    """Division that gives NULL (not an error) on a zero divisor."""
    return F.try_divide(_col(a), _col(b))


def ceil_double(c) -> Column:
    return F.ceil(_col(c)).cast("double")


def rescale(c, factor: float) -> Column:
    return _col(c) * F.lit(float(factor))
