"""String helpers with the word / paste semantics the review relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reefline.fixed_values import NA_TEXT


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word(c, n: int, sep: str = " ") -> Column:
    """n-th (1-based) token split on a single separator; empty tokens count.

    Missing when the text has fewer tokens (``get`` does not throw, unlike ``[]``).
    """
    pattern = "\\Q" + sep + "\\E"
    return F.get(F.split(_col(c), pattern), n - 1)


def paste(*cols, sep: str = "_", na_text: str = NA_TEXT) -> Column:
    """Join values, printing a missing value as ``'NA'``."""
    return F.concat_ws(sep, *[F.coalesce(_col(c), F.lit(na_text)) for c in cols])


def genus_of(species) -> Column:
    return word(species, 1)


def binomial(species) -> Column:
    """``Genus_species`` from the first two words (``NA`` text when missing)."""
    return paste(word(species, 1), word(species, 2))


def chartr(c, old: str, new: str) -> Column:
    return F.translate(_col(c), old, new)


def fill_missing(c, text: str = NA_TEXT) -> Column:
    return F.coalesce(_col(c), F.lit(text))


def missing_if(c, text: str = NA_TEXT) -> Column:
    return F.nullif(_col(c), F.lit(text))
