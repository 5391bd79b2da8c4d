"""Column builders (JVM expressions, no Python UDFs)."""

from reefline.functions.lookup import canonical, classify, convert, literal_map, lookup
from reefline.functions.numeric import as_number, ceil_double, rescale, safe_div
from reefline.functions.predicates import (censor, contains_any, in_range, is_in, ne_all, nonnegative,
                                           not_contains, not_in)
from reefline.functions.text import binomial, chartr, fill_missing, genus_of, missing_if, paste, word

__all__ = [
    "as_number", "binomial", "canonical", "censor", "ceil_double", "chartr", "classify", "contains_any",
    "convert", "fill_missing", "genus_of", "in_range", "is_in", "literal_map", "lookup", "missing_if",
    "ne_all", "nonnegative", "not_contains", "not_in", "paste", "rescale", "safe_div", "word",
]
