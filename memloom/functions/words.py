"""Words as Column expressions: longest runs of letters and digits, in lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words of a text in order; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    """The words of a text as 64-bit hashes, so that Arrow hands numbers, not strings, to vectorised steps."""
    return F.transform(words(text), lambda w: F.xxhash64(w))
