"""Cell and header cleaning as Catalyst expressions (no Python UDFs).

Rules reproduced (see README, "Semantics"):
* the null test runs on the raw lower-cased value, before any stripping;
* camelCase boundaries get a space, then the value is stripped (all Unicode
  whitespace), lower-cased and every character that is not an ASCII letter,
  digit or whitespace becomes one space; only an empty result is null;
* numbers are recognised the way pandas' ``to_numeric`` does, not the way
  Spark's cast does (``'5d'`` and ``'NaN'`` are not numbers here).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import BINARY_WORDS, DATE_FORMATS, NULL_SPELLINGS

CAMEL_BOUNDARY = r"(?<=[a-z])(?=[A-Z])"
EDGE_SPACE = r"(?U)^\s+|\s+$"
NOT_ALNUM_SPACE = r"(?U)[^a-zA-Z0-9\s]"
ANY_SPACE_RUN = r"(?U)\s+"
NON_ALNUM = r"[^a-zA-Z0-9]"
# pandas-compatible number text: optional sign, decimal or exponent form, inf/infinity.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_unicode(c) -> Column:
    """Python ``str.strip()``: Spark's ``trim`` only removes the space character."""
    return F.regexp_replace(_c(c), EDGE_SPACE, "")


def split_camel(c) -> Column:
    return F.regexp_replace(_c(c), CAMEL_BOUNDARY, " ")


def punct_to_space(c) -> Column:
    return F.regexp_replace(_c(c), NOT_ALNUM_SPACE, " ")


def alnum_lower(c) -> Column:
    """Drop every non-alphanumeric character, lower-case (name pre-processing)."""
    return F.lower(F.regexp_replace(_c(c), NON_ALNUM, ""))


def clean_header(c) -> Column:
    """Normalised column name: strip, camel split, lower, punctuation, collapse spaces."""
    v = strip_unicode(c)
    v = split_camel(v)
    v = F.lower(v)
    v = punct_to_space(v)
    return F.regexp_replace(v, ANY_SPACE_RUN, " ")


def equal_name_key(c) -> Column:
    """Key for equal-name matching: strip, lower, punctuation to space (no collapse)."""
    return punct_to_space(F.lower(strip_unicode(c)))


def is_null_spelling(c) -> Column:
    return _c(c).isNull() | F.lower(_c(c)).isin(*NULL_SPELLINGS)


def is_binary_word(c) -> Column:
    return F.lower(_c(c)).isin(*BINARY_WORDS)


def clean_text(c) -> Column:
    """Clean one text cell; ``None`` for null spellings and empty results."""
    raw = _c(c)
    v = split_camel(raw)
    v = strip_unicode(v)
    v = F.lower(v)
    v = punct_to_space(v)
    return F.when(is_null_spelling(raw), F.lit(None).cast("string")).otherwise(F.nullif(v, F.lit("")))


def is_number_text(c) -> Column:
    return F.coalesce(_c(c).rlike(NUMBER_TEXT), F.lit(False))


def is_integer_text(c) -> Column:
    return F.coalesce(_c(c).rlike(INTEGER_TEXT), F.lit(False))


def parse_date(c) -> Column:
    """First successful parse over the fixed layout list, else null."""
    s = strip_unicode(c)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(fmt)) for fmt, _ in DATE_FORMATS])


def is_date_text(c) -> Column:
    # cheap guard first: every accepted layout starts with a digit
    return F.coalesce(_c(c).rlike(r"^\s*\d") & parse_date(c).isNotNull(), F.lit(False))
