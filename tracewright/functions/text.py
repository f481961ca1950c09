"""Column expressions on text and identifiers, all of them JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace (zero-width ones do not).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def squeeze(c: Column) -> Column:
    """Each run of whitespace of any kind becomes one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, WS_CLASS + "+", " "))


def compared(c: Column) -> Column:
    """The form in which lines and quotes are compared: squeezed and lower case."""
    return F.lower(squeeze(c))


def clean_id(c: Column) -> Column:
    """An identifier as it is compared: whitespace trimmed, upper case; blank is NULL."""
    return F.nullif(F.upper(F.btrim(c, F.lit(WHITESPACE))), F.lit(""))


def squashed(c: Column) -> Column:
    """Name key: lower case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def number(c: Column) -> Column:
    """`$1,234.50` as a double; NULL where it is no number."""
    return F.regexp_replace(c, "[,$]", "").try_cast("double")


def significant_digits(c: Column) -> Column:
    """Digits left after dropping separators and the zeros at both ends, at least 1."""
    bare = F.regexp_replace(c, "[,.]", "")
    return F.greatest(F.length(F.btrim(bare, F.lit("0"))), F.lit(1))


def leading_date(c: Column) -> Column:
    """The ISO date that opens a file name, or an empty string."""
    return F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)


def occurrences(text: Column, term: str) -> Column:
    """How often a literal lower-case term occurs in lower-cased text, without overlap."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")
