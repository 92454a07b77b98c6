"""String clean-up as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def words(text: Column) -> Column:
    """Distinct white-space separated tokens."""
    parts = F.split(text, r"(?U)[\s\x1c-\x1f]+")
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def sanitize(text: Column, max_length: int = 1000) -> Column:
    """Delete control characters, collapse white space, trim, cut to ``max_length`` characters."""
    printable = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1f\x7f-\x9f]", "")
    spaced = F.regexp_replace(printable, r"(?U)\s+", " ")
    return F.substring(strip(spaced), 1, max_length)


def form_list(text: Column) -> Column:
    """Comma-separated form field to a list; empty items are dropped, an empty list is NULL."""
    items = F.filter(F.transform(F.split(text, ","), strip), lambda p: p != "")
    return F.nullif(items, F.array().cast("array<string>"))
