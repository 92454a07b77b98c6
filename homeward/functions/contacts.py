"""Contact strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from homeward.functions.text import strip

# Contact patterns and the wording of an absent contact.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EMAIL_INSIDE = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PHONE = r"^\+?[\d\s\-\(\)]{10,}$"
NO_CONTACT = "No contact available"


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def is_phone(text: Column) -> Column:
    return text.rlike("(?U)" + PHONE)


def email_in(contact: Column) -> Column:
    """The e-mail address a contact consists of or contains, else NULL."""
    whole = strip(contact)
    inside = F.nullif(F.regexp_extract(contact, "(?U)" + EMAIL_INSIDE, 0), F.lit(""))
    return F.when(contact.contains("@"), F.when(is_email(whole), whole).otherwise(inside))


def contact_of(contact: Column, finder_contact: Column) -> Column:
    """Family contact first, then the finder's, then a fixed text."""
    return F.coalesce(F.nullif(contact, F.lit("")), finder_contact, F.lit(NO_CONTACT))
