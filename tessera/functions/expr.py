"""Column helpers shared by the jobs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Prefixes, reserved words and shapes that published data obey. Unpublished documents carry one of these before their id.
UNPUBLISHED = ("drafts.", "versions.")
#: Languages and reserved words that no slug may take.
RESERVED_SLUGS = ("admin", "api", "index", "sitemap")
EMAIL = r"(?U)^[^@\s\ufeff]+@[^@\s\ufeff]+\.[^@\s\ufeff]+\z"
IDEMPOTENCY_KEY = r"^[A-Za-z0-9._:-]{8,200}$"
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def is_published(doc_id: Column) -> Column:
    return ~(F.startswith(doc_id, F.lit(UNPUBLISHED[0])) | F.startswith(doc_id, F.lit(UNPUBLISHED[1])))


def lisbon_day(utc: Column) -> Column:
    """Calendar day in Lisbon of a UTC instant, summer time included."""
    return F.to_date(F.from_utc_timestamp(utc.cast("timestamp"), "Europe/Lisbon"))


def valid_iso_date(text: Column) -> Column:
    """True for a real day written YYYY-MM-DD; null and anything else: false."""
    return F.coalesce(text.rlike(ISO_DATE) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def window_state(day: Column, start: Column, end: Column) -> Column:
    """upcoming, active, ended or invalid; both ends belong to the window."""
    return F.when(start.isNull() | end.isNull() | (end < start), "invalid").when(day < start, "upcoming").when(day > end, "ended").otherwise("active")


def valid_slug(slug: Column) -> Column:
    return F.coalesce(slug.rlike(SLUG) & ~slug.isin(*RESERVED_SLUGS), F.lit(False))


def clean_text(text: Column) -> Column:
    """Zero-width characters out, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\\u200b\\u200c\\u200d\\ufeff]", ""), "[ \\t\\n\\r\\f\\u000b\\u00a0]+", " "))


def url_path(url: Column) -> Column:
    """Path of an absolute URL without query, fragment, ``.html`` and trailing slash; at least ``/``."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1))


def xml_escape(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def positive_number(text: Column) -> Column:
    """The number a text holds if it is finite and above zero, else null; suffixes such as ``d`` don't count."""
    return F.when(text.rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), F.nullif(F.trim(text).try_cast("double"), F.lit(0.0)))


def plausible_phone(text: Column) -> Column:
    """7 to 15 digits with usual separators; the national number is neither one digit repeated nor a run up or down.

    An international number starts with ``+`` or ``00``; behind the prefix of Portugal the national number is judged,
    behind any other a subscriber number of seven or more equal digits is refused.
    """
    phone = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    digits = F.regexp_replace(F.regexp_replace(phone, "^00", ""), "[^0-9]", "")
    abroad = phone.rlike(r"^(\+|00)")
    national = F.when(abroad & digits.startswith("351"), F.substr(digits, F.lit(4))).otherwise(digits)
    repeated = national.rlike(r"^(\d)\1*$") & (F.length(national) != 1) | (national == "")
    placeholder = abroad & ~digits.startswith("351") & digits.rlike(r"^[1-9]\d{0,2}(\d)\1{6,}$")
    # A run goes on from nine to zero once, so its length is bound by where it starts.
    steps = lambda by: F.forall(F.sequence(F.lit(2), F.length(national)), lambda i: F.pmod(F.substr(national, i, F.lit(1)).cast("int") - F.substr(national, i - 1, F.lit(1)).cast("int"), F.lit(10)) == by)
    first, n = F.substring(national, 1, 1).cast("int"), F.length(national)
    run = (n > 1) & ((steps(1) & (n <= 20 - first)) | (steps(9) & (n <= 11 + first)))
    well_formed = phone.rlike(r"(?U)^\+?[0-9\s().-]+$") & F.length(digits).between(7, 15)
    return F.coalesce(F.when(well_formed, ~repeated & ~placeholder & ((n == 1) | ~run)), F.lit(False))


def reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules whose condition holds, in order; a null condition counts as false."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules]))


def first_failing(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule whose condition holds; null if none does. A null condition counts as false."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules])


def trimmed(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\ufeff]+|[\s\ufeff]+$", "")


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode form C; no JVM function gives it, so non-ASCII rows go through Python in Arrow batches."""
    return _composed(text)
