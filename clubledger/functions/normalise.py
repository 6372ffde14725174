"""Column expressions that turn raw export text into typed record fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from clubledger.constants import (
    DISPLAY_DATE,
    ISO_DATE,
    PRINTED_MAGAZINE_OPT_OUT,
    SHORT_YEAR_DATE,
)


def blank_to_null(c: Column) -> Column:
    """Empty and whitespace-only text is missing."""
    return F.when(F.trim(c) != "", c)


def member_number(c: Column) -> Column:
    """Whole number, exact at any size; text such as ``123.0`` (a float column) is
    accepted, anything else is missing."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "")
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text).try_cast("bigint")


def plz(c: Column) -> Column:
    """Postal code as text; a float artefact ``5436.0`` becomes ``5436``."""
    return blank_to_null(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""))


def phone(c: Column) -> Column:
    return F.translate(c.cast("string"), " ", "")


def email_array(columns: list[Column]) -> Column:
    """All given addresses in column order, missing ones left out."""
    return F.array_compact(F.array(*[blank_to_null(c.cast("string")) for c in columns]))


def primary_email(emails: Column) -> Column:
    return F.try_element_at(emails, F.lit(1))


def printed_magazine(c: Column | None) -> Column:
    """False for the opt-out word or an absent column, true for anything else,
    a blank cell included."""
    if c is None:
        return F.lit(False)
    return ~c.eqNullSafe(F.lit(PRINTED_MAGAZINE_OPT_OUT))


def parse_date(c: Column, as_of: dt.date) -> Column:
    """Day-first dates with four or two digit years, or ISO dates.

    A two-digit year that would lie after the year of ``as_of`` belongs to the
    previous century.
    """
    text = F.trim(c.cast("string"))
    short = F.try_to_date(text, SHORT_YEAR_DATE)
    pivoted = F.when(F.year(short) > as_of.year, F.add_months(short, -1200)).otherwise(short)
    # Looking at the shape first spares a failed parse per row.
    return (
        F.when(text.like("__.__.____"), F.try_to_date(text, DISPLAY_DATE))
        .when(text.like("__.__.__"), pivoted)
        .when(text.like("____-__-__%"), F.try_to_date(F.substring(text, 1, 10), ISO_DATE))
    )
