"""Selecting people: lookups, date ranges and the fixed club lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.constants import (
    ADULT_AGE_OFFSET,
    ADULT_CATEGORIES,
    ANNIVERSARIES,
    HONORARY_CATEGORIES,
    TAG_BASE_MEMBER,
    YOUTH_CATEGORIES,
)

Comparator = Callable[[Column, Column], Column]

COMPARATORS: dict[str, Comparator] = {
    "eq": lambda a, b: a.eqNullSafe(b),
    "ne": lambda a, b: a.isNotNull() & ~a.eqNullSafe(b),
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


def lookup(
    people: DataFrame, prop: str, value, comparator: str | Comparator = "eq"
) -> DataFrame:
    """People whose property compares true with a value.

    Looking for ``None`` finds rows where the property is missing, and with ``ne``
    those where it is there; a missing property never satisfies a comparison with a
    value.
    """
    compare = COMPARATORS[comparator] if isinstance(comparator, str) else comparator
    wanted = value if isinstance(value, Column) else F.lit(value)
    return people.where(compare(F.col(prop), wanted))


def lookup_any(people: DataFrame, prop: str, values: Iterable) -> DataFrame:
    return people.where(F.col(prop).isin(list(dict.fromkeys(values))))


def in_range(c: Column, begin: dt.date | None = None, end: dt.date | None = None) -> Column:
    """Half-open range; either bound may be left out. Missing values are outside."""
    inside = c.isNotNull() if begin is None and end is None else F.lit(True)
    if begin is not None:
        inside = inside & (c >= F.lit(begin))
    if end is not None:
        inside = inside & (c < F.lit(end))
    return inside


def adults_joined_between(
    people: DataFrame, begin: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    adults = lookup_any(people, "category", ADULT_CATEGORIES)
    if begin is None and end is None:
        return adults
    return adults.where(in_range(F.col("date_added"), begin, end))


def youth_born_in_year(people: DataFrame, year: int) -> DataFrame:
    youth = lookup_any(people, "category", YOUTH_CATEGORIES)
    return youth.where(in_range(F.col("birthday"), dt.date(year, 1, 1), dt.date(year + 1, 1, 1)))


def assembly_lists(people: DataFrame, assembly_year: int) -> DataFrame:
    """All lists for a yearly assembly, one row per person and list, in one pass.

    New adults since the previous year, one list per anniversary, and youth who
    come of age. ``list_name`` tells the lists apart.
    """
    if not 1000 <= assembly_year <= 9999:
        raise ValueError("the assembly year must have four digits")
    adult = F.col("category").isin(ADULT_CATEGORIES)
    youth = F.col("category").isin(YOUTH_CATEGORIES)
    entry, birthday = F.col("date_added"), F.col("birthday")

    def year_of(c: Column, year: int) -> Column:
        return in_range(c, dt.date(year, 1, 1), dt.date(year + 1, 1, 1))

    rules = {"neumitglieder": adult & in_range(entry, dt.date(assembly_year - 1, 1, 1))}
    for years in ANNIVERSARIES:
        rules[f"jubilare_{years}"] = adult & year_of(entry, assembly_year - years)
    rules["jugenduebertritte"] = youth & year_of(birthday, assembly_year - ADULT_AGE_OFFSET)
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    # The filter repeats the rules for the scan to see.
    on_any = reduce(lambda a, b: a | b, rules.values())
    return people.where(on_any).withColumn("list_name", F.explode(names))


def without_email(people: DataFrame) -> DataFrame:
    """People with no address at all; an empty text is an address here."""
    return people.where(F.col("email").isNull())


def honorary_without_email(people: DataFrame) -> DataFrame:
    return lookup_any(without_email(people), "category", HONORARY_CATEGORIES)


def magazine_recipients(people: DataFrame) -> DataFrame:
    return people.where(F.col("printed_magazine"))


def base_members(people: DataFrame) -> DataFrame:
    return people.where(F.array_contains("tags", TAG_BASE_MEMBER))
