"""Column expressions over typed people records."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.constants import (
    DISPLAY_DATE,
    FEMALE,
    SALUTATION_FEMALE,
    SALUTATION_OTHER,
    YOUTH_GROUP_MARKERS,
)


def age_at(birthday: Column, on: Column | dt.date) -> Column:
    """Completed years on a day; a 29 February birthday is reached on 1 March."""
    day = on if isinstance(on, Column) else F.lit(on)
    not_reached = F.struct(F.month(day), F.dayofmonth(day)) < F.struct(
        F.month(birthday), F.dayofmonth(birthday)
    )
    return F.year(day) - F.year(birthday) - not_reached.cast("int")


def person_label(number: bool = True) -> Column:
    """``First Last`` or ``First Last - number``; missing parts print as nothing."""
    name = F.concat_ws(" ", "first_name", "last_name")
    if not number:
        return name
    return F.concat(name, F.lit(" - "), F.coalesce(F.col("member_number").cast("string"), F.lit("")))


def salutation(gender: Column) -> Column:
    return F.when(gender.eqNullSafe(F.lit(FEMALE)), SALUTATION_FEMALE).otherwise(SALUTATION_OTHER)


def street_key(street: Column) -> Column:
    """Spelling-neutral street name used to recognise one address."""
    return F.replace(F.lower(street), F.lit("str."), F.lit("strasse"))


def gender_key(gender: Column) -> Column:
    return F.replace(F.lower(gender), F.lit("ä"), F.lit("ae"))


def is_youth_group(name: Column) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(m) for m in YOUTH_GROUP_MARKERS])


def joined_distinct(c: Column | str, sep: str = " & ") -> Column:
    """Aggregate: the distinct values, sorted and joined; missing ones skipped."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.sort_array(F.collect_set(c.cast("string"))), sep)


def display_date(c: Column) -> Column:
    return F.date_format(c, DISPLAY_DATE)


def python_bool_text(c: Column) -> Column:
    """Booleans as the ``True`` / ``False`` the mailing service expects."""
    return F.initcap(c.cast("string"))


def add_tags(people: DataFrame, *tags: str) -> DataFrame:
    """Set union of the given tags into every row."""
    given = F.array(*[F.lit(t) for t in tags])
    if "tags" not in people.columns:
        return people.withColumn("tags", given)
    own = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    return people.withColumn("tags", F.array_union(own, given))


def set_email(people: DataFrame, where: Column, value: Column) -> DataFrame:
    """Replace the primary address on the selected rows.

    The list of addresses follows: it holds just the new one, or is missing when
    the address is cleared, so an alternative address never moves up.
    """
    selected = F.coalesce(where, F.lit(False))
    columns = {"email": F.when(selected, value).otherwise(F.col("email"))}
    if "emails" in people.columns:
        replaced = F.when(value.isNotNull(), F.array(value))
        columns["emails"] = F.when(selected, replaced).otherwise(F.col("emails"))
    return people.withColumns(columns)


def clear_property(people: DataFrame, name: str, where: Column) -> DataFrame:
    """Set one property to missing on the selected rows."""
    if name == "email":
        return set_email(people, where, F.lit(None).cast("string"))
    kept = F.when(~F.coalesce(where, F.lit(False)), F.col(name))
    return people.withColumn(name, kept)


def remove_value(people: DataFrame, name: str, value) -> DataFrame:
    """Take one value out of a list property, or clear a scalar equal to it."""
    if value is None:
        return people
    if people.schema[name].dataType.typeName() == "array":
        return people.withColumn(name, F.filter(name, lambda x: ~x.eqNullSafe(F.lit(value))))
    return clear_property(people, name, F.col(name) == F.lit(value))
