"""Flat address lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.constants import ADDRESS_COLUMNS, ROLE_LABELS
from clubledger.functions.people import salutation


def address_columns() -> list[Column]:
    return [
        salutation(F.col("gender")).alias(name) if field is None else F.col(field).alias(name)
        for name, field in ADDRESS_COLUMNS.items()
    ]


def address_list(people: DataFrame, *keep: str) -> DataFrame:
    """The eleven address columns; ``keep`` names further columns to carry along."""
    return people.select(*keep, *address_columns())


def role_label(role: Column) -> Column:
    """Printed role of a group member or coach."""
    return F.when(role == "coach", ROLE_LABELS["coach"]).otherwise(ROLE_LABELS["member"])
