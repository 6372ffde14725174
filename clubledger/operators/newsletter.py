"""Newsletter recipients: one row per address, and the payload built from it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.constants import (
    GENDER_FLAGS,
    NEWSLETTER_CATEGORIES,
    RECEIVER_SOURCE,
)
from clubledger.functions.people import (
    display_date,
    gender_key,
    joined_distinct,
    python_bool_text,
)

NEWSLETTER_COLUMNS = [
    "firstname",
    "lastname",
    "Email",
    *GENDER_FLAGS,
    "updated",
    *NEWSLETTER_CATEGORIES,
]


def with_address(people: DataFrame) -> DataFrame:
    return people.where(F.col("email").isNotNull() & (F.col("email") != ""))


def _flag(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def newsletter_rows(people: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per non-empty address with joined names, gender and category flags.

    One scan and one aggregation by address: every task reduces the names of an
    address to the distinct ones before the shuffle, so however many people use it, no
    more than the names that are printed meet in one place.
    """
    reached = with_address(people).select(
        F.col("email").alias("Email"),
        "first_name",
        "last_name",
        gender_key(F.col("gender")).alias("gender"),
        "category",
    )
    flags = [
        *[_flag(F.col("gender") == g).alias(g) for g in GENDER_FLAGS],
        *[_flag(F.col("category") == v).alias(k) for k, v in NEWSLETTER_CATEGORIES.items()],
    ]
    names = {"firstname": "first_name", "lastname": "last_name"}
    rows = reached.groupBy("Email").agg(
        *[joined_distinct(c).alias(n) for n, c in names.items()], *flags
    )
    return rows.withColumn("updated", F.lit(as_of)).select(*NEWSLETTER_COLUMNS)


def newsletter_emails(people: DataFrame) -> DataFrame:
    """Just the addresses of the newsletter table, as ``email``."""
    return with_address(people).select("email").distinct()


def newsletter_text(rows: DataFrame) -> DataFrame:
    """The newsletter table as it is printed: ``True``/``False`` and day-first dates."""
    booleans = {f.name for f in rows.schema if f.dataType.typeName() == "boolean"}
    return rows.select(
        *[
            python_bool_text(F.col(c)).alias(c)
            if c in booleans
            else display_date(F.col(c)).alias(c)
            if c == "updated"
            else F.col(c)
            for c in rows.columns
        ]
    )


def receiver_payload(rows: DataFrame) -> DataFrame:
    """Nested receiver records for the mailing service, one per newsletter row."""
    text = newsletter_text(rows)
    attributes = [c for c in text.columns if c != "Email"]
    empty_map = F.create_map().cast("map<string,string>")
    return text.select(
        F.col("Email").alias("email"),
        F.lit(RECEIVER_SOURCE).alias("source"),
        empty_map.alias("attributes"),
        F.create_map(*[x for c in attributes for x in (F.lit(c), F.col(c))]).alias(
            "global_attributes"
        ),
        F.array().cast("array<string>").alias("tags"),
        F.array().cast("array<map<string,string>>").alias("orders"),
    )


def receiver_json(payload: DataFrame) -> DataFrame:
    """Each record as one JSON text; missing fields are left out."""
    return payload.select(F.to_json(F.struct(*payload.columns)).alias("value"))


def payload_attributes(payload: DataFrame) -> DataFrame:
    """One row per receiver and attribute."""
    return payload.select(
        "email", "source", F.explode("global_attributes").alias("attribute", "attribute_value")
    )


def attribute_names(receivers: DataFrame) -> DataFrame:
    """The distinct attribute names that occur on receivers."""
    return receivers.select(F.explode(F.map_keys("global_attributes")).alias("attribute")).distinct()
