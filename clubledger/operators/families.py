"""People grouped by what they share: one e-mail address or one household."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def family_sizes(people: DataFrame, *key: str) -> DataFrame:
    """One row per family: size and position of its first person.

    Only counters travel, combined before the shuffle, so a key shared by a
    large part of all people (no address at all, say) costs no more than others.
    """
    return people.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_people"), F.min("pos").alias("first_pos")
    )


def mail_families(people: DataFrame) -> DataFrame:
    """Families with the same e-mail address; people without one are one family."""
    return family_sizes(people, "email")


def family_values(people: DataFrame, prop: str, *key: str) -> DataFrame:
    """The distinct values of a property per family, one row each.

    Kept in rows so that a very large family is spread over many tasks.
    """
    return people.where(F.col(prop).isNotNull()).select(*key, prop).distinct()


def families_with(people: DataFrame, condition: Column, *key: str) -> DataFrame:
    """Families in which at least one person satisfies the condition."""
    return (
        people.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n_people"),
            F.min("pos").alias("first_pos"),
            F.bool_or(F.coalesce(condition, F.lit(False))).alias("_hit"),
        )
        .where("_hit")
        .drop("_hit")
    )


def families_with_value(people: DataFrame, prop: str, value, *key: str) -> DataFrame:
    return families_with(people, F.col(prop).eqNullSafe(F.lit(value)), *key)


def add_people(people: DataFrame, more: DataFrame) -> DataFrame:
    """Bag union; regroup afterwards to join the new people to their families."""
    return people.unionByName(more, allowMissingColumns=True)
