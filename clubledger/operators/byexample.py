"""Matching people by example.

A reference matches a person when all properties the reference has are equal;
properties it lacks are wildcards. Naively that is a comparison of every person
with every reference. Here every reference is keyed once, by its *anchor*: the
filled property that tells people apart best. People are keyed by those properties
that are an anchor of some reference, the match is an equi-join on property and
value, and the other properties are checked on the pairs that meet. However many
combinations of filled properties there are, a person is keyed at most once per
property.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.functions.people import clear_property, set_email
from clubledger.operators.quality import require_none
from clubledger.operators.skew import skew_join

# Bookkeeping columns that say nothing about the person.
NOT_PROPERTIES = {"person_id", "pos", "ref_pos"}
# Properties by how well they tell people apart, best first; others come after these.
ANCHORS = (
    "member_number", "emails", "email", "phone_m", "phone_p", "phone_g", "birthday",
    "street", "last_name", "first_name", "date_added", "plz", "city", "tags", "category",
    "printed_magazine", "gender",
)
# Properties that are sets: their order, and repeats, say nothing.
SETS = {"tags"}


def match_fields(people: DataFrame, references: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Properties both tables have. Leaving out the address leaves out the whole list."""
    left_out = NOT_PROPERTIES | set(exclude)
    if "email" in left_out:
        left_out.add("emails")
    return [c for c in references.columns if c in people.columns and c not in left_out]


def _comparable(rows: DataFrame, types: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields in the types the people have; sets in one order."""
    same = {
        f: F.col(f).cast(types.schema[f].dataType)
        for f in fields
        if rows.schema[f].dataType != types.schema[f].dataType
    }
    sets = {f: F.array_sort(F.array_distinct(f)) for f in fields if f in SETS}
    rows = rows.withColumns(same) if same else rows
    return rows.withColumns(sets) if sets else rows


def _by_preference(fields: Sequence[str]) -> list[str]:
    return sorted(fields, key=lambda f: (ANCHORS.index(f) if f in ANCHORS else len(ANCHORS), f))


def _anchor(i: int, field: str) -> Column:
    """Property number and a hash of the value; missing if the property is."""
    key = F.struct(F.lit(i).alias("property"), F.xxhash64(field).alias("value"))
    return F.when(F.col(field).isNotNull(), key)


def empty_references(
    people: DataFrame, references: DataFrame, exclude: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """References without any property to match by, which match everybody; ``strict``
    raises if there are any, for one such row in a list clears a whole club."""
    fields = match_fields(people, references, exclude)
    nothing = reduce(Column.__and__, [F.col(f).isNull() for f in fields], F.lit(True))
    return require_none(references.where(nothing), "references without a property", strict)


def _meetings(people: DataFrame, references: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``person_id`` and the columns of ``references`` besides ``fields``, for every
    person and reference that match."""
    if not fields:
        raise ValueError("there is no property to match by")
    ordered = _by_preference(fields)
    # A reference without a property is anchored in what everybody has.
    anyone = F.struct(F.lit(-1).alias("property"), F.lit(0).cast("bigint").alias("value"))
    keys = [*[_anchor(i, f) for i, f in enumerate(ordered)], anyone]
    others = [c for c in references.columns if c not in fields]
    # One struct, for the optimizer follows each renamed column through all conditions.
    asked = _comparable(references, people, fields).select(
        F.coalesce(*keys).alias("anchor"), F.struct(*fields).alias("example"), *others
    )
    known = _comparable(people.select("person_id", *fields), people, fields)
    known = known.select(
        "person_id", *fields, F.explode(F.array_compact(F.array(*keys))).alias("anchor")
    )
    # Properties that anchor no reference need not travel. There are no more rows of them
    # than properties, so they go to the people: dealt out by the few numbers, all people
    # who have a property would meet in one task.
    used = F.broadcast(asked.select(F.col("anchor.property").alias("property")).distinct())
    known = known.join(used, known["anchor.property"] == used["property"], "left_semi")
    same = known["anchor"] == asked["anchor"]
    for f in fields:
        same &= asked["example"][f].isNull() | (asked["example"][f] == known[f])
    return known.join(asked, same).select("person_id", *others)


def fill_from_references(
    people: DataFrame,
    references: DataFrame,
    prop: str,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """``(person_id, filled)`` for people who lack ``prop`` and match a reference that has it.

    The reference with the lowest ``ref_pos`` wins. References with the same
    example are reduced to their first one before the join.
    """
    fields = match_fields(people, references, [prop, *exclude])
    offers = (
        references.where(F.col(prop).isNotNull())
        .groupBy(*fields)
        .agg(F.min(F.struct("ref_pos", F.col(prop).alias("value"))).alias("offer"))
    )
    filled = (
        _meetings(people.where(F.col(prop).isNull()), offers, fields)
        .groupBy("person_id")
        .agg(F.min("offer").alias("offer"))
        .select("person_id", F.col("offer.value").alias("filled"))
    )
    return filled


def backfill(
    people: DataFrame,
    references: DataFrame,
    prop: str,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """People with ``prop`` filled from the first matching reference where it is missing."""
    filled = fill_from_references(people, references, prop, exclude)
    joined = skew_join(people, filled, "person_id")
    missing = F.col(prop).isNull() & F.col("filled").isNotNull()
    if prop == "email":
        result = set_email(joined, missing, F.col("filled"))
    else:
        result = joined.withColumn(prop, F.coalesce(prop, "filled"))
    return result.select(*people.columns)


def matching_people(
    people: DataFrame,
    references: DataFrame,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """``person_id`` of everyone who matches at least one reference."""
    fields = match_fields(people, references, exclude)
    examples = references.select(*fields).distinct()
    matched = _meetings(people, examples, fields)
    return matched.distinct()


def clear_matching(
    people: DataFrame,
    references: DataFrame,
    prop: str,
) -> DataFrame:
    """Clear ``prop`` on everyone who matches a reference."""
    hits = matching_people(people, references)
    flagged = skew_join(people, hits.withColumn("_hit", F.lit(True)), "person_id")
    return clear_property(flagged, prop, F.col("_hit")).select(*people.columns)


def lost_emails(
    people: DataFrame,
    backup: DataFrame,
    exclude: Sequence[str] = ("category", "tags", "riegen_coach", "riegen_member"),
) -> DataFrame:
    """People without an address whom the backup knows with one, that address filled in.

    A report only: the people themselves stay as they are.
    """
    lacking = people.where(F.col("email").isNull())
    filled = fill_from_references(lacking, backup, "email", exclude)
    found = skew_join(lacking, filled, "person_id", "inner")
    return set_email(found, F.lit(True), F.col("filled")).select(*people.columns)
