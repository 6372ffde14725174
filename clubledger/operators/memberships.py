"""Groups: who is a member or coach of which, rosters and the overlap matrix.

The long table ``memberships(person_id, riege, role, ...)`` is a bag: a person
listed twice in a group has two rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.constants import (
    COACH_FUNCTIONS,
    EXCLUDED_MEMBER_NUMBERS,
    ORGAN_GROUPS,
    PRESCHOOL_CATEGORY,
    PRESCHOOL_GROUP,
)
from clubledger.functions.people import is_youth_group
from clubledger.operators.addresses import address_columns, role_label
from clubledger.operators.skew import skew_join


# Parts over which the rows of the overlap matrix are dealt.
MATRIX_PARTS = 64


def is_coach_row() -> Column:
    return F.coalesce(F.col("function_name").isin(COACH_FUNCTIONS), F.lit(False))


def groups_of_organ(organ_groups: Mapping[str, Sequence[str]]) -> Column:
    """Groups a coach row stands for; missing when its organ is unknown.

    The mapping is configuration, so it is a literal in the plan.
    """
    pairs = [
        x for organ, groups in organ_groups.items() for x in (F.lit(organ), F.array(*map(F.lit, groups)))
    ]
    return F.try_element_at(F.create_map(*pairs), F.col("organ"))


def uniquely_numbered(people: DataFrame, *keep: str) -> DataFrame:
    """People whose member number nobody else has."""
    carried = [c for c in keep if c != "member_number"]
    return (
        people.where(F.col("member_number").isNotNull())
        .groupBy("member_number")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in carried])
        .where("_n = 1")
        .drop("_n")
    )


def matched_rows(
    people: DataFrame,
    rows: DataFrame,
    *keep: str,
    excluded: Sequence[int] = EXCLUDED_MEMBER_NUMBERS,
) -> DataFrame:
    """Group file rows joined to the one person with their member number.

    Rows without a number, with an excluded one, or with a number that no or
    several people have, do not appear.
    """
    usable = rows.where(
        F.col("member_number").isNotNull() & ~F.col("member_number").isin(list(excluded))
    )
    lookup = uniquely_numbered(people, "person_id", *keep)
    return skew_join(usable, lookup, "member_number", "inner")


def dropped_rows(
    people: DataFrame, rows: DataFrame, excluded: Sequence[int] = EXCLUDED_MEMBER_NUMBERS
) -> DataFrame:
    """Diagnostics: why group file rows were left out, with counts."""
    owners = (
        people.where(F.col("member_number").isNotNull())
        .groupBy("member_number")
        .agg(F.count(F.lit(1)).alias("owners"))
    )
    # Counting per number first leaves one row per number to join.
    per_number = rows.groupBy("member_number").agg(F.count(F.lit(1)).alias("n"))
    reason = (
        F.when(F.col("member_number").isNull(), "no number")
        .when(F.col("member_number").isin(list(excluded)), "excluded")
        .when(F.col("owners").isNull(), "unmatched")
        .when(F.col("owners") > 1, "ambiguous")
    )
    return (
        per_number.join(owners, "member_number", "left")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.sum("n").alias("n_rows"))
    )


def unknown_organs(
    people: DataFrame,
    rows: DataFrame,
    organ_groups: Mapping[str, Sequence[str]] = ORGAN_GROUPS,
) -> DataFrame:
    """Diagnostics: organs of coach rows that the mapping does not know."""
    coaches = matched_rows(people, rows.where(is_coach_row()))
    return (
        coaches.where(groups_of_organ(organ_groups).isNull())
        .groupBy("organ")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def preschool_rows(people: DataFrame, *keep: str) -> DataFrame:
    """Everyone of the pre-school category is a member of the pre-school group."""
    return people.where(F.col("category") == PRESCHOOL_CATEGORY).select(
        "person_id", F.lit(PRESCHOOL_GROUP).alias("riege"), F.lit("member").alias("role"), *keep
    )


def build_memberships(
    people: DataFrame,
    rows: DataFrame,
    *keep: str,
    organ_groups: Mapping[str, Sequence[str]] = ORGAN_GROUPS,
    excluded: Sequence[int] = EXCLUDED_MEMBER_NUMBERS,
) -> DataFrame:
    """The membership bag from the group file and the pre-school category.

    ``keep`` names people columns to carry along, which saves a second join
    where the bag is printed.
    """
    carried = [c for c in keep if c not in ("person_id", "member_number")]
    matched = matched_rows(people, rows, *carried, excluded=excluded)
    coach = is_coach_row()
    groups = F.when(coach, groups_of_organ(organ_groups)).otherwise(
        F.array_compact(F.array("function_name"))
    )
    from_file = matched.select(
        "person_id",
        F.explode(groups).alias("riege"),
        F.when(coach, "coach").otherwise("member").alias("role"),
        *keep,
    )
    return from_file.unionByName(preschool_rows(people, *keep))


def preschool_conflicts(
    people: DataFrame,
    rows: DataFrame,
    organ_groups: Mapping[str, Sequence[str]] = ORGAN_GROUPS,
) -> DataFrame:
    """Diagnostics: pre-school people whom the group file already lists there."""
    listed = matched_rows(people, rows.where(~is_coach_row()), "category")
    return listed.where(
        (F.col("function_name") == PRESCHOOL_GROUP) & (F.col("category") == PRESCHOOL_CATEGORY)
    ).select("person_id")


def member_groups(memberships: DataFrame) -> DataFrame:
    """Distinct groups with members; the pre-school group is always one of them."""
    spark = memberships.sparkSession
    always = spark.range(1).select(F.lit(PRESCHOOL_GROUP).alias("riege"))
    return memberships.where(F.col("role") == "member").select("riege").union(always).distinct()


def rosters(
    people: DataFrame,
    rows: DataFrame,
    organ_groups: Mapping[str, Sequence[str]] = ORGAN_GROUPS,
) -> DataFrame:
    """Address lists of all groups, members and coaches, in one long table."""
    needed = ["first_name", "last_name", "street", "plz", "city", "birthday", "category", "gender"]
    needed += ["email", "date_added"]
    bag = build_memberships(people, rows, *needed, organ_groups=organ_groups)
    return bag.select("riege", *address_columns(), role_label(F.col("role")).alias("Funktion"))


def roster_sizes(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("riege", "role").agg(F.count(F.lit(1)).alias("n_entries"))


def overlap_cells(memberships: DataFrame) -> DataFrame:
    """Non-zero cells of the group overlap matrix of the non-youth groups.

    ``n`` counts the entries of ``riege``, repeats included, whose person also
    appears in ``other``: the product of the sparse person by group table with itself.
    Only the groups of one person meet, each group once however often the person is
    listed there, so a person has at most as many cells as the matrix. The cells are
    added up by pair of groups before they are shuffled.
    """
    entries = (
        memberships.where(~is_youth_group(F.col("riege")))
        .groupBy("person_id", "riege")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    own = F.collect_list(F.struct("riege", "k")).alias("entries")
    return (
        entries.groupBy("person_id")
        .agg(own)
        .select(F.explode("entries").alias("a"), "entries")
        .select(
            F.col("a.riege").alias("riege"),
            F.explode("entries.riege").alias("other"),
            F.col("a.k").alias("n"),
        )
        .groupBy("riege", "other")
        .agg(F.sum("n").alias("n"))
    )


def overlap_matrix(memberships: DataFrame, parts: int = MATRIX_PARTS) -> DataFrame:
    """The full matrix in long form, zero cells included.

    Its rows are dealt over ``parts`` by a hash of their group, and every part gets
    all groups as columns, so that each makes the zero cells of its own rows."""
    cells = overlap_cells(memberships)
    # A group always overlaps itself, so its name appears among the cells. The
    # condition holds for every cell; it keeps the counts in the plan, which is then
    # the one that the cells have, and Spark computes both once.
    names = cells.where("n > 0").select("riege").distinct()
    part = F.pmod(F.xxhash64("riege"), F.lit(parts)).cast("int").alias("part")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    zeros = (
        names.select("riege", part)
        .join(names.select(F.col("riege").alias("other"), every), "part")
        .select("riege", "other", F.lit(0).cast("bigint").alias("n"))
    )
    return zeros.unionByName(cells).groupBy("riege", "other").agg(F.sum("n").alias("n"))


def overlap_wide(matrix: DataFrame) -> DataFrame:
    """``(riege, cells)``: the rows of the full matrix, each with all its cells
    ``(other, n)`` in order of ``other``, which is the same in every row.

    A row is as long as there are groups; no name has to be known beforehand."""
    cells = F.sort_array(F.collect_list(F.struct("other", "n")))
    return matrix.groupBy("riege").agg(cells.alias("cells"))


def overlap_lines(wide: DataFrame, separator: str = ";") -> DataFrame:
    """The wide matrix as lines of text in order: the groups as a header, then a row
    for each of them. Names that hold the separator, a quote or a line break are
    quoted."""

    def cell(name: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(name.rlike(f'["\r\n{separator}]'), quoted).otherwise(name)

    header = wide.agg(F.sort_array(F.collect_list("riege")).alias("names")).select(
        F.lit(0).alias("place"),
        F.lit("").alias("riege"),
        F.concat_ws(
            separator, F.array(F.lit("riege")), F.transform("names", cell)
        ).alias("value"),
    )
    numbers = F.transform("cells", lambda c: c["n"].cast("string"))
    rows = wide.select(
        F.lit(1).alias("place"),
        "riege",
        F.concat_ws(separator, F.array(cell(F.col("riege"))), numbers).alias("value"),
    )
    return header.unionByName(rows).orderBy("place", "riege").select("value")
