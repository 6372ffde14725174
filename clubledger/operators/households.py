"""Households: people at one address, optionally merged by a housemate list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.functions.people import person_label, street_key
from clubledger.operators.components import connected_components
from clubledger.operators.families import families_with_value, family_sizes
from clubledger.operators.order import with_position
from clubledger.operators.skew import skew_join
from clubledger.session import write_through

# A large household is put together from blocks of at most this many people.
PEOPLE_PER_BLOCK = 10_000


def with_household(people: DataFrame) -> DataFrame:
    """Add ``household``: last name, spelling-neutral street, postal code and city.

    One struct column, so that equality also holds between missing parts.
    """
    return people.withColumn(
        "household",
        F.struct("last_name", street_key(F.col("street")).alias("street_key"), "plz", "city"),
    )


def household_sizes(people: DataFrame) -> DataFrame:
    sizes = family_sizes(with_household(people), "household")
    return sizes.select("household.*", "n_people", "first_pos")


def households_with_value(people: DataFrame, prop: str, value) -> DataFrame:
    found = families_with_value(with_household(people), prop, value, "household")
    return found.select("household.*", "n_people", "first_pos")


def _block(pos: Column, data_type: str, size: int) -> Column:
    """Coarser position: at most ``size`` positions share a block, and blocks sort
    like the positions in them."""
    if data_type.startswith("struct"):
        return pos.withField("row", F.floor(pos["row"] / size))
    return F.floor(pos / size)


def _ordered(people: DataFrame) -> DataFrame:
    if "member_order" in people.columns:
        return people
    return with_household(people).withColumn("member_order", F.struct("pos"))


def household_people(people: DataFrame) -> DataFrame:
    """The long form: ``(household, member_order, label)``, a row per person."""
    label = person_label(number=False).alias("label")
    return _ordered(people).select("household", "member_order", label)


def household_list(people: DataFrame, people_per_block: int = PEOPLE_PER_BLOCK) -> DataFrame:
    """One row per household: display name, address and the people in order.

    The people of a household are put together in two steps: first those of one
    block of at most ``people_per_block`` positions, then the texts of its blocks,
    so that no task gathers a large household person by person.
    """
    people = _ordered(people)
    # Blocks follow the order within the household: link position, then position.
    links = [f for f in people.schema["member_order"].dataType.fieldNames() if f != "pos"]
    pos_type = people.schema["pos"].dataType.simpleString()
    block = _block(F.col("pos"), pos_type, people_per_block).alias("block")
    block = F.struct(*[F.col(f"member_order.{f}").alias(f) for f in links], block).alias("block")
    label = person_label(number=False).alias("label")
    blocks = people.groupBy("household", block).agg(
        F.min(F.struct("member_order", "street", "plz", "city")).alias("first"),
        F.collect_set("last_name").alias("surnames"),
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list(F.struct("member_order", label))).alias("listed"),
    )
    text = F.array_join(F.transform("listed", lambda x: x["label"]), ", ").alias("text")
    texts = F.sort_array(F.collect_list(F.struct("block", "text")))
    whole = (
        blocks.select("household", "block", "first", "surnames", "n", text)
        .groupBy("household")
        .agg(
            F.min("first").alias("first"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("surnames")))).alias("surnames"),
            F.sum("n").alias("n"),
            F.array_join(F.transform(texts, lambda x: x["text"]), ", ").alias("text"),
        )
    )
    family_name = F.concat(F.lit("Fam. "), F.array_join("surnames", " & "))
    return whole.select(
        F.when(F.col("n") == 1, F.col("text")).otherwise(family_name).alias("Name"),
        F.col("first.street").alias("Strasse"),
        F.col("first.plz").alias("PLZ"),
        F.col("first.city").alias("Ort"),
        F.col("text").alias("Personen"),
    )


def sorted_household_list(rows: DataFrame) -> DataFrame:
    """The list in printing order, missing values last."""
    return rows.orderBy(*[F.asc_nulls_last(k) for k in ("PLZ", "Ort", "Strasse", "Name")])


def printed_household_list(rows: DataFrame) -> DataFrame:
    """The list in printing order with every row's ``position`` in it, from 1. Where all
    that it is sorted by is equal, the people decide."""
    keys = ("PLZ", "Ort", "Strasse", "Name", "Personen")
    return with_position(rows, *[F.asc_nulls_last(k) for k in keys])


def combine_housemates(people: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the households that a housemate list names together.

    ``links(group_pos, member_pos, member_number)`` has one row per listed
    number. Groups that touch a common household become one. A merged household
    is headed by the household listed first; its people follow in the order in
    which their households were first listed. Numbers nobody has are skipped.
    Adds ``household`` and ``member_order`` to the people.
    """
    people = with_household(people)
    links = write_through(links.where(F.col("member_number").isNotNull()), "links")
    # One household per listed number. Where several people carry the number, the
    # household seen first in the file counts.
    wanted = links.select("member_number").distinct()
    numbered = people.select("member_number", "household", "person_id")
    candidates = write_through(
        skew_join(numbered, wanted, "member_number", "inner")
        .select("member_number", "household")
        .distinct(),
        "candidates",
    )
    touched = candidates.select("household").distinct()
    residents = people.select("household", "person_id", "pos")
    seen = (
        skew_join(residents, touched, "household", "inner")
        .groupBy("household")
        .agg(F.min("pos").alias("first_pos"), F.min("person_id").alias("node"))
    )
    found = write_through(
        skew_join(candidates, seen, "household", "inner")
        .groupBy("member_number")
        .agg(F.min_by(F.struct("household", "node"), "first_pos").alias("found"))
        .select("member_number", "found.household", "found.node"),
        "found",
    )
    link_id = ["group_pos", "member_pos"]
    nodes = found.select("member_number", "node")
    listed = write_through(
        skew_join(links, nodes, "member_number", "inner").select(
            *link_id, "node"
        ),
        "listed",
    )
    # Every household of a group is tied to the first one found.
    heads = listed.groupBy("group_pos").agg(F.min_by("node", "member_pos").alias("head"))
    ties = skew_join(listed, heads, "group_pos", "inner")
    edges = ties.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    components = connected_components(edges)
    first_link = listed.groupBy("node").agg(F.min(F.struct(*link_id)).alias("link"))
    placed = write_through(
        found.select("household", "node")
        .distinct()
        .join(components, "node")
        .join(first_link, "node")
        .select("household", "component", "link"),
        "placed",
    )
    merged = skew_join(people, placed, "household")
    own = F.when(F.col("component").isNull(), F.col("household")).alias("own")
    return merged.withColumns(
        {"household": F.struct("component", own), "member_order": F.struct("link", "pos")}
    ).drop("component", "link")
