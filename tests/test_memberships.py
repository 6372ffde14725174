"""Group rows, rosters and the overlap matrix against nested loops."""

import csv
from pathlib import Path

import random

import pytest
from pyspark.sql import functions as F

from clubledger.constants import COACH_FUNCTIONS, ORGAN_GROUPS, YOUTH_GROUP_MARKERS
from clubledger.operators import memberships, quality

ORGANS = {"A": ["R1", "R2"], "B": ["Kids 1"], "K": ["Kitu"]}
from clubledger.sinks import files


def sample(spark, seed=1):
    rnd = random.Random(seed)
    people = [
        (i, None if rnd.random() < 0.1 else rnd.choice([i, i, i, 5]), rnd.choice(["Kitu (Kinder)", "X", None]))
        for i in range(30)
    ]
    functions = ["R1", "R2", "R3", "Kids 1", "Leiter", "Leiterin", None]
    rows = [
        (
            i,
            rnd.choice([None, 317492, *range(35)]),
            rnd.choice(functions),
            rnd.choice(["A", "B", "K", "unknown", None]),
        )
        for i in range(200)
    ]
    people_df = spark.createDataFrame(people, "person_id bigint, member_number bigint, category string")
    rows_df = spark.createDataFrame(rows, "row_id bigint, member_number bigint, function_name string, organ string")
    return people, rows, people_df, rows_df


def expected_bag(people, rows):
    bag, unknown, dropped = [], 0, 0
    for _, number, function, organ in rows:
        owners = [p for p in people if number is not None and p[1] == number]
        if len(owners) != 1 or number == 317492:
            dropped += 1
            continue
        person = owners[0][0]
        if function in COACH_FUNCTIONS:
            unknown += organ not in ORGANS
            bag += [(person, g, "coach") for g in ORGANS.get(organ, [])]
        elif function is not None:
            bag.append((person, function, "member"))
    bag += [(p[0], "Kitu", "member") for p in people if p[2] == "Kitu (Kinder)"]
    return bag, unknown, dropped


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_bag(spark, partitions):
    people, rows, people_df, rows_df = sample(spark)
    bag, unknown, dropped = expected_bag(people, rows)
    found = memberships.build_memberships(people_df, rows_df.repartition(partitions), organ_groups=ORGANS)
    assert sorted(tuple(r) for r in found.collect()) == sorted(bag)
    strange = memberships.unknown_organs(people_df, rows_df, ORGANS)
    assert sum(r.n_rows for r in strange.collect()) == unknown
    lost = memberships.dropped_rows(people_df, rows_df)
    assert sum(r.n_rows for r in lost.collect()) == dropped
    assert {r.reason for r in lost.collect()} == {"no number", "excluded", "unmatched", "ambiguous"}


def test_member_groups(spark):
    people, rows, people_df, rows_df = sample(spark)
    bag, _, _ = expected_bag(people, rows)
    found = memberships.build_memberships(people_df, rows_df, organ_groups=ORGANS)
    groups = {r.riege for r in memberships.member_groups(found).collect()}
    assert groups == {g for _, g, role in bag if role == "member"} | {"Kitu"}
    nobody = memberships.member_groups(found.where("false"))
    assert [r.riege for r in nobody.collect()] == ["Kitu"]


def overlap(bag):
    grown = {}
    for person, group, _ in bag:
        if not any(m in group for m in YOUTH_GROUP_MARKERS):
            grown.setdefault(group, []).append(person)
    return {(a, b): sum(p in grown[b] for p in grown[a]) for a in grown for b in grown}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlap_matrix(spark, seed):
    people, rows, people_df, rows_df = sample(spark, seed)
    bag, _, _ = expected_bag(people, rows)
    bag.append((1000, "R4", "member"))
    df = spark.createDataFrame(bag, "person_id bigint, riege string, role string").repartition(7)
    expected = overlap(bag)
    assert {(r.riege, r.other): r.n for r in memberships.overlap_matrix(df).collect()} == expected
    non_zero = {k: n for k, n in expected.items() if n}
    assert {(r.riege, r.other): r.n for r in memberships.overlap_cells(df).collect()} == non_zero
    assert expected[("R4", "R1")] == 0
    names = sorted({a for a, _ in expected})
    matrix = memberships.overlap_matrix(df)
    wide = memberships.overlap_wide(matrix)
    cells = {(r.riege, c.other): c.n for r in wide.collect() for c in r.cells}
    assert cells == expected
    lines = list(csv.reader(r.value for r in memberships.overlap_lines(wide).collect()), )
    lines = [line[0].split(";") for line in lines]
    assert lines[0] == ["riege", *names]
    assert lines[1:] == [[a, *[str(expected[a, b]) for b in names]] for a in names]


def test_matrix_of_many_groups(spark, tmp_path):
    """A wide file of 1,500 groups, most of which share nobody."""
    bag = spark.range(4500).select(
        (F.col("id") % 3000).alias("person_id"),
        F.format_string('R"%04d, x', F.col("id") % 1500).alias("riege"),
        F.lit("member").alias("role"),
    )
    path = str(tmp_path / "wide")
    files.write_matrix(memberships.overlap_wide(memberships.overlap_matrix(bag)), path)
    parts = sorted(Path(path).glob("part-*"))
    lines = list(csv.reader("".join(p.read_text() for p in parts).splitlines()))
    names = [f'R"{i:04d}, x' for i in range(1500)]
    assert lines[0] == ["riege", *names] and [x[0] for x in lines[1:]] == names
    for i, line in enumerate(lines[1:]):
        assert [j for j, n in enumerate(line[1:]) if n != "0"] == [i]
        assert line[1 + i] == "3"


def test_preschool_conflict(spark):
    people = spark.createDataFrame([(1, 1, "Kitu (Kinder)")], "person_id bigint, member_number bigint, category string")
    schema = "row_id bigint, member_number bigint, function_name string, organ string"
    fine = spark.createDataFrame([(1, 1, "R1", None)], schema)
    listed = spark.createDataFrame([(1, 1, "Kitu", None)], schema)
    quality.require_none(memberships.preschool_conflicts(people, fine), "listed")
    with pytest.raises(quality.DataQualityError):
        quality.require_none(memberships.preschool_conflicts(people, listed), "listed")
    offending = quality.require_none(memberships.preschool_conflicts(people, listed), "x", strict=False)
    assert offending.count() == 1


def test_organ_list_has_no_empty_entry():
    assert len(ORGAN_GROUPS) == 24
    assert all(ORGAN_GROUPS.values())


def test_hot_member_number(spark):
    """Most rows name one member: no row is lost or repeated."""
    people = spark.range(20).select(F.col("id").alias("person_id"), F.col("id").alias("member_number"), F.lit("X").alias("category"))
    number = F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 30)
    rows = spark.range(3000).select(
        F.col("id").alias("row_id"),
        number.cast("bigint").alias("member_number"),
        F.concat(F.lit("R"), (F.col("id") % 5).cast("string")).alias("function_name"),
        F.lit(None).cast("string").alias("organ"),
    )
    found = memberships.build_memberships(people, rows, organ_groups=ORGANS)
    assert found.count() == rows.where("member_number < 20").count()
