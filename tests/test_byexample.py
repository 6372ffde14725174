"""Matching by example against the comparison of everyone with everyone."""

import random

import pytest

from clubledger.operators import byexample
from clubledger.operators.quality import DataQualityError

FIELDS = ["member_number", "first_name", "last_name", "plz"]
SCHEMA = "member_number bigint, first_name string, last_name string, plz string, email string"


def sample(spark, seed):
    rnd = random.Random(seed)

    def record(gaps):
        values = [rnd.randint(1, 12), f"V{rnd.randint(0, 3)}", f"N{rnd.randint(0, 3)}", str(rnd.randint(0, 2))]
        return [None if rnd.random() < gaps else v for v in values]

    people = [(i, i, *record(0.1), None if rnd.random() < 0.5 else f"own{i}") for i in range(60)]
    refs = [(i, *record(0.45), None if rnd.random() < 0.2 else f"ref{i}") for i in range(25)]
    people_df = spark.createDataFrame(people, f"person_id bigint, pos bigint, {SCHEMA}")
    refs_df = spark.createDataFrame(refs, f"ref_pos bigint, {SCHEMA}")
    return people, refs, people_df, refs_df


def matches(person, ref):
    return all(r is None or p == r for p, r in zip(person[2:6], ref[1:5], strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_backfill(spark, seed):
    people, refs, people_df, refs_df = sample(spark, seed)
    expected = {}
    for p in people:
        offers = [r[5] for r in refs if r[5] is not None and matches(p, r)]
        expected[p[0]] = p[6] or (offers[0] if offers else None)
    filled = byexample.backfill(people_df, refs_df, "email")
    assert {r.person_id: r.email for r in filled.collect()} == expected
    assert filled.count() == len(people)
    lost = byexample.lost_emails(people_df, refs_df)
    assert {r.person_id: r.email for r in lost.collect()} == {
        p[0]: expected[p[0]] for p in people if p[6] is None and expected[p[0]]
    }


@pytest.mark.parametrize("seed", [4, 5])
def test_clear(spark, seed):
    people, refs, people_df, refs_df = sample(spark, seed)
    examples = refs_df.drop("email")
    cleared = byexample.clear_matching(people_df, examples, "email")
    expected = {p[0]: None if any(matches(p, r) for r in refs) else p[6] for p in people}
    assert {r.person_id: r.email for r in cleared.collect()} == expected


def test_reference_without_properties_matches_everybody(spark):
    _, _, people_df, _ = sample(spark, 6)
    empty = spark.createDataFrame([(0, None, None, None, None, "all")], f"ref_pos bigint, {SCHEMA}")
    filled = byexample.backfill(people_df, empty, "email")
    assert filled.where("email IS NULL").count() == 0
    assert byexample.empty_references(people_df, empty, ["email"]).count() == 1
    with pytest.raises(DataQualityError):
        byexample.empty_references(people_df, empty, ["email"], strict=True)


def test_lists_must_be_equal_unless_left_out(spark):
    people = spark.createDataFrame(
        [(1, "A", ["x"], None), (2, "A", [], None)],
        "person_id bigint, first_name string, tags array<string>, email string",
    )
    ref = spark.createDataFrame([(1, "A", [], "new")], "ref_pos bigint, first_name string, tags array<string>, email string")
    strict = byexample.fill_from_references(people, ref, "email")
    assert [r.person_id for r in strict.collect()] == [2]
    loose = byexample.fill_from_references(people, ref, "email", ["tags"])
    assert sorted(r.person_id for r in loose.collect()) == [1, 2]


def test_other_properties_can_be_filled(spark):
    people, refs, people_df, refs_df = sample(spark, 7)
    filled = byexample.backfill(people_df.drop("email"), refs_df.drop("email"), "plz")
    expected = {}
    for p in people:
        offers = [
            r[4]
            for r in refs
            if r[4] is not None and all(x is None or y == x for x, y in zip(r[1:4], p[2:5], strict=True))
        ]
        expected[p[0]] = p[5] if p[5] is not None else (offers[0] if offers else None)
    assert {r.person_id: r.plz for r in filled.collect()} == expected


def test_nothing_to_match_is_refused(spark):
    _, _, people_df, refs_df = sample(spark, 8)
    with pytest.raises(ValueError):
        byexample.matching_people(people_df, refs_df.select("ref_pos"))


def test_types_of_the_people_count(spark):
    people = spark.createDataFrame([(1, 5, None)], "person_id bigint, member_number bigint, email string")
    ref = spark.createDataFrame([(1, 5, "new")], "ref_pos bigint, member_number int, email string")
    assert byexample.backfill(people, ref, "email").first().email == "new"


def test_order_of_tags_says_nothing(spark):
    schema = "first_name string, tags array<string>, email string"
    people = spark.createDataFrame([(1, "A", ["x", "y"], None)], f"person_id bigint, {schema}")
    ref = spark.createDataFrame([(1, "A", ["y", "x", "y"], "new")], f"ref_pos bigint, {schema}")
    assert byexample.backfill(people, ref, "email").first().email == "new"


def test_many_combinations_of_properties(spark):
    # 22 properties, over a thousand sets of filled ones: a person is keyed at most
    # once per property, and the result is that of comparing everyone with everyone.
    rnd = random.Random(12)
    fields = [f"f{i:02d}" for i in range(22)]
    people = [(i, *[rnd.randint(0, 1) for _ in fields]) for i in range(120)]
    refs = []
    for i in range(1500):
        own = rnd.choice(people)[1:]
        shown = {0, *rnd.sample(range(22), rnd.randint(1, 12))}
        refs.append((i, *[v if k in shown else None for k, v in enumerate(own)]))
    refs = [r for r in refs if rnd.random() < 0.98]
    assert len({tuple(v is None for v in r[1:]) for r in refs}) > 1000
    columns = ", ".join(f"{f} int" for f in fields)
    people_df = spark.createDataFrame(people, f"person_id bigint, {columns}")
    refs_df = spark.createDataFrame(refs, f"ref_pos bigint, {columns}")
    found = {r.person_id for r in byexample.matching_people(people_df, refs_df).collect()}
    assert found == {
        p[0] for p in people
        if any(all(v is None or v == w for v, w in zip(r[1:], p[1:], strict=True)) for r in refs)
    }


def test_people_are_not_dealt_out_by_property(spark):
    # Few properties, so few tasks: every task would read all people who have one.
    _, _, people_df, refs_df = sample(spark, 9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = byexample.matching_people(people_df, refs_df)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
