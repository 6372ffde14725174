"""Positions, stored people and stored snapshots: same results, less read or moved."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from clubledger.operators import filters, sync
from clubledger.operators.order import with_position
from clubledger.session import new_table_path
from clubledger.sinks.stored import store_people

TODAY = dt.date(2024, 2, 28)
RECEIVER = "receiver_id bigint, email string, updated date, status string"


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_positions_are_those_of_the_sorted_list(spark, partitions):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "b", "hot", "hot", "hot"]), i) for i in range(500)]
    table = spark.createDataFrame(rows, "k string, i bigint").repartition(partitions)
    found = with_position(table, F.asc_nulls_last("k"), F.desc("i"))
    assert found.columns == ["position", "k", "i"]
    expected = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -r[1]))
    got = [(r["k"], r["i"]) for r in sorted(found.collect(), key=lambda r: r["position"])]
    assert got == expected
    assert sorted(r["position"] for r in found.collect()) == list(range(1, 501))


def test_positions_of_equal_rows_and_of_none(spark):
    same = spark.createDataFrame([("x",)] * 40, "k string")
    assert sorted(r["position"] for r in with_position(same, F.asc("k")).collect()) == list(range(1, 41))
    assert with_position(same.limit(0), F.asc("k")).count() == 0


def scanned_rows(df):
    """The rows that the scan of a plan without shuffles let through."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def test_lookups_on_stored_people_read_few_row_groups(spark):
    n = 20000
    rnd = random.Random(4)
    numbers = rnd.sample(range(10**9), n)
    start = dt.date(1950, 1, 1)
    rows = [
        (i, None if i % 3 == 0 else start + dt.timedelta(days=i % 20000), numbers[i], f"m{numbers[i]}@x.org")
        for i in range(n)
    ]
    people = spark.createDataFrame(
        rows, "person_id bigint, date_added date, member_number bigint, email string"
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or the metrics are elsewhere
    try:
        stored = store_people(people, new_table_path(spark, "people"), row_group_bytes=16384)
        assert sorted(stored.collect()) == sorted(people.collect())
        span = stored.where(filters.in_range(F.col("date_added"), dt.date(1986, 1, 1), dt.date(1987, 1, 1)))
        assert span.count() == sum(
            r[1] is not None and r[1].year == 1986 for r in rows
        ) and scanned_rows(span) < n / 8
        number = filters.lookup(stored, "member_number", numbers[77])
        assert [r["person_id"] for r in number.collect()] == [77]
        assert scanned_rows(number) < n / 8
        mail = filters.lookup(stored, "email", rows[5000][3])
        assert [r["person_id"] for r in mail.collect()] == [5000]
        assert scanned_rows(mail) < n / 8
        assert filters.lookup(stored, "date_added", None).count() == sum(r[1] is None for r in rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def receivers(spark, n=80):
    rnd = random.Random(6)
    days, kinds = [None, TODAY, dt.date(2024, 1, 31)], ["active", "inactive", "bounce"]
    rows = [
        (i, None if i % 3 == 0 else f"m{i}", rnd.choice(days), rnd.choice(kinds)) for i in range(n)
    ]
    return spark.createDataFrame(rows, RECEIVER)


@pytest.mark.parametrize("attributes", [False, True])
def test_stored_snapshot_merges_like_any_other(spark, attributes):
    before = receivers(spark)
    push = spark.createDataFrame([(f"m{i}",) for i in range(40, 120)], "email string")
    if attributes:
        before = before.withColumn("global_attributes", F.create_map(F.lit("a"), F.lit("old")))
        push = push.withColumn("global_attributes", F.create_map(F.lit("a"), F.col("email")))
    stored = sync.store_snapshot(before, f"snapshot_{uuid.uuid4().hex}")
    assert stored.receivers().count() == before.count()
    rows = sync.merged_stored(stored, push, TODAY)
    expected = sync.merged(before, push, TODAY)
    assert rows.columns == expected.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, expected.collect()))


def test_stored_snapshot_is_not_shuffled(spark, capsys):
    name = f"snapshot_{uuid.uuid4().hex}"
    stored = sync.store_snapshot(receivers(spark), name)
    push = spark.range(100).select(F.concat(F.lit("m"), "id").alias("email"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capsys.readouterr()
        sync.merged_stored(stored, push, TODAY).explain()
        tree = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tree.count("Exchange") == 1
    # The one there is is on the side of the push.
    below = tree[tree.index("Exchange"):].splitlines()
    assert any("Range" in line for line in below[:4]) and "Bucketed: true" in tree
