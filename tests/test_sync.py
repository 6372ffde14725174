"""Unsubscribing and the mailing service, step by step against a plain replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clubledger.constants import DELETE_OK, UPSERT_OK
from clubledger.functions.people import add_tags, remove_value
from clubledger.operators import quality, sync
from clubledger.operators.newsletter import newsletter_rows, receiver_json, receiver_payload
from clubledger.operators.quality import DataQualityError
from clubledger.operators.unsubscribe import unsubscribe
from clubledger.plans.main_people import main_people

TODAY = dt.date(2024, 2, 28)
RECEIVER = "receiver_id bigint, email string, updated date, status string"


def snapshot(seed, n=60):
    rnd = random.Random(seed)
    days = [None, TODAY, dt.date(2024, 1, 31)]
    kinds = ["active", "inactive", "bounce"]
    return [(i, f"m{i}", rnd.choice(days), rnd.choice(kinds)) for i in range(n)]


def replay(rows, incoming):
    """Push, delete what the push left stale, activate."""
    service = {email: [i, day, status] for i, email, day, status in rows}
    log = set()
    for email in incoming:
        if email in service:
            service[email][1] = TODAY
            log.add((email, "update"))
        else:
            service[email] = [None, TODAY, "active"]
            log.add((email, "insert"))
    for email in [e for e, r in service.items() if r[1] != TODAY]:
        del service[email]
        log.add((email, "delete"))
    for email, row in service.items():
        if row[2] == "inactive":
            row[2] = "active"
            log.add((email, "activate"))
    return service, log


@pytest.mark.parametrize("seed", [1, 2])
def test_sync(spark, seed):
    rows = snapshot(seed)
    incoming = [f"m{i}" for i in range(0, 90, 2)]
    receivers = spark.createDataFrame(rows, RECEIVER).repartition(7)
    pushed = spark.createDataFrame([(e,) for e in incoming], "email string")
    service, log = replay(rows, incoming)
    changes = [tuple(r) for r in sync.change_log(receivers, pushed, TODAY).collect()]
    assert sorted(changes) == sorted(log)
    after = sync.synced_snapshot(receivers, pushed, TODAY).collect()
    assert {r.email: [r.receiver_id, r.updated, r.status] for r in after} == service
    assert len(after) == len(service)


def test_steps_agree_with_the_whole(spark):
    receivers = spark.createDataFrame(snapshot(3), RECEIVER)
    pushed = spark.createDataFrame([(f"m{i}",) for i in range(40, 70)], "email string")
    kept, removed = sync.remove_stale(sync.upsert_receivers(receivers, pushed, TODAY), TODAY)
    done, activated = sync.activate_inactive(kept)
    whole = sync.synced_snapshot(receivers, pushed, TODAY)
    assert sorted(map(str, done.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    log = sync.change_log(receivers, pushed, TODAY)
    assert {r.email for r in removed.collect()} == {r.email for r in log.where("action = 'delete'").collect()}
    assert {r.email for r in activated.collect()} == {
        r.email for r in log.where("action = 'activate'").collect()
    }


def test_types_filters_and_counts(spark):
    rows = snapshot(4)
    receivers = spark.createDataFrame(rows, RECEIVER)
    assert sync.receivers_by_type(receivers, "bounce").count() == sum(r[3] == "bounce" for r in rows)
    assert sync.receivers_by_type(receivers, "all").count() == len(rows)
    assert sync.receivers_by_type(receivers).count() == len(rows)
    with pytest.raises(ValueError):
        sync.receivers_by_type(receivers, "unknown")
    stale = sync.receivers_filtered(receivers, "stale", TODAY)
    assert stale.count() == sum(r[2] != TODAY for r in rows)
    never = sync.with_filter("never", lambda day: F.col("updated").isNull())
    assert set(never) == {"stale", "never"}
    found = sync.receivers_filtered(receivers, "never", TODAY, never)
    assert found.count() == sum(r[2] is None for r in rows)
    counts = sync.receiver_stats(receivers).first()
    assert counts.total_count == len(rows)
    assert counts.inactive_count == sum(r[3] == "inactive" for r in rows)
    left = sync.delete_receivers(receivers, stale)
    assert left.count() == len(rows) - stale.count()


def test_per_row_results(spark):
    results = spark.createDataFrame([(1, UPSERT_OK), (2, UPSERT_OK)], "id int, status string")
    assert quality.require_none(quality.failed_results(results, UPSERT_OK), "push").count() == 0
    mixed = spark.createDataFrame([(1, DELETE_OK), (2, "error"), (3, None)], "id int, status string")
    assert quality.failed_results(mixed, DELETE_OK).count() == 2
    with pytest.raises(quality.DataQualityError):
        quality.require_none(quality.failed_results(mixed, DELETE_OK), "delete")


def people(spark):
    rows = [
        (1, 1, "Anna", "A", "Weiblich", "x@y", ["x@y", "alt@y"], "Gönner"),
        (2, 2, "Beat", "B", "Männlich", "x@y", ["x@y"], "Passivmitglied"),
        (3, 3, "Cora", "C", None, "z@y", ["z@y"], None),
        (4, 4, "Dino", "D", "Männlich", None, None, "Knaben"),
        (5, 5, "Eva", "E", "Weiblich", "", [""], "Knaben"),
    ]
    return spark.createDataFrame(
        rows,
        "person_id bigint, pos bigint, first_name string, last_name string, gender string,"
        " email string, emails array<string>, category string",
    )


def test_unsubscribe(spark):
    listed = spark.createDataFrame([("x@y",), ("x@y",), (None,), ("alt@y",)], "email string")
    rest = unsubscribe(people(spark), listed)
    assert {r.person_id: (r.email, r.emails) for r in rest.collect()} == {
        1: (None, None),
        2: (None, None),
        3: ("z@y", ["z@y"]),
        4: (None, None),
        5: ("", [""]),
    }


def test_extra_recipients_escape_the_unsubscribe_list(spark):
    listed = spark.createDataFrame([("x@y",)], "email string")
    extra = spark.createDataFrame([(-1, 9, "x@y")], "person_id bigint, pos bigint, email string")
    main = main_people(people(spark), listed, extra)
    assert {(r.person_id, r.email) for r in main.where("email = 'x@y'").collect()} == {(-1, "x@y")}
    tags = {r.person_id: r.tags for r in main.collect()}
    assert tags[1] == ["BaseMember"] and tags[-1] == ["NonMemberNewsletterRecipient"]


def test_newsletter_flags_of_missing_values(spark):
    rows = {r.Email: r for r in newsletter_rows(people(spark), TODAY).collect()}
    assert set(rows) == {"x@y", "z@y"}
    assert rows["z@y"].maennlich is False and rows["z@y"].weiblich is False
    assert rows["x@y"].firstname == "Anna & Beat" and rows["x@y"].passivmitglied


def test_hot_address(spark):
    """A third of all rows share an address; its names stay whole."""
    rows = spark.range(3000).select(
        F.col("id").alias("person_id"),
        F.concat(F.lit("V"), (F.col("id") % 50).cast("string")).alias("first_name"),
        F.when(F.col("id") % 2 == 0, "N").alias("last_name"),
        F.lit("Männlich").alias("gender"),
        F.lit("Knaben").alias("category"),
        F.when(F.col("id") % 3 == 0, "junk").otherwise(F.col("id").cast("string")).alias("email"),
    )
    table = newsletter_rows(rows, TODAY)
    assert table.count() == 2001
    junk = table.where("Email = 'junk'").first()
    assert junk.firstname.split(" & ") == sorted(f"V{i}" for i in range(50))
    assert junk.lastname == "N" and junk.knaben and junk.maennlich and not junk.weiblich
    assert table.where("Email = '1'").first().firstname == "V1"


def test_payload(spark):
    payload = receiver_payload(newsletter_rows(people(spark), TODAY))
    row = payload.where("email = 'x@y'").first()
    assert row.source == "User Import" and row.tags == [] and row.attributes == {}
    assert row.global_attributes["updated"] == "28.02.2024"
    assert row.global_attributes["maennlich"] == "True"
    assert "Email" not in row.global_attributes
    assert len(row.global_attributes) == 15
    text = receiver_json(payload).where("value LIKE '%z@y%'").first().value
    assert text.startswith('{"email":"z@y","source":"User Import"')


def test_tags(spark):
    tagged = add_tags(add_tags(people(spark), "a", "b"), "b", "c")
    assert tagged.first().tags == ["a", "b", "c"]
    assert remove_value(tagged, "tags", "b").first().tags == ["a", "c"]
    cleared = remove_value(people(spark), "email", "x@y")
    assert cleared.where("email = 'x@y'").count() == 0
    assert cleared.where("person_id = 1").first().emails is None
    untouched = remove_value(people(spark), "email", None)
    assert untouched.where("email IS NULL").count() == 1


def test_attributes_of_a_push(spark):
    day = TODAY
    schema = "receiver_id bigint, email string, updated date, status string, global_attributes map<string,string>"
    receivers = spark.createDataFrame(
        [(1, "a", None, "active", {"x": "1", "y": "2"}), (2, "b", day, "inactive", {"x": "3"}), (3, "c", None, "bounce", None)],
        schema,
    )
    pushed = spark.createDataFrame(
        [("a", {"y": "9", "z": None}), ("d", {"y": "8"})], "email string, global_attributes map<string,string>"
    )
    after = {r.email: r.global_attributes for r in sync.synced_snapshot(receivers, pushed, day).collect()}
    assert after == {"a": {"x": "1", "y": "9", "z": None}, "b": {"x": "3"}, "d": {"y": "8"}}
    assert "c" in {r.email for r in sync.upsert_receivers(receivers, pushed, day).collect()}
    twice = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "email string")
    assert {(r.email, r.n) for r in sync.address_problems(twice).collect()} == {("a", 2), (None, 1)}
    with pytest.raises(DataQualityError):
        sync.address_problems(twice, strict=True)
