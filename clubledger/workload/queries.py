"""The registered queries: every operator over the derived inputs."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubledger.constants import ADDRESS_COLUMNS
from clubledger.functions.people import (
    add_tags,
    age_at,
    clear_property,
    gender_key,
    is_youth_group,
    person_label,
    remove_value,
    street_key,
)
from clubledger.operators import byexample, families, filters, households, memberships, sync
from clubledger.operators.addresses import address_list
from clubledger.operators.newsletter import (
    attribute_names,
    newsletter_emails,
    newsletter_rows,
    newsletter_text,
    payload_attributes,
    receiver_json,
    receiver_payload,
)
from clubledger.operators.statistics import club_statistics
from clubledger.operators.unsubscribe import unsubscribe
from clubledger.plans.main_people import main_people
from clubledger.session import new_table_path
from clubledger.sinks.stored import store_people
from clubledger.sources.exports import housemate_links, people_from_export
from clubledger.workload.inputs import (
    AS_OF,
    ASSEMBLY_YEAR,
    ORGAN_GROUPS,
    derived,
    people,
    raw_export,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _tags_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tags", F.array_join(F.array_sort("tags"), ","))


# -- newsletter ----------------------------------------------------------------
@query
def newsletter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newsletter_rows(people(spark, sf_dir), AS_OF)


@query
def newsletter_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newsletter_text(newsletter(spark, sf_dir))


@query
def newsletter_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_attributes(receiver_payload(newsletter(spark, sf_dir)))


@query
def receiver_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_names(receiver_payload(newsletter(spark, sf_dir)))


# -- ingest and column functions -----------------------------------------------
@query
def normalised_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = people_from_export(raw_export(spark, sf_dir), AS_OF)
    return typed.select(
        F.col("pos").alias("person_id"),
        "member_number",
        "gender",
        "first_name",
        "last_name",
        "street",
        "plz",
        "city",
        "birthday",
        "email",
        F.size("emails").cast("bigint").alias("n_emails"),
        "phone_p",
        "phone_m",
        "category",
        "date_added",
        "printed_magazine",
    )


@query
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = age_at(F.col("birthday"), AS_OF).cast("bigint")
    return people(spark, sf_dir).select("person_id", "birthday", age.alias("age"))


@query
def age_at_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = age_at(F.col("birthday"), F.col("date_added")).cast("bigint")
    return people(spark, sf_dir).select("person_id", age.alias("age"))


@query
def person_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("person_id", person_label().alias("label"))


@query
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select(
        "person_id",
        street_key(F.col("street")).alias("street_key"),
        gender_key(F.col("gender")).alias("gender_key"),
    )


@query
def youth_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = derived(spark, sf_dir, "organ_rows").where(F.col("function_name").isNotNull())
    return names.select(
        F.col("function_name").alias("riege"), is_youth_group(F.col("function_name")).alias("youth")
    ).distinct()


@query
def tags_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = add_tags(add_tags(people(spark, sf_dir), "BaseMember", "Archiv"), "BaseMember", "Neu")
    kept = remove_value(tagged, "tags", "Archiv")
    return _tags_text(kept.select("person_id", "tags"))


@query
def property_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared = remove_value(people(spark, sf_dir), "city", "Ort7")
    cleared = clear_property(cleared, "email", F.col("category") == "Gönner")
    return cleared.select("person_id", "city", "email", F.size("emails").cast("bigint").alias("n_emails"))


# -- lookups and lists ---------------------------------------------------------
@query
def lookup_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.lookup(people(spark, sf_dir), "first_name", "Vorname1")
    return found.select("person_id", "first_name", "last_name")


@query
def lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.lookup(people(spark, sf_dir), "birthday", None).select("person_id", "last_name")


@query
def lookup_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = dt.date(1999, 1, 1)
    found = filters.lookup(people(spark, sf_dir), "birthday", bound, "ge")
    found = filters.lookup(found, "birthday", dt.date(2005, 1, 1), lambda a, b: a < b)
    return found.select("person_id", "birthday")


@query
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_list(people(spark, sf_dir), "person_id")


@query
def adults_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin, end = dt.date(1986, 1, 1), dt.date(1987, 1, 1)
    return address_list(filters.adults_joined_between(people(spark, sf_dir), begin, end))


@query
def adults_joined_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_list(filters.adults_joined_between(people(spark, sf_dir), dt.date(2014, 1, 1)))


@query
def youth_born_in_1998(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_list(filters.youth_born_in_year(people(spark, sf_dir), 1998))


@query
def assembly_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.assembly_lists(people(spark, sf_dir), ASSEMBLY_YEAR)
    return address_list(rows, "person_id", "list_name")


@query
def no_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_list(filters.without_email(people(spark, sf_dir)))


@query
def honorary_no_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_list(filters.honorary_without_email(people(spark, sf_dir)))


@query
def magazine_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_list(filters.magazine_recipients(people(spark, sf_dir)))


@query
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = add_tags(people(spark, sf_dir), "BaseMember")
    everyone = families.add_people(tagged, add_tags(derived(spark, sf_dir, "extra"), "Extra"))
    counts = club_statistics(everyone, AS_OF)
    return counts.select(*[F.col(c).cast("bigint").alias(c) for c in counts.columns])


# -- families and households ---------------------------------------------------
@query
def mail_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.mail_families(people(spark, sf_dir))


@query
def mail_family_first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.family_values(people(spark, sf_dir), "first_name", "email")


@query
def mail_family_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.families_with_value(people(spark, sf_dir), "first_name", "Vorname7", "email")


@query
def mail_families_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = families.add_people(people(spark, sf_dir), derived(spark, sf_dir, "extra"))
    return families.mail_families(more)


@query
def household_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return households.household_sizes(people(spark, sf_dir))


@query
def household_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return households.households_with_value(people(spark, sf_dir), "birthday", None)


@query
def household_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipients = filters.magazine_recipients(people(spark, sf_dir))
    return households.sorted_household_list(households.household_list(recipients))


@query
def household_list_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipients = filters.magazine_recipients(people(spark, sf_dir))
    links = housemate_links(derived(spark, sf_dir, "housemates"))
    merged = households.combine_housemates(recipients, links)
    return households.sorted_household_list(households.household_list(merged))


@query
def housemate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = housemate_links(derived(spark, sf_dir, "housemates"))
    return links.select("group_pos", F.col("member_pos").cast("bigint").alias("member_pos"), "member_number")


# -- groups --------------------------------------------------------------------
@query
def group_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bag(spark, sf_dir).select("person_id", "riege", "role")


def _bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships.build_memberships(
        people(spark, sf_dir), derived(spark, sf_dir, "organ_rows"), organ_groups=ORGAN_GROUPS
    )


@query
def group_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships.rosters(
        people(spark, sf_dir), derived(spark, sf_dir, "organ_rows"), ORGAN_GROUPS
    )


@query
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships.roster_sizes(_bag(spark, sf_dir))


@query
def member_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships.member_groups(_bag(spark, sf_dir))


@query
def unknown_organs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships.unknown_organs(
        people(spark, sf_dir), derived(spark, sf_dir, "organ_rows"), ORGAN_GROUPS
    )


@query
def dropped_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships.dropped_rows(people(spark, sf_dir), derived(spark, sf_dir, "organ_rows"))


@query
def group_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships.overlap_cells(_bag(spark, sf_dir))


@query
def group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships.overlap_matrix(_bag(spark, sf_dir))


# -- unsubscribe, backup and examples ------------------------------------------
@query
def unsubscribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = unsubscribe(people(spark, sf_dir), derived(spark, sf_dir, "removelist"))
    return rest.select("person_id", "email", F.size("emails").cast("bigint").alias("n_emails"))


@query
def email_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = byexample.backfill(people(spark, sf_dir), derived(spark, sf_dir, "backup"), "email")
    return filled.select("person_id", "email", F.element_at("emails", 1).alias("first_of_emails"))


@query
def lost_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byexample.lost_emails(people(spark, sf_dir), derived(spark, sf_dir, "backup"))
    return address_list(found, "person_id")


@query
def cleared_by_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = byexample.clear_matching(
        people(spark, sf_dir), derived(spark, sf_dir, "clear_list"), "email"
    )
    return rest.select("person_id", "email")


@query
def extra_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = add_tags(derived(spark, sf_dir, "extra"), "NonMemberNewsletterRecipient")
    everyone = families.add_people(add_tags(people(spark, sf_dir), "BaseMember"), extra)
    return _tags_text(everyone.select("person_id", "email", "tags"))


def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_people(
        people(spark, sf_dir),
        derived(spark, sf_dir, "removelist"),
        derived(spark, sf_dir, "extra"),
    )


@query
def prepared_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c for c in ADDRESS_COLUMNS.values() if c]
    return _tags_text(_main(spark, sf_dir).select("person_id", "member_number", *columns, "tags"))


@query
def prepared_newsletter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newsletter_rows(_main(spark, sf_dir), AS_OF)


# -- synchronisation -----------------------------------------------------------
def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newsletter_emails(_main(spark, sf_dir))


@query
def sync_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.change_log(derived(spark, sf_dir, "receivers"), _incoming(spark, sf_dir), AS_OF)


@query
def sync_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.synced_snapshot(
        derived(spark, sf_dir, "receivers"), _incoming(spark, sf_dir), AS_OF
    )


@query
def sync_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.upsert_receivers(
        derived(spark, sf_dir, "receivers"), _incoming(spark, sf_dir), AS_OF
    )


@query
def sync_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for x in ("note", "alt", "firstname", "Alt")])
    receivers = derived(spark, sf_dir, "receivers").withColumn("global_attributes", known)
    incoming = receiver_payload(newsletter_rows(_main(spark, sf_dir), AS_OF))
    after = sync.synced_snapshot(receivers, incoming, AS_OF)
    return after.select("email", F.explode("global_attributes").alias("attribute", "attribute_value"))


@query
def lookup_not_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.lookup(people(spark, sf_dir), "birthday", None, "ne").select("person_id", "birthday")


@query
def group_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide matrix, cell by cell as its rows have them."""
    wide = memberships.overlap_wide(group_matrix(spark, sf_dir))
    return wide.select("riege", F.inline("cells"))


EXCLUDED = (3, 7, 32)


@query
def memberships_without_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    bag = memberships.build_memberships(
        people(spark, sf_dir), derived(spark, sf_dir, "organ_rows"),
        organ_groups=ORGAN_GROUPS, excluded=EXCLUDED,
    )
    return memberships.roster_sizes(bag)


@query
def excluded_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships.dropped_rows(
        people(spark, sf_dir), derived(spark, sf_dir, "organ_rows"), EXCLUDED
    )


@query
def preschool_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships.preschool_conflicts(people(spark, sf_dir), derived(spark, sf_dir, "organ_rows"))


@query
def address_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.address_problems(people(spark, sf_dir))


@query
def saved_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    receivers = derived(spark, sf_dir, "receivers")
    sleeping = sync.with_filter("sleeping", lambda day: sync.is_stale(day) & (F.col("status") != "active"))
    return sync.receivers_filtered(receivers, "sleeping", AS_OF, sleeping)


@query
def failed_sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions that the mailing service, by what the snapshot says, did not confirm."""
    receivers = derived(spark, sf_dir, "receivers")
    answer = F.when(F.col("status") == "bounce", "failed").when(
        F.col("updated").isNotNull(), F.when(F.col("step") == "push", "update success").otherwise("success")
    )
    steps = F.explode(F.array(F.lit("push"), F.lit("delete"))).alias("step")
    results = receivers.select("email", "updated", "status", steps).select(
        "email", "step", answer.alias("status")
    )
    log = sync.change_log(receivers, _incoming(spark, sf_dir), AS_OF)
    return sync.failed_actions(log, results)


@query
def receiver_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receiver_json(receiver_payload(newsletter(spark, sf_dir)))


@query
def receivers_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    receivers = derived(spark, sf_dir, "receivers")
    stale = sync.receivers_filtered(receivers, "stale", AS_OF)
    return sync.delete_receivers(receivers, stale)


@query
def stale_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.receivers_filtered(derived(spark, sf_dir, "receivers"), "stale", AS_OF)


@query
def inactive_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, emails = sync.activate_inactive(derived(spark, sf_dir, "receivers"))
    return emails


@query
def bounced_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.receivers_by_type(derived(spark, sf_dir, "receivers"), "bounce")


@query
def receiver_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.receiver_stats(derived(spark, sf_dir, "receivers"))


@query
def stale_receiver_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.receiver_stats(
        sync.receivers_filtered(derived(spark, sf_dir, "receivers"), "stale", AS_OF)
    )


# -- written on the way ----------------------------------------------------------
@query
def household_list_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipients = filters.magazine_recipients(people(spark, sf_dir))
    return households.printed_household_list(households.household_list(recipients))


def _stored_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_people(people(spark, sf_dir), new_table_path(spark, "stored-people"))


@query
def stored_adults_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin, end = dt.date(1986, 1, 1), dt.date(1987, 1, 1)
    return address_list(filters.adults_joined_between(_stored_people(spark, sf_dir), begin, end))


@query
def stored_lookup_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.lookup(_stored_people(spark, sf_dir), "member_number", 7)
    return found.select("person_id", "member_number", "first_name", "last_name")


@query
def sync_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after a sync of a stored one, in which some addresses are missing."""
    receivers = derived(spark, sf_dir, "receivers")
    gone = F.col("status") == "bounce"
    receivers = receivers.withColumn("email", F.when(~gone, F.col("email")))
    stored = sync.store_snapshot(receivers, f"receivers_{uuid.uuid4().hex}")
    return sync.snapshot_of(sync.merged_stored(stored, _incoming(spark, sf_dir), AS_OF))
