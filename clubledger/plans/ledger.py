"""One club's data, loaded once, and every list that can be made from it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubledger.constants import ORGAN_GROUPS, RECEIVER_TYPES
from clubledger.operators import filters, memberships, quality
from clubledger.operators.addresses import address_list
from clubledger.operators.byexample import empty_references, lost_emails
from clubledger.operators.households import (
    combine_housemates,
    household_list,
    sorted_household_list,
)
from clubledger.operators.newsletter import (
    newsletter_rows,
    receiver_payload,
)
from clubledger.operators.statistics import club_statistics, statistics_text
from clubledger.operators.sync import (
    StoredSnapshot,
    address_problems,
    confirmed_snapshot,
    failed_actions,
    log_of,
    merged,
    merged_stored,
    problem_log,
    snapshot_of,
)
from clubledger.plans.main_people import main_people
from clubledger.session import new_table_path, write_through
from clubledger.sinks import files
from clubledger.sinks.stored import store_people
from clubledger.sources import exports


# What a receiver can be; "all" asks for every one of them.
STATUSES = [t for t in RECEIVER_TYPES if t != "all"]


@dataclass
class Ledger:
    """People after unsubscribing and additions, with the group file beside them."""

    people: DataFrame
    group_rows: DataFrame
    links: DataFrame
    lost: DataFrame
    as_of: dt.date
    organ_groups: Mapping[str, Sequence[str]] = field(default_factory=lambda: ORGAN_GROUPS)
    strict: bool = False

    def __post_init__(self) -> None:
        if self.strict:
            base = filters.base_members(self.people)
            quality.require_none(
                memberships.unknown_organs(base, self.group_rows, self.organ_groups),
                "a coach row names an organ that is not in the organ list",
            )
            quality.require_none(
                memberships.preschool_conflicts(base, self.group_rows, self.organ_groups),
                "the group file already lists pre-school members",
            )

    # -- lists -----------------------------------------------------------------
    def newsletter(self) -> DataFrame:
        return newsletter_rows(self.people, self.as_of)

    def receivers(self) -> DataFrame:
        return receiver_payload(self.newsletter())

    def rosters(self) -> DataFrame:
        """Groups of the base members; extra recipients are in no group."""
        base = filters.base_members(self.people)
        return memberships.rosters(base, self.group_rows, self.organ_groups)

    def memberships(self) -> DataFrame:
        base = filters.base_members(self.people)
        return memberships.build_memberships(
            base, self.group_rows, organ_groups=self.organ_groups
        )

    def overlap(self) -> DataFrame:
        return memberships.overlap_matrix(self.memberships())

    def magazine_list(self) -> DataFrame:
        recipients = filters.magazine_recipients(self.people)
        return sorted_household_list(household_list(combine_housemates(recipients, self.links)))

    def no_mail(self) -> DataFrame:
        found = filters.without_email(self.people)
        return address_list(
            quality.require_some(found, "everybody has an e-mail address", self.strict)
        )

    def honorary_no_mail(self) -> DataFrame:
        return address_list(filters.honorary_without_email(self.people))

    def joined_between(self, begin: dt.date | None, end: dt.date | None) -> DataFrame:
        return address_list(filters.adults_joined_between(self.people, begin, end))

    def youth_born_in(self, year: int) -> DataFrame:
        return address_list(filters.youth_born_in_year(self.people, year))

    def assembly_lists(self, year: int) -> DataFrame:
        return address_list(filters.assembly_lists(self.people, year), "list_name")

    def statistics(self) -> DataFrame:
        return club_statistics(self.people, self.as_of)

    def statistics_text(self) -> DataFrame:
        return statistics_text(self.people, self.as_of)

    def lost_emails(self) -> DataFrame:
        return address_list(self.lost)

    # -- synchronisation -------------------------------------------------------
    def sync(self, snapshot: DataFrame | StoredSnapshot) -> tuple[DataFrame, DataFrame]:
        """Change log and new snapshot of the mailing service, attributes included.
        A stored snapshot is merged without a shuffle of it.

        Both come from one merged table, which is written once and checked by that
        write. Addresses of the snapshot that are missing or repeated are in the log;
        with ``strict``, they and statuses that nobody knows are errors, and nothing
        is published.
        """
        stored = isinstance(snapshot, StoredSnapshot)
        whole = snapshot.receivers() if stored else snapshot
        merge = merged_stored if stored else merged
        address_problems(whole, self.strict)
        incoming = self.receivers().select("email", "global_attributes")
        known = F.col("status").isin(*STATUSES)
        checks = {
            "no_address": F.col("email").isNull(),
            "unknown_status": F.col("status").isNull() | ~known,
        }
        rows, _ = quality.audited_write(
            merge(snapshot, incoming, self.as_of), "sync", checks, self.strict
        )
        return log_of(rows).unionByName(problem_log(whole)), snapshot_of(rows)

    def confirm(
        self, snapshot: DataFrame, log: DataFrame, after: DataFrame, results: DataFrame
    ) -> tuple[DataFrame, DataFrame]:
        """Failed actions of a sync and the snapshot without them, by the answers
        ``results(email, step, status)`` of the mailing service. With ``strict``, a
        failed action is an error."""
        failed, _ = quality.audited_write(
            failed_actions(log, results), "failed", {"failed": F.lit(True)}, self.strict
        )
        return failed, confirmed_snapshot(snapshot, after, failed)

    # -- files -----------------------------------------------------------------
    def export(self, name: str, folder: str, fmt: str = "csv", **arguments) -> str:
        """Write one of the lists by name under ``folder``; returns where it went."""
        base = folder.rstrip("/")
        if name == "newsletter":
            files.write_newsletter(self.newsletter(), f"{base}/newsletter")
            return f"{base}/newsletter"
        if name == "receivers":
            files.write_payload(self.receivers(), f"{base}/receivers")
            return f"{base}/receivers"
        if name == "rosters":
            return files.write_rosters(self.rosters(), f"{base}/rosters", self.as_of, fmt)
        if name == "overlap":
            wide = memberships.overlap_wide(self.overlap())
            files.write_matrix(wide, f"{base}/overlap", fmt)
            return f"{base}/overlap"
        if name == "assembly_lists":
            rows = self.assembly_lists(**arguments)
            files.write_partitioned(rows, "list_name", f"{base}/assembly_lists", fmt)
            return f"{base}/assembly_lists"
        lists = {
            "magazine_list": self.magazine_list,
            "no_mail": self.no_mail,
            "honorary_no_mail": self.honorary_no_mail,
            "joined_between": self.joined_between,
            "youth_born_in": self.youth_born_in,
            "statistics": self.statistics,
            "lost_emails": self.lost_emails,
        }
        files.write_list(lists[name](**arguments), f"{base}/{name}", fmt)
        return f"{base}/{name}"


def load_ledger(
    spark: SparkSession,
    members: str,
    groups: str,
    as_of: dt.date,
    extra: str | None = None,
    removed: str | None = None,
    backup: str | None = None,
    housemates: str | None = None,
    strict: bool = False,
    multi_line: bool = True,
    clustered: bool = False,
) -> Ledger:
    """Read all files of a club and prepare the people every list starts from.

    The prepared people are written once to the shared folder, since every list
    reads them; ``clustered`` for many lookups by date, number or address, which costs
    a shuffle of them once.
    """
    def read(path: str, source: int) -> DataFrame:
        return exports.read_people(spark, path, as_of, source=source, multi_line=multi_line)

    own = exports.number_people(read(members, 0), "members")

    def side_list(path: str | None) -> DataFrame:
        return read(path, 1) if path else own.limit(0)

    # Extra recipients are numbered below zero, apart from the members.
    extras = side_list(extra).withColumn("person_id", -1 - F.monotonically_increasing_id())
    references = side_list(backup).withColumn("ref_pos", F.col("pos"))
    prepared = main_people(own, side_list(removed).select("email"), extras.select(*own.columns))
    if clustered:
        people = store_people(prepared, new_table_path(spark, "people"))
    else:
        people = write_through(prepared, "people")
    if strict:
        empty_references(own, references.where(F.col("email").isNotNull()), ["email"], strict)
    return Ledger(
        people=people,
        group_rows=exports.read_group_rows(spark, groups, multi_line=multi_line),
        links=exports.read_housemates(spark, housemates),
        lost=lost_emails(own, references.drop("person_id")),
        as_of=as_of,
        strict=strict,
    )
