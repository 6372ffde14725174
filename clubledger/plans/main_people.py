"""The shared first step of every flow: people ready for the exports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clubledger.constants import TAG_BASE_MEMBER, TAG_EXTRA_RECIPIENT
from clubledger.functions.people import add_tags
from clubledger.operators.families import add_people
from clubledger.operators.unsubscribe import unsubscribe


def main_people(members: DataFrame, removed: DataFrame, extra: DataFrame) -> DataFrame:
    """Members, tagged and with unsubscribed addresses cleared, plus extra recipients.

    Extra recipients come last, so the unsubscribe list does not touch them.
    """
    people = unsubscribe(add_tags(members, TAG_BASE_MEMBER), removed)
    return add_people(people, add_tags(extra, TAG_EXTRA_RECIPIENT))
