"""Club head counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubledger.constants import (
    ADULT_CATEGORIES,
    MALE,
    NON_ACTIVE_ADULT_CATEGORIES,
    STATISTICS_LABELS,
)
from clubledger.functions.people import age_at
from clubledger.operators.filters import base_members


def club_statistics(people: DataFrame, as_of: dt.date) -> DataFrame:
    """One row of counts over the base members.

    Only the male gender value counts as male, so a missing gender counts as
    female, and a missing category counts as a child. Missing ages are ignored.
    """
    adult = F.coalesce(F.col("category").isin(ADULT_CATEGORIES), F.lit(False))
    passive = F.coalesce(F.col("category").isin(NON_ACTIVE_ADULT_CATEGORIES), F.lit(False))
    male = F.col("gender").eqNullSafe(F.lit(MALE))
    age = age_at(F.col("birthday"), as_of)
    return base_members(people).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(adult).alias("adults"),
        F.count_if(adult & male).alias("men"),
        F.count_if(adult & male & ~passive).alias("active_men"),
        F.count_if(adult & male & passive).alias("passive_men"),
        F.count_if(adult & ~male).alias("women"),
        F.count_if(adult & ~male & ~passive).alias("active_women"),
        F.count_if(adult & ~male & passive).alias("passive_women"),
        F.count_if(~adult).alias("children"),
        F.count_if(~adult & male).alias("boys"),
        F.count_if(~adult & ~male).alias("girls"),
        F.max(age).alias("max_age"),
        F.min(age).alias("min_age"),
    )


def statistics_text(people: DataFrame, as_of: dt.date) -> DataFrame:
    """The same counts as a printable text, one line per figure."""
    text = [
        F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("-")))
        for label, c in STATISTICS_LABELS.items()
    ]
    return club_statistics(people, as_of).select(F.concat_ws("\n", *text).alias("statistics"))
