"""Taking unsubscribed addresses off people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubledger.functions.people import set_email
from clubledger.operators.skew import skew_join


def unsubscribe(people: DataFrame, removed: DataFrame) -> DataFrame:
    """Clear the address of everyone whose primary address is on the list.

    Alternative addresses go with it. Matching is exact; entries without an
    address do nothing.
    """
    listed = removed.where(F.col("email").isNotNull()).select("email").distinct()
    marked = skew_join(people, listed.withColumn("_listed", F.lit(True)), "email")
    return set_email(marked, F.col("_listed"), F.lit(None).cast("string")).select(*people.columns)
