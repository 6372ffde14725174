"""People kept between jobs, laid out for the lookups that are made on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Values that tell people apart and are looked up one by one.
KEYED = ("member_number", "email")
# Row groups small enough that a lookup by key reads little beside its row.
ROW_GROUP_BYTES = 32 << 20


def store_people(
    people: DataFrame,
    path: str,
    by: str = "date_added",
    keyed: Sequence[str] = KEYED,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> DataFrame:
    """Write people to ``path`` in ranges of ``by``, and read them back.

    Every file and row group covers a short span of that date, so the bounds that
    Parquet keeps of it skip all others for a range of dates. The columns in ``keyed``
    are in no order there; each row group has a Bloom filter of them, which skips those
    that do not have the value looked for. Ranges are of the date and a hash of the
    person, so a date, or none, that many share is split like any other.
    """
    spread = F.xxhash64("person_id")
    rows = people.repartitionByRange(F.col(by), spread).sortWithinPartitions(by)
    writer = rows.write.option("parquet.block.size", row_group_bytes)
    for column in keyed:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    # Filters grow with the values of a row group, up to Parquet's own bound of 1 MB.
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    writer.parquet(path)
    return people.sparkSession.read.schema(people.schema).parquet(path)
