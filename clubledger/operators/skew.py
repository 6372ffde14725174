"""Joins that stay balanced when one key holds a large share of the rows.

Nothing is counted in advance: Spark knows after its shuffle which partition is too
large, splits it by the tasks that wrote it and repeats the other side for every part
(adaptive execution, on by default). It can do so only where both sides of the join
come straight from a shuffle made for it. A lookup that was grouped by the key just
before is dealt out already, and would be joined in the stage of the grouping, whose
partitions have to stay whole. ``skew_join`` therefore joins by the key and its hash:
that is a way of dealing out of its own, so both sides are shuffled for the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy if it has more rows than one task should read ...
ROWS_PER_TASK = 1_000_000
# ... and holds at least one part in this many of all rows, so that no more than
# a million keys can ever be listed, whatever the size of the data.
MAX_HEAVY_KEYS = 1_000_000


def heavy_rows(counts: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """The rows of a table with counts ``n`` that stand for more than ``limit``
    rows each and for at least 1/``MAX_HEAVY_KEYS`` of the total.

    There can be no more than ``MAX_HEAVY_KEYS`` of them, so they may be broadcast.
    """
    total = counts.agg(F.sum("n")).scalar()
    return counts.where((F.col("n") > limit) & (F.col("n") * MAX_HEAVY_KEYS >= total))


def skew_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join ``rows`` (any number per key) with ``lookup`` (one row per key).

    Builds a plan and runs nothing. Rows without a key count as one more key where
    they are kept. A small lookup is broadcast by Spark, which knows its size.
    """
    # Equal keys must have equal hashes, so the two sides need one type.
    lookup = lookup.withColumn(key, F.col(key).cast(rows.schema[key].dataType))
    hashed = "_key_hash"
    left = rows.withColumn(hashed, F.xxhash64(key))
    right = lookup.withColumn(hashed, F.xxhash64(key))
    return left.join(right, [key, hashed], how).drop(hashed)
