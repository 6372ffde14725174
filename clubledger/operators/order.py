"""Positions in a sorted list, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.session import write_through

# The lower bits of Spark's increasing ids count the rows of a partition.
ROW_BITS = 33


def with_position(rows: DataFrame, *keys: Column, name: str = "position") -> DataFrame:
    """``rows`` with their place, from 1, in the order of ``keys``.

    Spark deals the rows out in ranges and sorts each; a row's place is its place in its
    range and the number of rows in the ranges before. The ranges are written first,
    with the places in them, so that they cannot differ between counting and reading.
    Counts are one row per partition, and only they are added up in one place. Rows with
    equal keys are placed in any order, next to each other; rows that are equal in all
    keys share a range, so the keys should tell a list's rows apart.
    """
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    row_id = F.monotonically_increasing_id()
    placed = write_through(
        ordered.withColumns(
            {
                "_range": F.shiftright(row_id, ROW_BITS),
                "_row": row_id.bitwiseAND(F.lit((1 << ROW_BITS) - 1)),
            }
        ),
        "positions",
    )
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    # One entry per partition, so the running sums fit one row whatever the rows.
    listed = F.array_sort(F.collect_list(F.struct("_range", "n")))
    start = F.struct(
        F.lit(0).cast("bigint").alias("before"),
        F.array().cast("array<struct<_range:bigint,before:bigint>>").alias("sums"),
    )
    sums = F.aggregate(
        "listed",
        start,
        lambda acc, x: F.struct(
            (acc["before"] + x["n"]).alias("before"),
            F.concat(
                acc["sums"],
                F.array(F.struct(x["_range"].alias("_range"), acc["before"].alias("before"))),
            ).alias("sums"),
        ),
    )
    offsets = counts.agg(listed.alias("listed")).select(F.inline(sums["sums"]))
    position = (F.col("before") + F.col("_row") + 1).alias(name)
    return placed.join(F.broadcast(offsets), "_range").select(position, *rows.columns)
