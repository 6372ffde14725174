"""Synchronising newsletter rows with a snapshot of the mailing service.

``receivers(receiver_id, email, updated, status, ...)`` is the snapshot, if it has
them with ``global_attributes``, a map of texts. Its addresses are there and unique,
which ``address_problems`` checks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.constants import DELETE_OK, RECEIVER_TYPES, UPSERT_OK
from clubledger.operators.quality import failed_results, require_none
from clubledger.session import new_table_path, write_through


def is_stale(as_of: dt.date) -> Column:
    """Not touched by the push of ``as_of``: another date, or none."""
    return ~F.col("updated").eqNullSafe(F.lit(as_of))


Predicate = Callable[[dt.date], Column]

# Saved filters by name, each a predicate that depends on the day of the sync.
SAVED_FILTERS: dict[str, Predicate] = {"stale": is_stale}


def with_filter(
    name: str, predicate: Predicate, filters: Mapping[str, Predicate] = SAVED_FILTERS
) -> dict[str, Predicate]:
    """The saved filters with one added or replaced."""
    return {**filters, name: predicate}


def receivers_by_type(receivers: DataFrame, kind: str | None = None) -> DataFrame:
    if kind is not None and kind not in RECEIVER_TYPES:
        raise ValueError(f"the receiver type must be one of {', '.join(RECEIVER_TYPES)}")
    if kind in (None, "all"):
        return receivers
    return receivers.where(F.col("status") == kind)


def receivers_filtered(
    receivers: DataFrame,
    name: str,
    as_of: dt.date,
    filters: Mapping[str, Predicate] = SAVED_FILTERS,
) -> DataFrame:
    return receivers.where(filters[name](as_of))


def receiver_stats(receivers: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("active", "inactive", "bounce")]
    return receivers.agg(F.count(F.lit(1)).alias("total_count"), *counts)


ATTRIBUTES = "global_attributes"


def address_problems(rows: DataFrame, strict: bool = False) -> DataFrame:
    """``(email, n)`` of addresses that are missing or occur more than once, in a
    snapshot or a push; ``strict`` raises if there are any."""
    counts = rows.groupBy("email").agg(F.count(F.lit(1)).alias("n"))
    return require_none(
        counts.where("n > 1 OR email IS NULL"), "missing or repeated addresses", strict
    )


def _sides(receivers: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """What a merge needs of the snapshot and of the push, and whether either has
    attributes."""
    with_attributes = ATTRIBUTES in [*receivers.columns, *incoming.columns]

    def attributes(rows: DataFrame, name: str) -> list[Column]:
        none = F.lit(None).cast("map<string,string>")
        own = F.col(ATTRIBUTES) if ATTRIBUTES in rows.columns else none
        return [own.alias(name)] if with_attributes else []

    push = incoming.select("email", F.lit(True).alias("_pushed"), *attributes(incoming, "_new"))
    known = receivers.select(
        "email", "receiver_id", "updated", "status", F.lit(True).alias("_known"),
        *attributes(receivers, "_old"),
    )
    return known, push, with_attributes


def _decided(both: DataFrame, as_of: dt.date, with_attributes: bool) -> DataFrame:
    """Joined rows with what happens to each."""
    pushed, is_known = F.col("_pushed").isNotNull(), F.col("_known").isNotNull()
    deleted = ~pushed & is_stale(as_of)
    empty = F.create_map().cast("map<string,string>")
    together = F.map_zip_with(
        F.coalesce("_old", empty) if with_attributes else empty,
        F.coalesce("_new", empty) if with_attributes else empty,
        lambda _, old, new: F.coalesce(new, old),
    )
    return both.select(
        "email",
        "receiver_id",
        F.when(pushed, F.lit(as_of)).otherwise(F.col("updated")).alias("updated"),
        F.when(is_known, F.col("status")).otherwise("active").alias("status"),
        (pushed & ~is_known).alias("inserted"),
        (pushed & is_known).alias("refreshed"),
        deleted.alias("deleted"),
        (is_known & ~deleted & (F.col("status") == "inactive")).alias("activated"),
        *([together.alias(ATTRIBUTES)] if with_attributes else []),
    )


def merged(receivers: DataFrame, incoming: DataFrame, as_of: dt.date) -> DataFrame:
    """Snapshot and incoming receivers side by side, with what happens to each.

    One full join on the address, unique on both sides. The flags are the steps
    of the sync in order: push, delete what the push left stale, activate. Where
    either side has attributes, a pushed receiver has those of both, the incoming
    value where they differ; a receiver that is not pushed keeps its own.
    """
    known, push, with_attributes = _sides(receivers, incoming)
    return _decided(known.join(push, "email", "full"), as_of, with_attributes)


@dataclass(frozen=True)
class StoredSnapshot:
    """A snapshot kept between syncs: a table bucketed by address, and beside it the
    receivers without one, which no push can meet."""

    addressed: DataFrame
    unaddressed: DataFrame

    def receivers(self) -> DataFrame:
        return self.addressed.unionByName(self.unaddressed)


def store_snapshot(receivers: DataFrame, name: str, buckets: int | None = None) -> StoredSnapshot:
    """Write a snapshot as table ``name`` of the catalog, its files in the shared folder.

    A join by address deals out the push alone, to the buckets; the snapshot, usually
    the far larger side, stays where it is. For that there have to be at least as many
    buckets as shuffle partitions, which is the number without one of its own."""
    spark = receivers.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out as the buckets are, so that every bucket is one file.
    rows = receivers.where(F.col("email").isNotNull()).repartition(n, "email")
    writer = rows.write.bucketBy(n, "email").sortBy("email").format("parquet")
    writer.option("path", new_table_path(spark, name)).saveAsTable(name)
    rest = write_through(receivers.where(F.col("email").isNull()), f"{name}-unaddressed")
    return StoredSnapshot(spark.table(name), rest)


def merged_stored(stored: StoredSnapshot, incoming: DataFrame, as_of: dt.date) -> DataFrame:
    """``merged`` over a stored snapshot, without a shuffle of it."""
    known, push, with_attributes = _sides(stored.addressed, incoming)
    both = known.join(push.hint("shuffle_merge"), "email", "full")
    alone, _, _ = _sides(stored.unaddressed, incoming)
    both = both.unionByName(alone, allowMissingColumns=True)
    return _decided(both, as_of, with_attributes)


def log_of(rows: DataFrame) -> DataFrame:
    """``(email, action)`` of merged rows; one address may have two actions."""
    actions = {"insert": "inserted", "update": "refreshed", "delete": "deleted", "activate": "activated"}
    taken = F.array_compact(F.array(*[F.when(F.col(c), F.lit(a)) for a, c in actions.items()]))
    return rows.select("email", F.explode(taken).alias("action"))


def problem_log(receivers: DataFrame) -> DataFrame:
    """``(email, action)`` for every address of a snapshot that is missing or repeated,
    which a sync reports beside what it does."""
    action = F.when(F.col("email").isNull(), "missing address").otherwise("repeated address")
    return address_problems(receivers).select("email", action.alias("action"))


def failed_actions(actions: DataFrame, results: DataFrame) -> DataFrame:
    """``(email, action, status)`` of the actions that the service did not confirm.

    ``results(email, step, status)`` are its answers to a push and a delete, one per
    address. An insert or update has to be answered by the success value of a push, a
    delete by that of a delete; an action without an answer has failed as well, with
    no status. Activations have no answer of their own."""
    step = F.when(F.col("action") == "delete", "delete").when(
        F.col("action").isin("insert", "update"), "push"
    )
    asked = actions.withColumn("step", step).where("step IS NOT NULL")
    answered = asked.join(results.select("email", "step", "status"), ["email", "step"], "left")
    pushed = failed_results(answered.where("step = 'push'"), UPSERT_OK)
    deleted = failed_results(answered.where("step = 'delete'"), DELETE_OK)
    return pushed.unionByName(deleted).select("email", "action", "status")


def confirmed_snapshot(receivers: DataFrame, after: DataFrame, failed: DataFrame) -> DataFrame:
    """The snapshot after a sync whose failed actions are undone: receivers that could
    not be pushed or deleted are as before, and new ones are not there."""
    addresses = failed.select("email").distinct()
    kept = after.join(addresses, "email", "left_anti")
    before = receivers.join(addresses, "email", "left_semi")
    columns = [c for c in after.columns if c in before.columns]
    return kept.unionByName(before.select(*columns), allowMissingColumns=True).select(*after.columns)


def snapshot_of(rows: DataFrame) -> DataFrame:
    """The snapshot that merged rows leave; new receivers have no id yet."""
    after = rows.where(~F.col("deleted"))
    status = F.when(F.col("activated"), "active").otherwise(F.col("status"))
    attributes = [c for c in rows.columns if c == ATTRIBUTES]
    return after.select("receiver_id", "email", "updated", status.alias("status"), *attributes)


def change_log(receivers: DataFrame, incoming: DataFrame, as_of: dt.date) -> DataFrame:
    """``(email, action)`` of a whole sync."""
    return log_of(merged(receivers, incoming, as_of))


def synced_snapshot(receivers: DataFrame, incoming: DataFrame, as_of: dt.date) -> DataFrame:
    """The snapshot after the sync."""
    return snapshot_of(merged(receivers, incoming, as_of))


def upsert_receivers(receivers: DataFrame, incoming: DataFrame, as_of: dt.date) -> DataFrame:
    """The snapshot after the push alone."""
    rows = merged(receivers, incoming, as_of)
    attributes = [c for c in rows.columns if c == ATTRIBUTES]
    return rows.select("receiver_id", "email", "updated", "status", *attributes)


def delete_receivers(receivers: DataFrame, ids: DataFrame) -> DataFrame:
    return receivers.join(ids.select("receiver_id").distinct(), "receiver_id", "left_anti")


def remove_stale(receivers: DataFrame, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """The snapshot without stale receivers, and the addresses removed."""
    stale = is_stale(as_of)
    return receivers.where(~stale), receivers.where(stale).select("email")


def activate_inactive(receivers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot with inactive receivers activated, and their addresses."""
    inactive = F.col("status") == "inactive"
    status = F.when(inactive, "active").otherwise(F.col("status"))
    return receivers.withColumn("status", status), receivers.where(inactive).select("email")
