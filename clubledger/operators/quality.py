"""Data quality checks: each yields the offending rows; raising is optional."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clubledger.session import remove_written, write_through


class DataQualityError(ValueError):
    """A check that must hold does not."""


def require_none(offending: DataFrame, message: str, strict: bool = True) -> DataFrame:
    """Return the offending rows, or raise if there are any and ``strict`` is set."""
    if strict and not offending.isEmpty():
        raise DataQualityError(message)
    return offending


def require_some(rows: DataFrame, message: str, strict: bool = True) -> DataFrame:
    if strict and rows.isEmpty():
        raise DataQualityError(message)
    return rows


def audited_write(
    rows: DataFrame, label: str, checks: Mapping[str, Column], strict: bool = False
) -> tuple[DataFrame, dict[str, int]]:
    """Write a table, count on the way the rows that fail each check, and only then let
    it be read: ``(table, counts)``.

    The write itself counts, so nothing is computed for the checks alone. With
    ``strict``, a table that fails any is removed again and an error says how often."""
    seen = Observation()
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]
    written = write_through(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), label)
    found = {name: seen.get[name] for name in checks}
    if strict and any(found.values()):
        remove_written(written)
        failing = ", ".join(f"{n}: {k}" for n, k in found.items() if k)
        raise DataQualityError(f"{label} is not published ({failing})")
    return written, found


def failed_results(results: DataFrame, expected: str) -> DataFrame:
    """Per-row results of a push or delete that are not the success value."""
    return results.where(~F.col("status").eqNullSafe(F.lit(expected)))
