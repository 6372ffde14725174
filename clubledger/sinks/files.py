"""Writing results as folders of files, many tasks at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubledger.functions.people import display_date
from clubledger.operators.memberships import overlap_lines
from clubledger.operators.newsletter import newsletter_text, receiver_json


# Text as it is: quotes are doubled, blanks are kept, missing values are empty.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _printable(rows: DataFrame, fmt: str) -> DataFrame:
    """Dates as printed, for text formats."""
    if fmt != "csv":
        return rows
    dates = [f.name for f in rows.schema if f.dataType.typeName() == "date"]
    return rows.withColumns({d: display_date(F.col(d)) for d in dates}) if dates else rows


def write_list(rows: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Any list with a header row (CSV) or as Parquet, in the order it has."""
    writer = _printable(rows, fmt).write.mode(mode)
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown file type: {fmt}")


def write_matrix(wide: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """The wide overlap matrix: lines of text with a header, or Parquet with lists of
    cells. The groups are data here, not columns, so there may be any number of them."""
    if fmt == "csv":
        overlap_lines(wide, ",").write.mode(mode).text(path)
    else:
        write_list(wide.orderBy("riege"), path, fmt, mode)


def write_partitioned(
    rows: DataFrame, by: str, path: str, fmt: str = "csv", mode: str = "errorifexists"
) -> None:
    """One sub-folder per value of ``by``.

    Rows are rebalanced by that column first: small values share a task, a very
    large one is split over several, and no folder gets needlessly many files.
    """
    balanced = _printable(rows, fmt).hint("rebalance", F.col(by))
    writer = balanced.write.mode(mode).partitionBy(by)
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown file type: {fmt}")


def write_rosters(
    rosters: DataFrame, folder: str, as_of: dt.date, fmt: str = "csv", mode: str = "errorifexists"
) -> str:
    """The address lists of all groups under a dated folder, one folder per group."""
    path = f"{folder.rstrip('/')}/export_{as_of:%d.%m.%Y}"
    write_partitioned(rosters, "riege", path, fmt, mode)
    return path


def write_newsletter(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    newsletter_text(rows).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_payload(payload: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Receiver records as JSON lines."""
    receiver_json(payload).write.mode(mode).text(path)
