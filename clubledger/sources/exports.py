"""Reading exports and turning them into typed records.

Every reader adds ``pos``, the place of the row in its file: a struct
``(source, file, block, row)`` that sorts in file order even when Spark reads the
blocks of a file in many tasks. ``source`` puts one input after another.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clubledger.constants import (
    EXPORT_COLUMNS,
    EXPORT_EMAIL_COLUMNS,
    GROUP_FILE_COLUMNS,
    HOUSEMATES_COLUMN,
)
from clubledger.functions import normalise as N
from clubledger.session import write_through

GROUP_FILE_ENCODING = "ISO-8859-1"
SURPLUS = "_surplus"  # where the reader puts a value beyond the last column


def format_of(path: str) -> str:
    """File format by the name of the file or folder."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if "csv" in name:
        return "csv"
    if "parquet" in name:
        return "parquet"
    if "xls" in name:
        raise ValueError("spreadsheets are not read here; export them as CSV or Parquet")
    raise ValueError(f"unknown file type: {path}")


def _position(source: int = 0) -> Column:
    return F.struct(
        F.lit(source).alias("source"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _read_csv(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    """Semicolon-separated text with a header; a file that yields fewer than three
    columns that way is comma-separated with ``+`` as the quote character."""
    # A doubled quote character inside quotes stands for itself.
    ways = [{"sep": ";", "quote": '"', "escape": '"'}, {"sep": ",", "quote": "+", "escape": "+"}]
    options = {"header": True, "encoding": encoding, "multiLine": multi_line}
    for way in ways:
        columns = spark.read.options(**options, **way).csv(path).columns
        if len(columns) >= 3:
            break
    return _checked_csv(spark, path, columns, {**options, **way})


def _checked_csv(spark: SparkSession, path: str, columns: list[str], options: dict) -> DataFrame:
    """A CSV file with these columns. Cells that a row lacks are missing; a row with
    a value beyond the last column is an error, for its cells may have slipped."""
    schema = StructType([StructField(c, StringType()) for c in [*columns, SURPLUS]])
    table = spark.read.options(**options).schema(schema).csv(path)
    message = F.concat(F.lit(f"more cells than columns in {path}: "), F.col(SURPLUS))
    slipped = F.when(F.col(SURPLUS).isNotNull(), F.raise_error(message).cast("boolean"))
    return table.where(F.coalesce(slipped, F.lit(True)))


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    encoding: str = "UTF-8",
    source: int = 0,
    multi_line: bool = True,
) -> DataFrame:
    """All columns of a file plus ``pos``; rows without any value are left out.

    CSV may have line breaks inside quotes, so one task reads a whole file; a large
    export should be Parquet, or many files, or, if it has no such line breaks, be
    read without ``multi_line``, which many tasks do together.
    """
    fmt = fmt or format_of(path)
    if fmt == "csv":
        table = _read_csv(spark, path, encoding, multi_line)
    elif fmt == "parquet":
        table = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown file type: {fmt}")
    columns = [c for c in table.columns if c != SURPLUS]
    rows = table.select("*", _position(source).alias("pos")).drop(SURPLUS)
    return rows.na.drop("all", subset=columns)


def _column(table: DataFrame, name: str) -> Column | None:
    return F.col(f"`{name}`") if name in table.columns else None


def _or_missing(c: Column | None) -> Column:
    return F.lit(None).cast("string") if c is None else c


def people_from_export(table: DataFrame, as_of: dt.date) -> DataFrame:
    """Typed people records from an export table that has ``pos``.

    Columns the export lacks are missing in every record. ``as_of`` decides the
    century of two-digit years.
    """
    raw = {field: _column(table, name) for field, name in EXPORT_COLUMNS.items()}
    text = {
        f: N.blank_to_null(_or_missing(raw[f]).cast("string"))
        for f in ("gender", "first_name", "last_name", "street", "city", "category")
    }
    addresses = [_column(table, name) for name in EXPORT_EMAIL_COLUMNS]
    emails = N.email_array([_or_missing(c) for c in addresses])
    return table.select(
        "pos",
        N.member_number(_or_missing(raw["member_number"])).alias("member_number"),
        text["gender"].alias("gender"),
        text["first_name"].alias("first_name"),
        text["last_name"].alias("last_name"),
        text["street"].alias("street"),
        N.plz(_or_missing(raw["plz"])).alias("plz"),
        text["city"].alias("city"),
        N.parse_date(_or_missing(raw["birthday"]), as_of).alias("birthday"),
        emails.alias("emails"),
        N.primary_email(emails).alias("email"),
        *[N.phone(_or_missing(raw[p])).alias(p) for p in ("phone_p", "phone_m", "phone_g")],
        text["category"].alias("category"),
        N.parse_date(_or_missing(raw["date_added"]), as_of).alias("date_added"),
        N.printed_magazine(raw["printed_magazine"]).alias("printed_magazine"),
        F.array().cast("array<string>").alias("tags"),
    )


def number_people(people: DataFrame, label: str = "people") -> DataFrame:
    """Give every record a unique ``person_id``.

    The ids are written once, because a recomputed scan could number its rows
    differently; all later joins read them back.
    """
    return write_through(people.withColumn("person_id", F.monotonically_increasing_id()), label)


def read_people(
    spark: SparkSession,
    path: str,
    as_of: dt.date,
    fmt: str | None = None,
    source: int = 0,
    multi_line: bool = True,
) -> DataFrame:
    """A people file (member export, extra recipients, unsubscribe list, backup)."""
    table = read_table(spark, path, fmt, source=source, multi_line=multi_line)
    return people_from_export(table, as_of)


def group_rows(table: DataFrame) -> DataFrame:
    """Rows of the group file: member number, function and organ."""
    raw = {f: _or_missing(_column(table, name)) for f, name in GROUP_FILE_COLUMNS.items()}
    return table.select(
        F.col("pos").alias("row_id"),
        N.member_number(raw["member_number"]).alias("member_number"),
        N.blank_to_null(raw["function_name"].cast("string")).alias("function_name"),
        N.blank_to_null(raw["organ"].cast("string")).alias("organ"),
    )


def read_group_rows(
    spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = True
) -> DataFrame:
    return group_rows(read_table(spark, path, fmt, GROUP_FILE_ENCODING, multi_line=multi_line))


def housemate_links(table: DataFrame) -> DataFrame:
    """One row per listed number of a table ``(group_pos, Mitgliedernummern)``."""
    return table.select(
        "group_pos", F.posexplode(F.split(HOUSEMATES_COLUMN, ", ")).alias("member_pos", "text")
    ).select("group_pos", "member_pos", N.member_number(F.col("text")).alias("member_number"))


def read_housemates(
    spark: SparkSession, path: str | None, fmt: str | None = None
) -> DataFrame:
    """The housemate list; no file means no groups.

    A one-column CSV is read with a separator that cannot occur in it, since the
    numbers of a group are themselves separated by commas.
    """
    if path is None:
        empty = spark.range(0).select(
            F.col("id").alias("group_pos"), F.lit("").alias(HOUSEMATES_COLUMN)
        )
        return housemate_links(empty)
    if (fmt or format_of(path)) == "csv":
        options = {"header": True, "sep": ";", "escape": '"', "multiLine": True}
        columns = spark.read.options(**options).csv(path).columns
        table = _checked_csv(spark, path, columns, options)
    else:
        table = spark.read.parquet(path)
    return housemate_links(
        table.select(_position().alias("group_pos"), HOUSEMATES_COLUMN).where(
            F.col(HOUSEMATES_COLUMN).isNotNull()
        )
    )
