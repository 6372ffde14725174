"""Write one of a club's lists from its files.

    spark-submit --py-files clubledger.zip clubledger/__main__.py newsletter \\
        --members members.csv --groups groups.csv --out lists
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from clubledger.plans.ledger import load_ledger
from clubledger.sinks.files import write_list

LISTS = [
    "newsletter",
    "receivers",
    "rosters",
    "overlap",
    "magazine_list",
    "no_mail",
    "honorary_no_mail",
    "lost_emails",
    "joined_between",
    "youth_born_in",
    "assembly_lists",
    "statistics",
    "sync",
]
YEARLY = ["youth_born_in", "assembly_lists"]


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="clubledger", description=__doc__.splitlines()[0])
    parser.add_argument("list", choices=LISTS)
    parser.add_argument("--members", required=True, help="member export")
    parser.add_argument("--groups", required=True, help="group file")
    parser.add_argument("--out", required=True, help="output folder")
    parser.add_argument("--extra", help="recipients who are not members")
    parser.add_argument("--removed", help="unsubscribed addresses")
    parser.add_argument("--backup", help="older member export")
    parser.add_argument("--housemates", help="member numbers that share a household")
    parser.add_argument("--snapshot", help="Parquet snapshot of the mailing service, for sync")
    parser.add_argument("--as-of", type=dt.date.fromisoformat, default=dt.date.today())
    parser.add_argument("--begin", type=dt.date.fromisoformat, help="for joined_between")
    parser.add_argument("--end", type=dt.date.fromisoformat, help="for joined_between")
    parser.add_argument("--year", type=int, help="for assembly_lists and youth_born_in")
    parser.add_argument("--format", choices=["csv", "parquet"], default="csv")
    parser.add_argument(
        "--single-line",
        action="store_true",
        help="CSV without line breaks inside quotes: many tasks read one file",
    )
    parser.add_argument("--strict", action="store_true", help="fail on data quality problems")
    options = parser.parse_args(arguments)
    if options.list in YEARLY and options.year is None:
        parser.error(f"{options.list} needs --year")
    if options.list == "sync" and options.snapshot is None:
        parser.error("sync needs --snapshot")
    return options


def run(spark: SparkSession, options: argparse.Namespace) -> None:
    ledger = load_ledger(
        spark,
        members=options.members,
        groups=options.groups,
        as_of=options.as_of,
        extra=options.extra,
        removed=options.removed,
        backup=options.backup,
        housemates=options.housemates,
        strict=options.strict,
        multi_line=not options.single_line,
    )
    if options.list == "sync":
        log, snapshot = ledger.sync(spark.read.parquet(options.snapshot))
        write_list(log, f"{options.out}/change_log", options.format)
        write_list(snapshot, f"{options.out}/snapshot", "parquet")
        return
    arguments = {}
    if options.list == "joined_between":
        arguments = {"begin": options.begin, "end": options.end}
    elif options.list in YEARLY:
        arguments = {"year": options.year}
    ledger.export(options.list, options.out, options.format, **arguments)


def main() -> None:
    options = parse()
    spark = SparkSession.builder.appName(f"clubledger-{options.list}").getOrCreate()
    run(spark, options)
    spark.stop()


if __name__ == "__main__":
    main()
