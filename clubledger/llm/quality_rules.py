"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document and leaves one bit; the measurements it
used stay beside the bits. A policy is a versioned set of rules, so applying one,
or asking what a rule alone is responsible for, is bit arithmetic on the ledger.
Only DataFrame functions are used: no Python runs per row and nothing is shuffled
until an ablation adds up a histogram of at most 2^rules rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.llm.common import WORD, word_list

WINDOW = 8

# Rule name -> failing condition over the measurements, in whole numbers. The
# place in this table is the rule's bit; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
}

# Policy version -> the rules it enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "prose-1": tuple(RULES),
}


def mask(rules: tuple[str, ...] | list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _covered(starts: Column) -> Column:
    """Words inside windows that begin at these ascending positions."""
    zero = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(-WINDOW).alias("last"))
    total = F.aggregate(
        starts,
        zero,
        lambda acc, at: F.struct(
            (acc["words"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("words"),
            at.alias("last"),
        ),
    )
    return F.when(F.size(starts) > 0, total["words"]).otherwise(F.lit(0)).cast("bigint")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements as further columns (existing columns of those
    names are replaced); a null or empty text measures zero everywhere.

    Windows are compared by a 64-bit hash, within one document only.
    """
    # The columns go along in one, or theirs might have the name of a step's.
    own = F.struct(*[c for c in docs.columns if c not in MEASURES])
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(WORD))
    rows = docs.select(
        own.alias("own"), word_list(F.col(text)).alias("_words"), lines.alias("_lines")
    ).withColumn("_glued", F.array_join("_words", ""))
    last = F.size("_words") - F.lit(WINDOW - 1)
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_at", places).withColumn(
        "_hashes", F.transform("_at", lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    )
    # Most documents repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    ordered = F.sort_array(F.arrays_zip(F.col("_hashes").alias("h"), F.col("_at").alias("i")))
    rows = rows.withColumn("_sorted", F.when(repeats, ordered))
    at = lambda k: F.get("_sorted", k)
    twice = F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1),
        lambda k: at(k)["h"].eqNullSafe(at(k - 1)["h"]) | at(k)["h"].eqNullSafe(at(k + 1)["h"]),
    )
    starts = F.sort_array(F.transform(twice, lambda k: at(k)["i"]))
    rows = rows.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), starts))
    measures = F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        F.length("_glued").cast("bigint").alias("word_chars"),
        (F.length("_glued") - F.length(F.regexp_replace("_glued", r"[#*$%&|<>]+", "")))
        .cast("bigint")
        .alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_starts").isNull(), F.lit(0).cast("bigint"))
        .otherwise(_covered(F.col("_starts")))
        .alias("n_repeat_words"),
    )
    # As a generated row, for a filter on a measurement would otherwise be moved below
    # the steps above, with all of them repeated inside it.
    return rows.select("own.*", F.inline(F.array(measures)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with measurements and ``failures``, one bit per rule.

    An empty or null text fails ``few_words`` and no other rule. Repeated rows are
    measured each on its own. Columns of ``docs`` named like a measurement or
    ``failures`` are replaced.
    """
    measured = measure(docs, text).drop("failures")
    bits = [
        F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
        for bit, condition in enumerate(RULES.values())
    ]
    return measured.withColumn("failures", reduce(Column.bitwiseOR, bits))


def fails(policy: str, failures: str = "failures") -> Column:
    """Whether a document fails any rule that the policy enforces."""
    return F.col(failures).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint")) != 0


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept`` and the ``policy`` that decided it."""
    return ledger.withColumns({"kept": ~fails(policy), "policy": F.lit(policy)})


def ablations(
    ledger: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES
) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that fail it alone, and
    that would be kept without it.

    The ledger is counted once by its bits; everything else is bit arithmetic on
    that histogram, which has at most 2^rules rows however many documents there are.
    """
    histogram = ledger.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    cases = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(policy).alias("policy"),
                    F.lit(rule).alias("rule"),
                    F.lit(mask(rules)).cast("bigint").alias("mask"),
                    F.lit(mask([rule])).cast("bigint").alias("bit"),
                )
                for policy, rules in policies.items()
                for rule in rules
            ]
        )
    )
    rows = histogram.select("failures", "n", cases.alias("c")).select("failures", "n", "c.*")
    failed = F.col("failures").bitwiseAND(F.col("mask"))
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return rows.groupBy("policy", "rule").agg(
        count(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(failed == F.col("bit")).alias("n_failed_alone"),
        count(failed.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        F.bit_or(failed).alias("bits_seen"),
    )
