"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to give more or less words than it has takes every document some
fractional number of times. The whole part is certain; the fractions are rounded in
pairs: words move at random from one document of a pair to the other, in the
direction that keeps both expectations, until one of the two is taken or left. The
open one of each pair goes on, so the words of a source are kept to the end, where
at most one document per source is left and goes to the nearer side.

The pairs form a reduction tree: blocks of documents of one source, spread by a hash,
leave one open document each, these form the next blocks, and so on. Every block is
bounded, and blocks, not sources, are dealt out to the tasks, so a source with a third
of all documents is simply more blocks. Only DataFrame functions are used. The randomness is a hash of seed and document, so a
rerun takes the same documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clubledger.llm.common import free_names, word_list
from clubledger.operators.skew import skew_join
from clubledger.session import write_through

#: Documents of a block, on average.
BLOCK = 96
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
UNIT = ("doc_id", "size", "rows", "share")


def _source_key(source: Column) -> Column:
    """A text that tells sources, and the missing one, apart; the missing one is last."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """``(source_key, source_size, target)`` from ``(source_key, source_size)``.

    Sources in code point order weigh ``weights``, repeating, and share all words by
    weight. No target is above ``most`` times its source; what is left over is
    shared by the others, again by weight. The table has one row per source, so the
    running sums over it are one small task.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy("source_key"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.withColumn("weight", F.get(cycle, (place - 1) % len(weights)))
        .withColumn("most", most * F.col("source_size").cast("double"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weights", F.sum("weight").over(everything))
    )
    # Sources by how soon they are full; the share of those not full yet, from here on.
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_key")
    fuller = order.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(fuller), F.lit(0.0))
    rows = rows.withColumn(
        "share", (F.col("total") - before("most")) / (F.col("all_weights") - before("weight"))
    )
    fits = F.col("share") * F.col("weight") <= F.col("most")
    open_share = F.first(F.when(fits, F.col("share")), ignorenulls=True)
    reached = F.max(fits.cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    share = open_share.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(reached == 1, share * F.col("weight")).otherwise(F.col("most"))
    return rows.select("source_key", "source_size", target.alias("target"))


def _chance(seed: int, level: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on these values alone."""
    whole = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), *columns), F.lit(1 << 53))
    return whole / F.lit(float(1 << 53))


def _fold(items: Column, seed: int, level: int) -> Column:
    """One block, from the largest document down: ``decided`` and the ``open`` one."""
    first = F.get(items, 0)

    def decide(item: Column, share: Column) -> Column:
        return F.struct(
            item["doc_id"].alias("doc_id"),
            item["size"].alias("size"),
            item["rows"].alias("rows"),
            share.alias("share"),
        )

    def step(acc: Column, item: Column) -> Column:
        now = acc["open"]
        p, q = now["share"], item["share"]
        v, w = now["size"].cast("double"), item["size"].cast("double")
        up, down = F.least((1 - p) * v, q * w), F.least(p * v, (1 - q) * w)
        chance = _chance(seed, level, now["doc_id"], now["size"], item["doc_id"], item["size"])
        raised = chance * (up + down) < down
        one, none = F.lit(1.0), F.lit(0.0)
        # Raised: words move from the item to the open document, else the other way.
        open_ends = F.when(raised, (1 - p) * v <= q * w).otherwise(p * v <= (1 - q) * w)
        ended = F.when(
            open_ends, decide(now, F.when(raised, one).otherwise(none))
        ).otherwise(decide(item, F.when(raised, none).otherwise(one)))
        item_share = F.when(raised, q - up / w).otherwise(q + down / w)
        open_share = F.when(raised, p + up / v).otherwise(p - down / v)
        bounded = lambda x: F.greatest(none, F.least(one, x))
        left = F.when(open_ends, decide(item, bounded(item_share))).otherwise(
            decide(now, bounded(open_share))
        )
        return F.struct(
            F.concat(acc["decided"], F.array(ended)).alias("decided"), left.alias("open")
        )

    start = F.struct(F.slice(items, 1, 0).alias("decided"), first.alias("open"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, step)


def _counted(units: DataFrame) -> DataFrame:
    return units.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))


def _round_fractions(units: DataFrame, seed: int, block: int) -> DataFrame:
    """``(source_key, doc_id, size, rows, share)`` with every share rounded to 0 or 1."""
    decided, level = [], 0
    item = F.struct("size", "doc_id", "rows", "share")  # larger documents first
    current = units
    counts = write_through(_counted(units), "counts")
    while True:
        blocks = F.ceil(F.col("n") / block)
        # Joined without dealing by source, or the blocks of a large one would follow
        # it into one task.
        counted = counts.select("source_key", blocks.alias("blocks"))
        placed = skew_join(current, counted, "source_key", "inner")
        place = F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size", "rows"), F.col("blocks"))
        gathered = (
            placed.groupBy("source_key", "blocks", place.alias("block"))
            .agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
            .withColumn(
                "items",
                F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in UNIT])),
            )
        )
        folded = write_through(
            gathered.select(
                "source_key",
                (F.col("blocks") == 1).alias("last"),
                _fold(F.col("items"), seed, level).alias("f"),
            ),
            "pivotal",
        )
        settled = F.when(
            F.col("last"),
            F.concat(
                "f.decided",
                F.array(
                    F.struct(
                        *[F.col(f"f.open.{c}").alias(c) for c in UNIT[:-1]],
                        F.when(F.col("f.open.share") >= 0.5, F.lit(1.0))
                        .otherwise(F.lit(0.0))
                        .alias("share"),
                    )
                ),
            ),
        ).otherwise(F.col("f.decided"))
        decided.append(folded.select("source_key", F.inline(settled)))
        current = folded.where(~F.col("last")).select("source_key", "f.open.*")
        counts = write_through(_counted(current), "counts")
        level += 1
        if current.isEmpty():
            return reduce(DataFrame.unionByName, decided)


def mixing_decisions(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 42,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, source, size, row, source_size, target, copies, taken)``, one row
    per row of ``docs``; ``copies`` is how often the mix takes it.

    Size counts words; a null text has none and takes no part in the rounding. The
    missing source is a source like others, and last. Rows with equal id, source and
    size are numbered by ``row`` and share their copies as evenly as whole numbers
    allow. An empty table gives an empty one. No other column is looked at.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(word_list(F.col(text))).cast("bigint").alias("size"),
    )
    units = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = write_through(units.withColumn("source_key", _source_key(F.col("source"))), "units")
    sizes = units.groupBy("source_key").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = write_through(source_targets(sizes, weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    wanted = (
        skew_join(units, targets, "source_key", "inner")
        .withColumn("rate", F.least(F.coalesce(rate, F.lit(0.0)), F.lit(float(most))))
        .withColumn("whole", F.floor("rate"))
        .withColumn("extra", (F.col("rate") - F.col("whole")) * F.col("rows"))
        .withColumn("sure", F.floor("extra"))
        .withColumn("share", F.col("extra") - F.col("sure"))
    )
    open_units = wanted.where("size > 0 AND share > 0").select("source_key", *UNIT)
    rounded = _round_fractions(open_units, seed, block)
    rounded = rounded.select("source_key", "doc_id", "size", F.col("share").alias("taken_once"))
    same = [wanted[c].eqNullSafe(rounded[c]) for c in ("source_key", "doc_id", "size")]
    up = F.coalesce(rounded["taken_once"], F.lit(0.0)).cast("bigint")
    rows = wanted.join(rounded, same, "left").select(
        *[wanted[c] for c in ("doc_id", "source", "size", "source_size", "target", "whole")],
        (wanted["sure"] + up).alias("extra"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), wanted["rows"])).alias("row"),
    )
    copies = F.col("whole") + (F.col("row") <= F.col("extra")).cast("bigint")
    return rows.withColumn("copies", copies).select(
        F.col("doc_id").alias(doc_id),
        F.col("source").alias(source),
        "size",
        "row",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    **options,
) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each one as often as decided."""
    decided = mixing_decisions(docs, doc_id, text, source, **options)
    # Names that the documents do not have; their columns stay as they are. One column
    # as the key, so that the rows with their texts are dealt out once for the join and
    # the numbering; a struct, because structs of nulls are equal.
    key, copies, rows, row, place = free_names(docs, "unit", "copies", "rows", "row", "place")

    def unit(size: Column) -> Column:
        return F.struct(F.col(doc_id).alias("i"), F.col(source).alias("s"), size.alias("n"))

    taken = decided.groupBy(unit(F.col("size")).alias(key)).agg(
        F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)
    )
    size = F.size(word_list(F.col(text))).cast("bigint")
    # Of exactly the other side's type, or the join would cast it and deal out a cast.
    own = docs.withColumn(key, unit(size).cast(taken.schema[key].dataType))
    alike = Window.partitionBy(key).orderBy(F.xxhash64(text))
    numbered = own.join(taken, key).withColumn(row, F.row_number().over(alike))
    # As ``mixing_decisions`` deals them out: evenly, the first rows one more.
    even = F.floor(F.col(copies) / F.col(rows))
    times = even + (F.col(row) <= F.col(copies) - even * F.col(rows)).cast("bigint")
    repeated = numbered.where(times > 0).withColumn(
        place, F.explode(F.sequence(F.lit(1).cast("bigint"), times))
    )
    return repeated.select(*[F.col(c) for c in docs.columns])
