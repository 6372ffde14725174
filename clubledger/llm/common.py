"""What the operators share: words, clean ids, samples of a bounded size."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    """All words of a text, in order; an empty list for a missing text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def free_names(rows: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that ``rows`` does not have yet."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


Batches = Iterable[pa.RecordBatch]


def _give_back() -> None:
    """Return what the allocators keep for later to the machine, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(
    function: Callable[[Batches], Iterator[pa.RecordBatch]],
) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives free memory back after a partition.

    Python workers live on, also through stages that need none of it."""

    @functools.wraps(function)
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            _give_back()

    return run


def rows_in_pieces(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in slices of about ``most_bytes``, one row at the least.

    Spark sizes batches by rows; very long texts would fill a worker otherwise.
    """
    step = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def hashed_share(rows: DataFrame, key: str, n_rows: int, wanted: int, seed: str) -> DataFrame:
    """About ``wanted`` of ``n_rows`` rows, chosen by a hash of ``key``; never more
    than twice as many. Meant for fitting a model, not for results."""
    if n_rows <= wanted:
        return rows
    million = 1_000_000
    share = max(1, -(-wanted * million // n_rows))
    picked = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(million)) < share
    return rows.where(picked).limit(2 * wanted)


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[tuple, pa.Table]]:
    """Key and rows of each group of a partition that is sorted by ``keys``.

    Only the group being gathered is in memory beside the current batch.
    """
    held: list[pa.Table] = []
    current = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        values = list(zip(*(rows[k].to_pylist() for k in keys), strict=True))
        start = 0
        for end in range(1, len(values) + 1):
            if end < len(values) and values[end] == values[start]:
                continue
            if held and values[start] != current:
                yield current, pa.concat_tables(held)
                held = []
            current = values[start]
            held.append(rows.slice(start, end - start))
            start = end
    if held:
        yield current, pa.concat_tables(held)


def importable_by_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library from where it lies.

    On a cluster it is installed on the executors (or passed as ``--py-files``);
    there this path does not exist and does no harm.
    """
    here = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in paths.split(os.pathsep):
        joined = os.pathsep.join(p for p in (here, paths) if p)
        spark.sparkContext.environment["PYTHONPATH"] = joined
