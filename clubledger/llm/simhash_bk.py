"""Near-duplicates by SimHash fingerprints and shard trees of Hamming distances.

Fingerprints that differ in at most ``radius`` bits agree on at least
``blocks - radius`` of ``blocks`` equal stretches, so every choice of that many
stretches is one table of shards, keyed by their bits, and two fingerprints that
link meet in at least one shard. In a shard a BK-tree (children keyed by the
distance to the parent) finds the links: a search follows only edges whose
distance lies within the radius of its own distance to the parent.

A search consumes what it finds, and subtrees without an unconsumed fingerprint
are skipped, so a dense group costs one visit per member, not one per pair, and
leaves one link per member. A shard with too many members is cut into parts by a
hash, and each pair of parts becomes a shard of its own: no task ever holds more
than two parts, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clubledger.llm.common import free_names, rows_in_pieces, sorted_groups, tidy
from clubledger.operators.components import connected_components
from clubledger.session import write_through

SEED = 42
BITS = 64
#: Members of a shard, and of each part of a larger one.
SHARD_ROWS = 4096

# Which of the 8 bits of each byte value are set.
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; with fewer words,
    of all of them together; none for a text without words."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and ASCII blanks
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])]
    return np.array(found or [digest(joined, SEED)], dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The SimHash: a bit is set if it is in more than half of the hashes."""
    hashes = shingle_hashes(text, shingle)
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.intp)
    columns += np.arange(8) * 256
    counts = np.bincount(columns.ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF_BYTE
    set_bits = (2 * counts.ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def add_fingerprints(docs: DataFrame, text: str, shingle: int, name: str) -> DataFrame:
    """The other columns of ``docs`` as they are, ``text`` replaced by the fingerprint
    ``name`` as a signed 64-bit number."""
    others = [c for c in docs.columns if c not in (text, name)]
    schema = docs.select(*others).schema.add(name, "long")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_in_pieces(whole):
                texts = batch.column(text).cast(pa.binary()).to_pylist()
                values = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in others), values], [*others, name]
                )

    return docs.select(*others, text).mapInArrow(tidy(score), schema)


class BkTree:
    """A BK-tree that knows how much of every subtree is still unconsumed."""

    def __init__(self, values: list[int]):
        self.values = values
        self.parent = [-1] * len(values)
        self.edges: list[dict[int, int]] = [{} for _ in values]
        self.live = [1] * len(values)
        self.alive = [True] * len(values)
        for i in range(1, len(values)):
            at = 0
            while True:
                distance = (values[i] ^ values[at]).bit_count()
                if (child := self.edges[at].get(distance)) is None:
                    self.edges[at][distance] = i
                    self.parent[i] = at
                    break
                at = child
        for i in range(len(values) - 1, 0, -1):
            self.live[self.parent[i]] += self.live[i]

    def consume(self, i: int) -> None:
        self.alive[i] = False
        while i >= 0:
            self.live[i] -= 1
            i = self.parent[i]

    def within(self, value: int, radius: int) -> list[int]:
        """The unconsumed entries at most ``radius`` bits away."""
        found, open_nodes = [], [0]
        while open_nodes:
            at = open_nodes.pop()
            if not self.live[at]:
                continue
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius and self.alive[at]:
                found.append(at)
            edges = self.edges[at]
            for d in range(distance - radius, distance + radius + 1):
                if (child := edges.get(d)) is not None:
                    open_nodes.append(child)
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect all values which chains of ``radius``-bit steps connect,
    each one to the first of its chain: at most one per value."""
    tree = BkTree(values)
    links = []
    for first in range(len(values)):
        if not tree.alive[first]:
            continue
        tree.consume(first)
        waiting = [first]
        while waiting and tree.live[0]:
            for i in tree.within(values[waiting.pop()], radius):
                tree.consume(i)
                links.append((values[i], values[first]))
                waiting.append(i)
    return links


def _blocks(n_rows: int, radius: int, shard_rows: int) -> int:
    """The fewest stretches whose shards hold few enough rows if bits are even."""
    blocks = radius + 1
    while blocks < 2 * radius and n_rows >> (BITS // blocks * (blocks - radius)) > shard_rows:
        blocks += 1
    return blocks


def _shard_keys(value: Column, radius: int, blocks: int) -> Column:
    """Per choice of stretches, its number and the bits there."""
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [
        sum(((1 << (ends[b + 1] - ends[b])) - 1) << ends[b] for b in chosen)
        for chosen in combinations(range(blocks), blocks - radius)
    ]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = [
        F.struct(F.lit(i).alias("table"), value.bitwiseAND(F.lit(m).cast("bigint")).alias("key"))
        for i, m in enumerate(signed)
    ]
    return F.explode(F.array(*keys))


def fingerprint_links(
    values: DataFrame, radius: int, shard_rows: int = SHARD_ROWS, n_rows: int | None = None
) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``radius``
    bits. ``values``: one bigint column of distinct fingerprints, a written table."""
    name = values.columns[0]
    blocks = _blocks(values.count() if n_rows is None else n_rows, radius, shard_rows)
    keyed = values.select(
        F.col(name).alias("value"), _shard_keys(F.col(name), radius, blocks).alias("k")
    ).select("value", "k.*")
    crowded = (
        keyed.groupBy("table", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("table", "key", F.ceil(F.col("n") / shard_rows).alias("parts"))
    )
    part = F.pmod(F.xxhash64("value"), F.col("parts"))
    # With p parts every row meets each of the parts once, as the lower or the
    # higher part of a pair; with one part the only pair is (0, 0).
    others = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    placed = (
        keyed.join(crowded, ["table", "key"])
        .withColumn("part", part)
        .withColumn("other", F.explode(others))
        .where((F.col("parts") == 1) | (F.col("part") != F.col("other")))
        .select(
            "table",
            "key",
            F.least("part", "other").alias("low"),
            F.greatest("part", "other").alias("high"),
            "value",
        )
    )
    shard = ["table", "key", "low", "high"]

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in sorted_groups(iter(batches), shard):
            # As unsigned numbers, so that a difference has no sign bit of its own.
            own = rows["value"].to_numpy().view(np.uint64).tolist()
            for x, y in shard_links(own, radius):
                a.append(x)
                b.append(y)
            if len(a) >= 50_000:
                yield _edges(a, b)
                a, b = [], []
        yield _edges(a, b)

    return (
        placed.repartition(*shard)
        .sortWithinPartitions(*shard)
        .mapInArrow(tidy(search), "a bigint, b bigint")
        .distinct()
    )


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    pair = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(pair, ["a", "b"])


def _members(
    docs: DataFrame, doc_id: str, text: str, shingle: int, radius: int, shard_rows: int
) -> DataFrame:
    """Per row of ``docs``: ``(doc_id, text_key, value, component, component_id)``, where
    ``component`` is the smallest fingerprint of the component."""
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
        F.col(text).alias("text"),
    )
    marked = write_through(add_fingerprints(narrow, "text", shingle, "value"), "fingerprints")
    classes = write_through(marked.groupBy("value").agg(F.min("doc_id").alias("low")), "classes")
    links = write_through(fingerprint_links(classes.select("value"), radius, shard_rows), "links")
    components = connected_components(links)
    members = classes.join(
        components.select(F.col("node").alias("value"), "component"), "value", "left"
    ).withColumn("component", F.coalesce("component", "value"))
    # Tables of their own, so that a large component can be dealt out to several tasks.
    members = write_through(members, "members")
    lowest = write_through(
        members.groupBy("component").agg(F.min("low").alias("component_id")), "lowest"
    )
    named = members.join(lowest, "component").select("value", "component", "component_id")
    return marked.join(named, "value")


def simhash_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    radius: int = 4,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    The fingerprint is 16 hex digits. The component is the smallest ``doc_id`` that
    links of at most ``radius`` differing bits reach. Texts without a word, nulls
    included, have fingerprint zero and link like any other. Rows without an id are
    linked but never name a component; a component of such rows only is null.
    Repeated rows stay. Other columns of ``docs`` are not looked at.
    """
    rows = _members(docs, doc_id, text, shingle, radius, shard_rows)
    return rows.select(
        F.col("doc_id").alias(doc_id),
        F.lower(F.lpad(F.hex("value"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_per_group(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    radius: int = 4,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The row of each group with the smallest id, all its columns as they are.

    Rows without an id come after all others; of rows with equal id and text one
    stays. The winners are found on ids and hashes, combined before the shuffle, and
    only then meet the texts.
    """
    rows = _members(docs, doc_id, text, shingle, radius, shard_rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    # One column as the key, so that the rows are dealt out once for both steps; a
    # struct, because structs of nulls are equal.
    (key,) = free_names(docs, "winner")
    winners = rows.groupBy("component").agg(first.alias("w")).select(
        F.struct(F.col("w.doc_id").alias("i"), F.col("w.text_key").alias("h")).alias(key)
    )
    text_key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    own = docs.withColumn(key, F.struct(F.col(doc_id).alias("i"), text_key.alias("h")))
    kept = own.join(winners.distinct(), key, "left_semi")
    return kept.dropDuplicates([key]).select(*[F.col(c) for c in docs.columns])
