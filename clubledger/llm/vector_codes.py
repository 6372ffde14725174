"""Short codes for vectors: per part of a vector the nearest entry of a codebook.

Vectors of whole numbers are cut into equal consecutive parts. The written index holds
flat blocks: the vectors of a chunk are sorted, for each part position, along a Hilbert
curve through that part's space, and every ``BLOCK_ROWS`` neighbours on the curve make
a block with the smallest box around them and the sum of them. Both are computed once
and serve all rounds.

A round compares the codebook with the boxes first. Some point of a box may be nearest
to an entry only if the entry's least distance to the box does not exceed the smallest
of all entries' greatest distances to it; these entries are the block's shortlist. A
block with a shortlist of one is assigned by its sum and its number of points alone.
For any other, small kernels compare its points with the shortlisted entries, in whole
numbers, so ties are exact and go to the lower index. Chunks give sums and numbers per
entry, which Spark adds up, and no more than those reach the driver: one row per part
and entry. The codebook that follows from them goes to the tasks of the next round.

A chunk holds all parts of its vectors, so codes are put together where they are found
and no vector is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clubledger.llm.common import importable_by_workers, tidy
from clubledger.llm.topk_pivots import usable
from clubledger.operators.skew import skew_join
from clubledger.session import write_through

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components of a chunk's vectors, and vectors of a block within it.
CHUNK_COMPONENTS, BLOCK_ROWS = 1 << 20, 16
#: Numbers up to this size have exact distances in 64 bits, whatever the part's width.
LARGEST = 1 << 26
#: Cells of the grids that one kernel fills at a time.
_CELLS = 1 << 20


def whole(vector: Column, factor: int) -> Column:
    """Each component as the largest whole number not above ``factor`` times it."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor))


# -- the curve ------------------------------------------------------------------------
def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates below ``2 ** bits``.

    Skilling's transform (2004), for all points at once: it turns each point's
    coordinates into the place's bits, dealt over the coordinates."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(len(x)):
            swapped = np.where(x[i] & level, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(x[i] & level, x[0] ^ below, x[0] ^ swapped)
            if i:
                x[i] = x[i] ^ swapped
        level >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flips, level = np.zeros(len(points), dtype=np.int64), 1 << (bits - 1)
    while level > 1:
        flips = np.where(x[-1] & level, flips ^ (level - 1), flips)
        level >>= 1
    place = np.zeros(len(points), dtype=np.int64)
    for bit in reversed(range(bits)):
        for axis in x:
            place = place << 1 | ((axis ^ flips) >> bit & 1)
    return place


def curve_order(points: np.ndarray) -> np.ndarray:
    """An order of points along a Hilbert curve over the box around them.

    With more dimensions than a number has bits, the first ones decide; the order
    makes blocks small and has no influence on any result."""
    seen = points[:, :60]
    bits = max(1, min(16, 60 // max(1, seen.shape[1])))
    low = seen.min(axis=0)
    extent = np.maximum(1, seen.max(axis=0) - low)
    cells = (seen - low) * ((1 << bits) - 1) // extent
    return np.argsort(hilbert_index(cells, bits), kind="stable")


# -- blocks -----------------------------------------------------------------------------
def make_blocks(points: np.ndarray, block_rows: int) -> tuple[np.ndarray, ...]:
    """Order of the points, the points in it (the last one repeated until the last
    block is full), and per block its least and greatest corner and its sum."""
    order = curve_order(points)
    placed = points[order]
    starts = np.arange(0, len(points), block_rows)
    low = np.minimum.reduceat(placed, starts, axis=0)
    high = np.maximum.reduceat(placed, starts, axis=0)
    sums = np.add.reduceat(placed, starts, axis=0)
    missing = -len(points) % block_rows
    full = np.concatenate([placed, np.repeat(placed[-1:], missing, axis=0)])
    return order, full, low, high, sums


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Whether an entry (column) can be nearest to a point of a block (row)."""
    out = np.empty((len(low), len(entries)), dtype=bool)
    step = max(1, _CELLS // max(1, entries.size))
    for at in range(0, len(low), step):
        below = low[at : at + step, None, :] - entries[None]
        above = entries[None] - high[at : at + step, None, :]
        gap = np.maximum(0, np.maximum(below, above))
        far = np.maximum(np.abs(below), np.abs(above))
        least, most = (gap * gap).sum(axis=2), (far * far).sum(axis=2)
        out[at : at + step] = least <= most.min(axis=1)[:, None]
    return out


def nearest_in_blocks(
    points: np.ndarray, entries: np.ndarray, listed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per point of each block the nearest shortlisted entry, the lower of equally near
    ones, and its squared distance.

    ``points`` has the shape blocks x rows x width, ``listed`` blocks x entries. Blocks
    with shortlists of nearly one length are compared together, shorter lists filled up
    by their last entry."""
    index = np.empty(points.shape[:2], dtype=np.int64)
    squared = np.empty(points.shape[:2], dtype=np.int64)
    reach = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int32 if 4 * reach * reach * points.shape[2] < 1 << 31 else np.int64
    points, entries = points.astype(kind), entries.astype(kind)
    lengths = listed.sum(axis=1)
    # Entries of each block's list first, in ascending order.
    first = np.argsort(~listed, axis=1, kind="stable")
    slots = np.arange(listed.shape[1])
    first = np.where(slots < lengths[:, None], first, first[np.arange(len(first)), lengths - 1][:, None])
    padded = -(-lengths // 4) * 4
    for length in np.unique(padded):
        blocks = np.flatnonzero(padded == length)
        step = max(1, _CELLS // int(length * points.shape[1]))
        for at in range(0, len(blocks), step):
            some = blocks[at : at + step]
            names = first[some, :length]
            grid = np.zeros((len(some), points.shape[1], names.shape[1]), dtype=kind)
            for k in range(points.shape[2]):
                gap = points[some, :, k, None] - entries[names, k][:, None, :]
                gap *= gap
                grid += gap
            best = grid.argmin(axis=2)
            index[some] = np.take_along_axis(names, best, axis=1)
            squared[some] = np.take_along_axis(grid, best[:, :, None], axis=2)[:, :, 0]
    return index, squared


class Chunk:
    """The vectors of one row of the index, with the blocks of every part position."""

    def __init__(self, row: dict):
        n, parts, rows = row["n"], row["parts"], row["block_rows"]
        each, blocks = row["width"] // parts, -(-n // rows)

        def numbers(name: str, kind: str, *shape: int) -> np.ndarray:
            return np.frombuffer(row[name], dtype=kind).reshape(shape).astype(np.int64)

        self.n, self.blocks = n, blocks
        self.points = numbers("points", "<i4", parts, blocks, rows, each)
        self.order = numbers("order", "<i4", parts, n)
        self.low = numbers("low", "<i4", parts, blocks, each)
        self.high = numbers("high", "<i4", parts, blocks, each)
        self.sums = numbers("sums", "<i8", parts, blocks, each)
        self.sizes = np.full(blocks, rows)
        self.sizes[-1:] = n - rows * (blocks - 1)

    def totals(self, part: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per entry the number and the sum of the points nearest to it."""
        listed = shortlists(self.low[part], self.high[part], entries)
        certain = listed.sum(axis=1) == 1
        owner = listed[certain].argmax(axis=1)  # whole blocks, by number and sum
        index, _ = nearest_in_blocks(self.points[part][~certain], entries, listed[~certain])
        real = np.arange(index.shape[1]) < self.sizes[~certain][:, None]
        index, points = index[real], self.points[part][~certain][real]

        def added(whole: np.ndarray, single: np.ndarray | None) -> np.ndarray:
            # Doubles hold these sums exactly: a chunk's numbers are small enough.
            out = np.bincount(owner, whole, len(entries)) + np.bincount(index, single, len(entries))
            return out.astype(np.int64)

        sums = self.sums[part][certain]
        total = [added(sums[:, k], points[:, k]) for k in range(entries.shape[1])]
        return added(self.sizes[certain], None), np.column_stack(total)

    def codes(self, part: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, in the vectors' order."""
        listed = shortlists(self.low[part], self.high[part], entries)
        found = nearest_in_blocks(self.points[part], entries, listed)
        out = np.empty((2, self.n), dtype=np.int64)
        for line, values in zip(out, found, strict=True):
            line[self.order[part]] = values.ravel()[: self.n]
        return out[0], out[1]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and max(-flat.min(), flat.max()) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} have no exact distances in 64 bits")
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def build_index(
    vectors: DataFrame, width: int, parts: int, chunk_rows: int, block_rows: int
) -> DataFrame:
    """The written index of ``vectors(vec_id, label, vector)``: a row per chunk."""
    ids, label = vectors.schema["vec_id"].dataType, vectors.schema["label"].dataType
    schema = T.StructType(
        [
            *[T.StructField(c, T.IntegerType()) for c in ("n", "width", "parts", "block_rows")],
            T.StructField("ids", T.ArrayType(ids)),
            T.StructField("labels", T.ArrayType(label)),
            *[T.StructField(c, T.BinaryType()) for c in ("order", "points", "low", "high", "sums")],
        ]
    )

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        points = _matrix(rows["vector"].combine_chunks(), width).reshape(len(rows), parts, -1)
        blocks = [make_blocks(points[:, j], block_rows) for j in range(parts)]
        *small, sums = (np.stack(x) for x in zip(*blocks, strict=True))

        def one(column: str) -> pa.Array:
            values = rows[column].combine_chunks()
            return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), values)

        packed = [*[x.astype("<i4").tobytes() for x in small], sums.astype("<i8").tobytes()]
        sizes = (len(rows), width, parts, block_rows)
        numbers = [pa.array([x], pa.int32()) for x in sizes]
        lists = [one("vec_id"), one("label")]
        return pa.RecordBatch.from_arrays(
            [*numbers, *lists, *[pa.array([x], pa.binary()) for x in packed]], schema.names
        )

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, chunk_rows - n)
                held.append(taken)
                n += taken.num_rows
                batch = batch.slice(taken.num_rows)
                if n == chunk_rows:
                    yield chunk(held)
                    held, n = [], 0
        if held:
            yield chunk(held)

    narrow = vectors.select("vec_id", "label", "vector")
    return write_through(narrow.mapInArrow(tidy(chunks), schema), "code-blocks")


def next_codebook(index: DataFrame, codebook: np.ndarray) -> np.ndarray:
    """Every entry as the floor of the mean of its parts; an unused entry stays.

    ``codebook`` has the shape parts x entries x width of a part."""
    each = codebook.shape[2]

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(codebook.shape[:2], dtype=np.int64)
        total = np.zeros(codebook.shape, dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                held = Chunk(batch.slice(i, 1).to_pylist()[0])
                for j, entries in enumerate(codebook):
                    n, s = held.totals(j, entries)
                    count[j] += n
                    total[j] += s
        part, entry = np.nonzero(count)
        sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(count[part, entry], pa.int64()), sums], ["part", "entry", "n", "sums"]
        )

    needed = index.drop("ids", "labels")
    partial = needed.mapInArrow(tidy(totals), "part int, entry int, n bigint, sums array<bigint>")
    added = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(each)]
    )
    following = codebook.copy()
    for row in added.collect():  # a row per part and entry of the codebook
        sums = np.array([row[f"s{k}"] for k in range(each)], dtype=np.int64)
        following[row["part"], row["entry"]] = sums // row["n"]
    return following


def _coded(index: DataFrame, codebook: np.ndarray) -> DataFrame:
    types = {f: index.schema[f].dataType.elementType.simpleString() for f in ("ids", "labels")}
    digits = max(2, -(-(codebook.shape[1] - 1).bit_length() // 4))
    texts = np.array([f"{i:0{digits}x}" for i in range(codebook.shape[1])], dtype=object)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held = Chunk(row.drop_columns(["ids", "labels"]).to_pylist()[0])
                code, error = np.full(held.n, "", dtype=object), np.zeros(held.n, dtype=np.int64)
                for j, entries in enumerate(codebook):
                    found, away = held.codes(j, entries)
                    code, error = code + texts[found], error + away
                values = [row.column(c).flatten() for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays(
                    [*values, pa.array(code, pa.string()), pa.array(error)],
                    ["vec_id", "label", "code", "error"],
                )

    schema = f"vec_id {types['ids']}, label {types['labels']}, code string, error bigint"
    return index.mapInArrow(tidy(assign), schema)


def _with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the sum of the errors of equal labels; null is a label like the others."""
    key = F.struct("label").alias("key")  # structs of nulls are equal
    rows = coded.select("*", key)
    sums = rows.groupBy("key").agg(F.sum("error").alias("label_error"))
    # Written, so that Spark knows its size and broadcasts it if there are few labels.
    return skew_join(rows, write_through(sums, "label-errors"), "key", "inner").drop("key")


def encode_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    factor: int = 256,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    chunk_rows: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error, label_error)`` of every usable vector, and the
    codebook, an array of parts x entries x width of a part.

    Components are whole numbers, the floor of ``factor`` times them. The codebook
    starts as the vectors with the ``entries`` smallest ids (equal ids by the smaller
    vector, missing ids last; fewer vectors, fewer entries). ``rounds`` times, parts go
    to the nearest entry and entries to the floor of the mean of their parts. ``code``
    names the entries of the final codebook nearest to the parts, two hexadecimal
    digits each, ``error`` is the sum of the squared distances, ``label_error`` that
    of the label. Vectors that are null or hold a null or a number that is not finite
    take no part; shorter vectors, and those whose width is no multiple of ``parts``,
    count as if they ended in zeros. Repeated rows are coded each. A component beyond
    2**26 after scaling raises an error. Other columns are not read. Without a usable
    vector there are no rows, and the codebook is empty.
    """
    spark = vectors.sparkSession
    importable_by_workers(spark)
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("raw")
    ).where(usable(F.col("raw")))
    rows = rows.select("vec_id", "label", whole(F.col("raw"), factor).alias("vector"))
    widest = rows.agg(F.max(F.size("vector"))).first()[0]
    if widest is None:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string"
        empty = spark.createDataFrame([], f"{schema}, error bigint, label_error bigint")
        return empty, np.empty((parts, 0, 0), dtype=np.int64)
    width = max(1, -(-widest // parts)) * parts
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*order).limit(entries).select("vector").collect()
    start = np.zeros((len(first), width), dtype=np.int64)
    for line, row in zip(start, first, strict=True):
        line[: len(row["vector"])] = row["vector"]
    codebook = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    chunk_rows = chunk_rows or max(block_rows, CHUNK_COMPONENTS // width)
    index = build_index(rows, width, parts, chunk_rows, block_rows)
    for _ in range(rounds):
        codebook = next_codebook(index, codebook)
    coded = write_through(_coded(index, codebook), "codes")
    return _with_label_error(coded), codebook
