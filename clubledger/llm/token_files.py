"""Token ids in files: every document compressed on its own with one dictionary.

The format is a folder of two Parquet tables. ``dictionary`` has one row: the
zstandard dictionary, trained on serialized id arrays, and its SHA-256. ``blocks`` has
rows of up to ``BLOCK_DOCS`` documents in ascending order of id: part and block
number, the dictionary's hash, the documents' ids and token counts, the offsets of
their frames, and the frames one after the other. A frame is a document's ids as
little-endian numbers of ``width`` bytes, so a short document is read by itself: find
its block by the smallest and largest id, slice its frame, decompress that.

Parts are ranges of ids, so a part is written by one task and no order beyond it is
needed; the position of a document in the whole stream is its position in the part
plus the sizes of the parts before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clubledger.llm.common import hashed_share, importable_by_workers, rows_in_pieces, tidy
from clubledger.llm.tokens import crc32_of_ids, encoder

BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20
LEVEL = 3
#: Bounds of what the dictionary is trained on: documents, and bytes of each one's ids.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 8192, 32768


@dataclass
class Dictionary:
    """The shared dictionary and the hash that names it."""

    content: bytes

    @property
    def sha256(self) -> str:
        return hashlib.sha256(self.content).hexdigest()

    def compressor(self) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(self.content)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held)

    def decompressor(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(self.content))


def _with_end(data: bytes, end_id: int, width: int) -> bytes:
    return data + end_id.to_bytes(width, "little")


def train_dictionary(
    docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> Dictionary:
    """A dictionary from the ids of about ``SAMPLE_DOCS`` documents chosen by a hash;
    of a longer one, a stretch from its middle. Empty if there are too few."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sample = hashed_share(narrow, "doc_id", narrow.count(), SAMPLE_DOCS, "dictionary")

    def serialize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for whole in batches:
            for batch in rows_in_pieces(whole):
                out = []
                for data in coder.encode(batch.column("text").to_pylist()):
                    data = _with_end(data, end_id, coder.width)
                    room = max(0, len(data) - SAMPLE_BYTES) // 2
                    room -= room % coder.width
                    out.append(data[room : room + SAMPLE_BYTES])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    rows = sample.select("text").mapInArrow(serialize, "ids binary").limit(2 * SAMPLE_DOCS)
    samples = sorted(bytes(r["ids"]) for r in rows.collect())
    if len(samples) < 64:
        return Dictionary(b"")
    try:
        return Dictionary(zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes())
    except zstandard.ZstdError:  # too little to train on
        return Dictionary(b"")


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    dictionary: Dictionary | None = None,
) -> None:
    """Writes the ids of all documents, each followed by ``end_id``, below ``path``.

    A null text is an empty one. Rows are in ascending order of id, equal ids in
    that of a hash of the text, missing ids last; repeated rows stay. Other columns
    are not written. An empty table gives an empty folder that can be read.
    """
    spark = docs.sparkSession
    dictionary = dictionary or train_dictionary(docs, tokenizer, end_id, doc_id, text)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = (
        "part int, block int, dictionary_sha256 string, width int, n_docs int, n_ids bigint, "
        f"low {id_type}, high {id_type}, doc_ids array<{id_type}>, counts array<bigint>, "
        "offsets array<bigint>, frames binary"
    )
    content, sha256 = dictionary.content, dictionary.sha256

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, compress = encoder(tokenizer), Dictionary(content).compressor().compress
        part, block = TaskContext.get().partitionId(), 0
        ids, counts, frames, size, kind = [], [], [], 0, None

        def row() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            known = [i for i in ids if i is not None]
            values = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([sha256]),
                pa.array([coder.width], pa.int32()),
                pa.array([len(ids)], pa.int32()),
                pa.array([sum(counts)], pa.int64()),
                pa.array(known[:1] or [None], kind),
                pa.array(known[-1:] or [None], kind),
                pa.array([ids], pa.list_(kind)),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([offsets], pa.list_(pa.int64())),
                pa.array([b"".join(frames)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(values, [f.split()[0] for f in schema.split(", ")])

        for whole in batches:
            kind = whole.column("doc_id").type
            for batch in rows_in_pieces(whole):
                encoded = coder.encode(batch.column("text").to_pylist())
                for i, data in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                    data = _with_end(data, end_id, coder.width)
                    ids.append(i)
                    counts.append(len(data) // coder.width)
                    frames.append(compress(data))
                    size += len(frames[-1])
                    if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield row()
                        block, ids, counts, frames, size = block + 1, [], [], [], 0
        if ids:
            yield row()

    blocks = ordered.mapInArrow(tidy(encode), schema)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    held = spark.createDataFrame([(sha256, content)], "sha256 string, content binary")
    held.coalesce(1).write.parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str) -> Dictionary:
    importable_by_workers(spark)
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = Dictionary(bytes(row["content"]))
    if dictionary.sha256 != row["sha256"]:
        raise ValueError(f"the dictionary under {path} is damaged")
    return dictionary


def _frames(blocks: DataFrame, dictionary: Dictionary, ids_too: bool) -> DataFrame:
    """One row per document of these blocks, from its decompressed frame."""
    content, sha256 = dictionary.content, dictionary.sha256
    id_type = blocks.schema["low"].dataType.simpleString()
    schema = (
        f"part int, block int, place int, doc_id {id_type}, within bigint, n_tokens bigint, "
        f"ids_crc32 bigint{', ids array<int>' if ids_too else ''}"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = Dictionary(content).decompressor().decompress
        for whole in batches:
            for i in range(whole.num_rows):
                row = whole.slice(i, 1)
                if row.column("dictionary_sha256")[0].as_py() != sha256:
                    raise ValueError("a block was written with another dictionary")
                frames = row.column("frames")[0].as_py()
                offsets = row.column("offsets")[0].as_py()
                counts = row.column("counts")[0].as_py()
                width = row.column("width")[0].as_py()
                wanted = row.column("wanted")[0].as_py()
                places = range(len(counts)) if wanted is None else wanted
                starts = np.cumsum([0, *counts])
                found = []
                for k in places:
                    data = decompress(frames[offsets[k] : offsets[k + 1]])
                    found.append(np.frombuffer(data, f"<u{width}"))
                    if len(found[-1]) != counts[k]:
                        raise ValueError("a frame has another number of ids than its index says")
                doc_ids = row.column("doc_ids")[0].values
                n = len(found)
                columns = [
                    pa.array([row.column("part")[0].as_py()] * n, pa.int32()),
                    pa.array([row.column("block")[0].as_py()] * n, pa.int32()),
                    pa.array(list(places), pa.int32()),
                    doc_ids.take(pa.array(list(places), pa.int32())),
                    pa.array([int(starts[k]) for k in places], pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([crc32_of_ids(x) for x in found], pa.int64()),
                ]
                if ids_too:
                    kind = pa.list_(pa.int32())
                    columns.append(pa.array([x.astype(np.int32) for x in found], kind))
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.drop("low", "high", "n_docs", "n_ids").mapInArrow(tidy(decode), schema)


def read_token_files(spark: SparkSession, path: str, ids_too: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read back from the
    files; with ``ids_too`` the ids themselves as ``ids``.

    ``start`` counts the ids of all documents before it in the files' order.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", "block", "n_ids")
    # Blocks within a part, then parts: one row per part reaches a single task.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before), none).alias("first"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "part", "block", F.coalesce(F.sum("n_ids").over(inside), none).alias("ahead")
    ).join(parts, "part")
    whole = blocks.withColumn("wanted", F.lit(None).cast("array<int>"))
    documents = _frames(whole, _dictionary(spark, path), ids_too)
    return documents.join(starts, ["part", "block"]).select(
        "doc_id",
        (F.col("first") + F.col("ahead") + F.col("within")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if ids_too else []),
    )


def read_documents(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """``(doc_id, n_tokens, ids_crc32, ids)`` of a few documents: only blocks whose
    range holds one of them are read, and only their frames decompressed."""
    blocks = spark.read.parquet(f"{path}/blocks")
    wanted = F.array(*[F.lit(i).cast(blocks.schema["low"].dataType) for i in doc_ids])
    inside = F.exists(wanted, lambda i: (F.col("low") <= i) & (i <= F.col("high")))
    near = (F.col("high") >= F.lit(min(doc_ids))) & (F.col("low") <= F.lit(max(doc_ids)))
    places = F.filter(
        F.sequence(F.lit(0), F.size("doc_ids") - 1),
        lambda k: F.array_contains(wanted, F.get("doc_ids", k)),
    )
    found = blocks.where(near & inside).withColumn("wanted", places).where(F.size("wanted") > 0)
    rows = _frames(found, _dictionary(spark, path), True)
    return rows.select("doc_id", "n_tokens", "ids_crc32", "ids")
