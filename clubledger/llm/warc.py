"""WARC archives compressed with a Zstandard dictionary of their own.

An archive is a file: a skippable frame that holds the dictionary, then one Zstandard
frame per record, so a record can be read by itself given its offset and the head of
its file. The dictionary is trained once per collection on a bounded sample of
serialized records, and every archive carries it. A ``warcinfo`` record comes first.

A page's record is a ``response`` with its whole payload, or a ``revisit`` of the one
response that holds the same payload, with the digest and the length but no payload.
Only payloads of ``LEAST_SHARED`` bytes or more are shared.

Spark's text writer puts each archive, a single binary value, into a file of its own
and ends it with the line separator, which is an empty skippable frame and thereby
part of a sound Zstandard file. Executors share nothing but the target folder; a lost
task is written again, and only finished files appear.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clubledger.llm.common import hashed_share, importable_by_workers, rows_in_pieces, tidy
from clubledger.operators.skew import heavy_rows
from clubledger.session import write_counted

LEVEL = 3
#: Payloads shorter than this are written every time.
LEAST_SHARED = 100
#: Bounds of what the dictionary is trained on: records, bytes of each, and its size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 8192, 65536
#: An archive is closed once it holds so many bytes of records before compression.
ARCHIVE_BYTES = 32 << 20
#: Copies of one payload that a join may gather in a task.
COPIES_PER_TASK = 10_000

# Fixed values of the two formats.
_DICTIONARY_FRAME = 0x184D2A5D
_SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
_ZSTANDARD_FRAME = 0xFD2FB528
_EMPTY_FRAME = "P*M\x18\0\0\0\0"  # skippable frame 0x184D2A50 of length 0
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = "1970-01-01T00:00:00Z"


class DamagedArchive(ValueError):
    """A file is not what the writer makes."""


# -- records --------------------------------------------------------------------------
def _uri(text: str) -> str:
    """A URL that fits a header line: control characters are percent-encoded."""
    return "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in text)


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def response_id(page_id: int | None, digest: str) -> str:
    """The name of the response that shares its payload; revisits can name it too."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def page_record(
    page_id: int | None,
    url: str | None,
    payload: bytes | None,
    size: int,
    digest: str,
    refers_to: tuple[int | None] | None,
    name: str,
    date: str = _EPOCH,
) -> bytes:
    """The record of one page; ``refers_to`` holds the response's page of a revisit,
    which has no payload but says how long and of which digest it is."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += f"Content-Length: {size}\r\n\r\n"
    first = refers_to[0] if refers_to else None
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", name),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _uri(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", _IDENTICAL if refers_to else None),
        ("WARC-Refers-To", response_id(first, digest) if refers_to else None),
        ("Page-ID", None if page_id is None else str(page_id)),
        ("Refers-To-Page-ID", None if first is None else str(first)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return _record(fields, http.encode() + (b"" if refers_to else payload or b""))


def _info_record(name: str) -> bytes:
    text = b"software: clubledger\r\nformat: WARC File Format 1.1\r\n"
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", name),
        ("WARC-Date", _EPOCH),
        ("Content-Type", "application/warc-fields"),
    ]
    return _record(fields, text)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if line)


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, those of the HTTP answer, and the payload of a record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        raise DamagedArchive("a frame does not hold a record")
    fields = _fields(head)
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise DamagedArchive("a record has another length than its header says")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return fields, {}, rest[:size]
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


# -- frames ---------------------------------------------------------------------------
def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame at the head of an archive; none without a dictionary."""
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", _DICTIONARY_FRAME, len(packed)) + packed


def frame_end(data: memoryview, start: int) -> int:
    """Where the Zstandard frame at ``start`` ends, found from its block headers."""
    at = start + zstandard.frame_header_size(data[start : start + 18])
    checked = zstandard.get_frame_parameters(data[start : start + 18]).has_checksum
    while True:
        if at + 3 > len(data):
            raise DamagedArchive("a frame ends in the middle of a block")
        header = int.from_bytes(data[at : at + 3], "little")
        is_last, kind, size = header & 1, header >> 1 & 3, header >> 3
        at += 3 + (1 if kind == 1 else size)
        if is_last:
            return at + 4 * checked


def archive_frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and decompressed record of each frame of an archive, in order."""
    data, at = memoryview(content), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 8 <= len(data) else 0
        if magic in _SKIPPABLE_FRAMES:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            if magic == _DICTIONARY_FRAME:
                if at:
                    raise DamagedArchive("the dictionary is not at the head of the file")
                held = bytes(data[8:end])
                if held[:4] == struct.pack("<I", _ZSTANDARD_FRAME):
                    held = zstandard.ZstdDecompressor().decompress(held)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        elif magic == _ZSTANDARD_FRAME:
            end = frame_end(data, at)
            yield at, reader.decompress(data[at:end])
        else:
            raise DamagedArchive(f"no frame starts at byte {at}")
        at = end


# -- the dictionary ---------------------------------------------------------------------
def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the records of about ``SAMPLE_RECORDS`` pages chosen by a hash;
    of a long record its head and a stretch from its middle. Empty if there are too few.

    ``pages(page_id, url, payload)``, the payload as bytes."""
    sample = hashed_share(pages, "page_id", pages.count(), SAMPLE_RECORDS, "warc")

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = SAMPLE_BYTES // 2
        for whole in batches:
            for batch in rows_in_pieces(whole):
                out = []
                for row in batch.to_pylist():
                    payload = row["payload"]
                    digest = hashlib.sha256(payload).hexdigest()
                    name = response_id(row["page_id"], digest)
                    page = (row["page_id"], row["url"], payload, len(payload))
                    data = page_record(*page, digest, None, name)
                    if len(data) > SAMPLE_BYTES:
                        middle = len(data) // 2
                        data = data[:half] + data[middle : middle + half]
                    out.append(data)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = sample.limit(2 * SAMPLE_RECORDS).mapInArrow(records, "record binary").collect()
    samples = sorted(bytes(r["record"]) for r in rows)
    if len(samples) < 64:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b""


# -- which page answers -----------------------------------------------------------------
def _order_key(page_id: Column) -> Column:
    """Pages in order of id, those without an id last."""
    return F.struct(page_id.isNull().alias("none"), page_id.alias("page_id"), F.col("url"))


def first_pages(keys: DataFrame) -> DataFrame:
    """``(digest, first, n, n_first)`` of every payload that several rows share.

    ``keys(page_id, url, digest)``. ``first`` is the page that answers for the others,
    ``n_first`` how many rows are equal to it. Equal rows are counted together first."""
    rows = keys.groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("m"))
    return (
        rows.withColumn("key", _order_key(F.col("page_id")))
        .groupBy("digest")
        .agg(
            F.min(F.struct("key", "m")).alias("low"),
            F.sum("m").alias("n"),
        )
        .where("n > 1")
        .select("digest", F.col("low.key").alias("first"), "n", F.col("low.m").alias("n_first"))
    )


def _with_first(rows: DataFrame, firsts: DataFrame, copies: int) -> DataFrame:
    """Rows with ``first`` and ``n_first`` of their digest, where several share it.

    Rows of a payload with more than ``copies`` copies never meet in one place: such
    payloads, a millionth of all rows each at least, are broadcast, and their rows
    take part in the join by digest under a key of their own that nothing has."""
    heavy = heavy_rows(firsts, copies).select(
        "digest", F.struct("first", "n_first").alias("heavy")
    )
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")).cast("binary")
    marked = marked.withColumn("key", F.when(F.col("heavy").isNull(), F.col("digest")).otherwise(own))
    light = firsts.select(F.col("digest").alias("key"), F.struct("first", "n_first").alias("light"))
    both = F.coalesce("heavy", "light")
    return marked.join(light, "key", "left").select(
        "page_id", "url", "payload", "size", "digest",
        both["first"].alias("first"), both["n_first"].alias("n_first"),
    )


def assign_roles(pages: DataFrame, least_shared: int, copies: int) -> DataFrame:
    """``pages(page_id, url, payload)`` with its ``size`` and ``digest``, ``first_id``,
    the page that answers, ``is_shared``, whether there is one, and how many responses
    and revisits to write for the row: one record, but for equal rows, of which one
    row stands for up to ``copies``."""
    hashed = pages.select(
        "*",
        F.octet_length("payload").cast("bigint").alias("size"),
        F.unhex(F.sha2("payload", 256)).alias("digest"),
    )
    keys = hashed.where(F.col("size") >= least_shared).select("page_id", "url", "digest")
    firsts, n_firsts = write_counted(first_pages(keys), "shared-payloads")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    if not n_firsts:
        return hashed.select(
            "page_id", "url", "payload", "size", "digest", F.lit(False).alias("is_shared"),
            F.lit(None).cast(hashed.schema["page_id"].dataType).alias("first_id"),
            one.alias("responses"), zero.alias("revisits"),
        )
    rows = _with_first(hashed, firsts, copies)
    is_first = F.col("first").eqNullSafe(_order_key(F.col("page_id")))
    shared = F.col("n_first").isNotNull()
    role = rows.select(
        "page_id", "url", "payload", "size", "digest", shared.alias("is_shared"),
        F.col("first.page_id").alias("first_id"), "n_first",
        F.when(shared & ~is_first, zero).otherwise(one).alias("responses"),
        F.when(shared & ~is_first, one).otherwise(zero).alias("revisits"),
    )
    if firsts.where("n_first > 1").isEmpty():
        return role.drop("n_first")
    # Equal rows that could all answer are counted, and one of them answers; the
    # others, which need no payload, are dealt out in portions.
    several = (F.col("responses") == 1) & F.col("is_shared") & (F.col("n_first") > 1)
    portion, whole = F.col("portion"), F.lit(copies).cast("bigint")
    taken = F.least(whole, F.col("m") - portion * whole)
    alike = (
        role.where(several)
        .groupBy("page_id", "url", "size", "digest", "is_shared", "first_id")
        .agg(F.any_value("payload").alias("payload"), F.count(F.lit(1)).alias("m"))
        .withColumn("portion", F.explode(F.sequence(zero, F.floor((F.col("m") - 1) / whole))))
        .withColumns(
            {
                "payload": F.when(portion == 0, F.col("payload")),
                "responses": (portion == 0).cast("bigint"),
                "revisits": taken - (portion == 0).cast("bigint"),
            }
        )
        .repartition("digest", "portion")
        .drop("m", "portion")
    )
    return role.where(~several).drop("n_first").unionByName(alike)


# -- writing and reading ------------------------------------------------------------------
def _page_columns(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    return pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_shared: int = LEAST_SHARED,
    archive_bytes: int = ARCHIVE_BYTES,
    copies_per_task: int = COPIES_PER_TASK,
) -> None:
    """One record per page in archives below ``path``.

    The payload is the page's text in UTF-8, empty if null. Of pages with equal
    payloads of ``least_shared`` bytes or more, the one with the smallest id (missing
    ids last, then the smallest URL) is the response, and the others revisit it. Equal
    rows are one response and revisits of the same id. A missing URL has no header, a
    missing id neither. Other columns are not written. No pages, no archives.
    A page and its compressed archive are held by one worker at a time.
    """
    spark = pages.sparkSession
    importable_by_workers(spark)
    narrow = _page_columns(pages, page_id, url, html)
    dictionary = train_dictionary(narrow)
    rows = assign_roles(narrow, least_shared, copies_per_task)

    def archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if held:
            held.precompute_compress(level=LEVEL)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=held).compress
        head, part = dictionary_frame(dictionary), TaskContext.get().partitionId()
        frames, size, number = [], 0, 0

        def name() -> str:
            return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{path}:{part}:{number}').urn}>"

        def file() -> pa.RecordBatch:
            whole = b"".join([head, *frames])
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.large_binary())], ["archive"])

        for whole in batches:
            for batch in rows_in_pieces(whole):
                for row in batch.to_pylist():
                    digest = row["digest"].hex()
                    page = (row["page_id"], row["url"], row["payload"], row["size"], digest)
                    kinds = [None] * row["responses"] + [(row["first_id"],)] * row["revisits"]
                    for refers_to in kinds:
                        if not frames:
                            frames.append(compress(_info_record(name())))
                            number += 1
                        answers = row["is_shared"] and refers_to is None
                        own = response_id(page[0], digest) if answers else name()
                        record = page_record(*page, refers_to, own)
                        frames.append(compress(record))
                        size, number = size + len(record), number + 1
                        if size >= archive_bytes:
                            yield file()
                            frames, size = [], 0
        if frames:
            yield file()

    # The bytes go as they are into a text column; each row ends in an empty frame.
    files = rows.mapInArrow(tidy(archive), "archive binary").select(F.col("archive").cast("string"))
    files.write.option("lineSep", _EMPTY_FRAME).option("maxRecordsPerFile", 1).option(
        "compression", "none"
    ).text(path)


def read_archives(spark: SparkSession, path: str, payload_too: bool = False) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, file,
    offset)`` of every response and revisit below ``path``.

    A response's payload has to have the digest and the length that its headers name.
    ``file`` and ``offset`` are what ``read_record`` needs; with ``payload_too`` the
    payload of responses comes along. An empty folder has no rows.
    """
    importable_by_workers(spark)
    names = {
        "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(),
        "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
        "file": pa.string(), "offset": pa.int64(), "payload": pa.large_binary(),
    }
    if not payload_too:
        del names["payload"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([r[n] for r in found], t) for n, t in names.items()]
            return pa.RecordBatch.from_arrays(columns, list(names))

        for batch in batches:
            for place in range(batch.num_rows):
                file = batch.column("path")[place].as_py()
                found, size = [], 0
                for offset, data in archive_frames(batch.column("content")[place].as_py()):
                    row = _page_row(data)
                    if row is None:
                        continue
                    found.append({**row, "file": file, "offset": offset})
                    size += len(row["payload"] or b"") if payload_too else 0
                    if len(found) >= 10_000 or size >= 16 << 20:
                        yield rows(found)
                        found, size = [], 0
                yield rows(found)

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.large_binary(): "binary"}
    schema = ", ".join(f"{n} {kinds[t]}" for n, t in names.items())
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(tidy(read), schema)


def _page_row(data: bytes) -> dict | None:
    """What a record says of its page; nothing of records that are not of pages."""
    fields, http, payload = parse_record(data)
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(http["Content-Length"])
    if kind == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
        raise DamagedArchive("a payload has another digest or length than its headers say")
    ids = [int(fields[n]) if n in fields else None for n in ("Page-ID", "Refers-To-Page-ID")]
    return {
        "page_id": ids[0], "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": ids[1],
        "payload": payload if kind == "response" else None,
    }


def read_record(content: bytes, offset: int) -> bytes:
    """One record of an archive by its offset: the head of the file and its own frame."""
    magic = struct.unpack_from("<I", content, 0)[0]
    head = 8 + struct.unpack_from("<I", content, 4)[0] if magic == _DICTIONARY_FRAME else 0
    data = memoryview(content)
    frame = bytes(data[offset : frame_end(data, offset)])
    return next(r for _, r in archive_frames(bytes(data[:head]) + frame))
