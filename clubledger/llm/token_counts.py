"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A ledger is a folder. Every batch of events (inserts, deletes, revised counts) is kept
below ``events`` and becomes signed rows per document, below ``deltas``, and their sums,
below ``rollups``. Totals are sums of rollups, so bringing them up to date reads a few
rows per batch and never the documents again. A batch counts from the moment its rollup
is complete; before that a repeated commit replaces what a failed one left, after that
it changes nothing.

Deltas lie in buckets by a hash of the document's id, sorted by id, so that a commit
reads of the history the buckets and the range of ids that it touches. After a number
of batches their deltas are summed up, below ``states``, and later commits read the
sums and the deltas since.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clubledger.llm.common import importable_by_workers, rows_in_pieces, tidy
from clubledger.llm.tokens import encoder
from clubledger.session import write_through

GROUP = ["source", "lang", "tokenizer"]
DELTA = "doc_id {0}, source string, lang string, tokenizer string, documents bigint, tokens bigint"
#: Buckets of a new ledger, and the bucket of what has no id; batches between two states.
BUCKETS, WITHOUT_ID = 64, -1
STATE_EVERY = 16


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    version: str,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
) -> DataFrame:
    """``(doc_id, source, lang, tokenizer, tokens)`` of every document's whole text,
    none for a null or empty one. Other columns are not looked at."""
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"),
        F.col(text).alias("text"),
    )
    names = ["doc_id", "source", "lang", "tokenizer", "tokens"]
    schema = narrow.drop("text").schema.add("tokenizer", "string").add("tokens", "long")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for whole in batches:
            for batch in rows_in_pieces(whole):
                texts = batch.column("text").to_pylist()
                sizes = [len(data) // coder.width for data in coder.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in names[:3]),
                        pa.array([version] * len(sizes), pa.string()),
                        pa.array(sizes, pa.int64()),
                    ],
                    names,
                )

    return narrow.mapInArrow(tidy(count), schema)


class TokenLedger:
    """Token counts below ``path``, a folder that all executors share.

    ``buckets`` holds for a new ledger; one that has batches keeps its number."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        id_type: str = "bigint",
        buckets: int = BUCKETS,
        state_every: int = STATE_EVERY,
    ):
        importable_by_workers(spark)
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        self.rows_schema = DELTA.format(id_type)
        self.delta_schema = f"{self.rows_schema}, bucket int"
        self.rollup_schema = self.rows_schema.split(", ", 1)[1]
        self.buckets, self.state_every = self._layout(buckets), state_every

    def _folder(self, path: str):
        made = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return made, made.getFileSystem(conf)

    def _names(self, path: str) -> list[str]:
        folder, store = self._folder(path)
        if not store.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in store.listStatus(folder))

    def _layout(self, buckets: int) -> int:
        """The number of buckets, which a folder's name keeps."""
        if buckets < 1:
            raise ValueError(f"not a number of buckets: {buckets}")
        kept = self._names(f"{self.path}/layout")
        if kept:
            return int(kept[0])
        folder, store = self._folder(f"{self.path}/layout/{buckets}")
        store.mkdirs(folder)
        return buckets

    def batches(self) -> list[str]:
        """The committed batches, by name."""
        return [n for n in self._names(f"{self.path}/rollups") if self.is_committed(n)]

    def is_committed(self, batch: str) -> bool:
        done, store = self._folder(f"{self.path}/rollups/{batch}/_SUCCESS")
        return store.exists(done)

    def _states(self) -> list[str]:
        """The complete states, oldest first: their names are numbers of batches."""
        names = self._names(f"{self.path}/states")
        return [n for n in names if "_SUCCESS" in self._names(f"{self.path}/states/{n}/covers")]

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _history(self) -> DataFrame:
        """The newest state and the deltas of the batches that it does not cover."""
        batches, states = self.batches(), self._states()
        covered: set[str] = set()
        rows = []
        if states:
            at = f"{self.path}/states/{states[-1]}"
            covered = {r["batch"] for r in self._read([f"{at}/covers"], "batch string").collect()}
            rows.append(self._read([f"{at}/documents"], self.delta_schema))
        since = [f"{self.path}/deltas/{b}" for b in batches if b not in covered]
        rows += [self._read([at], self.delta_schema) for at in since]
        return functools.reduce(DataFrame.unionByName, rows or [self._read([], self.delta_schema)])

    def _write_buckets(self, rows: DataFrame, path: str) -> None:
        """Rows by bucket and id. Tasks that would get too much are split, small
        ones merged."""
        by_id = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        bucket = F.when(F.col("doc_id").isNull(), WITHOUT_ID).otherwise(by_id)
        dealt = rows.withColumn("bucket", bucket).hint("rebalance", F.col("bucket"))
        ordered = dealt.sortWithinPartitions("bucket", "doc_id")
        # All that a failed attempt left goes, whatever the session says.
        writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("bucket").parquet(path)

    def documents(self) -> DataFrame:
        """What each document counts now: ``(doc_id, source, lang, tokenizer,
        documents, tokens)``. Documents without an id are counted together."""
        return self._sums(self._history())

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("doc_id", *GROUP).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
        )
        return sums.where("documents <> 0 OR tokens <> 0")

    def _counted(self, touched: DataFrame) -> DataFrame:
        """What the documents ``touched`` (``doc_id``, ``_t``: tokenizer) count now,
        from the buckets and the range of ids that hold them."""
        by_id = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        # One row per bucket, at most.
        spans = (
            touched.groupBy(by_id.alias("bucket"))
            .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
            .collect()
        )
        history = self._history()
        if not spans:
            return self._sums(history.where("false"))
        near = (
            F.col("bucket").isin([r["bucket"] for r in spans])
            & (F.col("doc_id") >= F.lit(min(r["low"] for r in spans)))
            & (F.col("doc_id") <= F.lit(max(r["high"] for r in spans)))
        )
        rows = history.where(near)
        same = (rows["doc_id"] == touched["doc_id"]) & rows["tokenizer"].eqNullSafe(touched["_t"])
        return self._sums(rows.join(touched, same, "left_semi"))

    def write_state(self) -> str | None:
        """Sums up all batches; ``None`` if the newest state covers them already.

        A state counts once the list of its batches is complete, which is written
        last; a failed one is written anew. Nothing else is removed."""
        batches, states = self.batches(), self._states()
        name = f"{len(batches):010d}"
        if not batches or name in states:
            return None
        at = f"{self.path}/states/{name}"
        self._write_buckets(self.documents(), f"{at}/documents")
        covers = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        covers.coalesce(1).write.mode("overwrite").parquet(f"{at}/covers")
        return name

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_documents, n_tokens)`` over all batches."""
        paths = [f"{self.path}/rollups/{b}" for b in self.batches()]
        rows = self._read(paths, self.rollup_schema)
        sums = rows.groupBy(*GROUP).agg(
            F.sum("documents").alias("n_documents"), F.sum("tokens").alias("n_tokens")
        )
        return sums.where("n_documents <> 0 OR n_tokens <> 0")

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Adds a batch; ``False`` if one of that name is in the ledger already.

        ``events``: ``event`` (``insert``, ``revise`` or ``delete``), ``doc_id``,
        ``source``, ``lang``, ``tokenizer``, ``tokens`` and, where the order of
        events on one document matters, ``sequence``. Of several events for a
        document and tokenizer the last counts, of equal ones any. An insert or
        revision puts its count in place of what was there, under its own source and
        language; a delete takes that away, and does nothing where nothing is. Rows
        without an id cannot be found again: they only add, and their deletes do
        nothing, unless ``documents`` says how many documents a row stands for. Then
        that number and ``tokens``, both signed, are added to its group, whatever the
        event and as often as the row is there. With an id ``documents`` is not looked
        at. A null count is zero; other events are an error.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"not a name for a batch: {batch}")
        if self.is_committed(batch):
            return False
        if "sequence" not in events.columns:
            events = events.withColumn("sequence", F.lit(0))
        if "documents" not in events.columns:
            events = events.withColumn("documents", F.lit(None))
        named = F.col("event").isin("insert", "revise", "delete")
        checked = F.when(F.coalesce(named, F.lit(False)), F.col("event")).otherwise(
            F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce("event", F.lit("null"))))
        )
        rows = events.select(
            F.col("doc_id").cast(self.id_type).alias("doc_id"),
            *[F.col(c).cast("string").alias(c) for c in GROUP],
            F.coalesce(F.col("tokens").cast("bigint"), F.lit(0).cast("bigint")).alias("tokens"),
            checked.alias("event"),
            "sequence",
            F.col("documents").cast("bigint").alias("documents"),
        )
        # Counting tokens is dear: the events are evaluated once, here.
        staged = f"{self.path}/events/{batch}"
        rows.write.mode("overwrite").parquet(staged)
        rows = self.spark.read.schema(rows.schema).parquet(staged)
        with_id, without = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
        latest = Window.partitionBy("doc_id", "tokenizer").orderBy(
            F.col("sequence").desc(), "event", "source", "lang", "tokens"
        )
        last = with_id.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
        one = F.lit(1).cast("bigint")
        added = last.where("event <> 'delete'").withColumn("documents", one)
        # One bucket holds all of these, so they are summed up first.
        signed = self._sums(
            without.where("event <> 'delete' OR documents IS NOT NULL").withColumn(
                "documents", F.coalesce("documents", one)
            )
        )
        columns = ["doc_id", *GROUP, "documents", "tokens"]
        deltas = added.select(columns).unionByName(signed.select(columns))
        if self.batches():
            # The old count goes, wherever the document was counted under this tokenizer.
            touched = with_id.select("doc_id", F.col("tokenizer").alias("_t"))
            gone = self._counted(touched).select(
                "doc_id",
                *GROUP,
                (-F.col("documents")).alias("documents"),
                (-F.col("tokens")).alias("tokens"),
            )
            deltas = deltas.unionByName(gone)
        at = f"{self.path}/deltas/{batch}"
        self._write_buckets(deltas, at)
        written = self.spark.read.schema(self.delta_schema).parquet(at)
        sums = written.groupBy(*GROUP).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
        )
        sums.write.mode("overwrite").parquet(f"{self.path}/rollups/{batch}")
        covered = int(self._states()[-1]) if self._states() else 0
        if len(self.batches()) - covered >= self.state_every:
            self.write_state()
        return True


def copies_to_delete(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Delete events for every document whose text another one with a smaller id has."""
    marked = docs.select(
        "doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("digest")
    )
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # A table of its own: with the grouping in the join's stage, Spark could not deal
    # the copies of one text out to several tasks.
    first = write_through(first.where("n > 1"), "first-copies")
    copies = marked.join(first, "digest").where("doc_id <> first")
    return copies.select(
        F.lit("delete").alias("event"),
        "doc_id",
        "source",
        "lang",
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(0).alias("tokens"),
    )


def version_change(ledger: TokenLedger, old: str, new: str, more_tokens: int) -> DataFrame:
    """Events that move every document to a version that counts some tokens more: a
    revision by that number, no text is read. Documents without an id, which the
    ledger holds together, are taken from the old version and added to the new one
    with their number."""
    now = ledger.documents().where(F.col("tokenizer") == old)
    no_id = F.col("doc_id").isNull()
    gone = now.withColumns(
        {
            "event": F.lit("delete"),
            "tokens": F.when(no_id, -F.col("tokens")).otherwise(F.col("tokens")),
            "documents": F.when(no_id, -F.col("documents")),
        }
    )
    counted = now.withColumns(
        {
            "event": F.lit("revise"),
            "tokenizer": F.lit(new),
            "tokens": F.col("tokens") + more_tokens * F.col("documents"),
            "documents": F.when(no_id, F.col("documents")),
        }
    )
    return gone.unionByName(counted)
