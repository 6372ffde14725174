"""One registered query per operator, and its SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clubledger.llm import compression, language_crf
from clubledger.llm.common import importable_by_workers, word_list
from clubledger.llm.mixing import mixing_decisions
from clubledger.llm.packing import Limits, pack_documents
from clubledger.llm.periodic_runs import RUN, periodic_runs
from clubledger.llm.quality_rules import MEASURES, apply_policy, fails, rule_ledger
from clubledger.llm.simhash_bk import simhash_groups
from clubledger.llm.token_counts import (
    TokenLedger,
    copies_to_delete,
    count_tokens,
    version_change,
)
from clubledger.llm.token_files import read_token_files, write_token_files
from clubledger.llm.topk_pivots import top_k
from clubledger.llm.vector_codes import encode_vectors
from clubledger.llm.warc import read_archives, write_archives
from clubledger.session import new_table_path

TOXICITY = compression.Settings(window_words=24, fold_case=True, contrast=True)
QUALITY = compression.Settings(window_words=16)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable_by_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, fold: int, folds: int) -> Column:
    """Whether an id belongs to the fold that nothing is learned from; an unknown id
    does not, and nothing is learned from it either."""
    fold_of = F.crc32(F.col(doc_id).cast("string")) % folds
    return F.coalesce(fold_of == fold, F.lit(False))


# -- 1 exact top-k search -----------------------------------------------------------
@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors closest to every twentieth one."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


SQL["op1_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
    FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
       AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""


# -- 2 token counts -----------------------------------------------------------------
@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by source, language and version after three batches: all documents come
    in, exact copies go, the rest is revised by one token, an end token. The last two are
    committed twice, as after a failure."""
    docs = table(spark, sf_dir, "documents")
    ledger = TokenLedger(spark, new_table_path(spark, "token-ledger"))
    version, ended = "byte_bpe_50k", "byte_bpe_50k+end"
    counted = count_tokens(docs, "byte_bpe_50k.json", version)
    ledger.commit("1-load", counted.withColumn("event", F.lit("insert")))
    for _ in range(2):
        ledger.commit("2-copies", copies_to_delete(docs, version))
    for _ in range(2):
        ledger.commit("3-end-token", version_change(ledger, version, ended, 1))
    return ledger.totals()


# -- 3 quality rules ------------------------------------------------------------
@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of policy ``prose-1``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = apply_policy(rule_ledger(docs), "prose-1")
    return ledger.select(
        "doc_id", *MEASURES, "failures", fails("base-1").alias("base_failed"), "kept"
    )


SQL["op3_quality_rules"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), windows AS (
    SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) >= 8)
), twice AS (
    SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), repeated AS (
    SELECT r, sum(least(8, coalesce(i - before, 8))) AS n FROM twice GROUP BY r
), lines AS (
    SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS n_dup
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), measured AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(lines.n, 0) AS n_lines, coalesce(lines.n_dup, 0) AS n_dup_lines,
           CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
    FROM docs LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)
), bits AS (
    SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END) AS BIGINT) AS failures
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failures,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failures = 0 AS kept
FROM bits
"""


# -- 4 packing ----------------------------------------------------------------------
@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, "byte_bpe_50k.json", end_id=0, limits=Limits(1024, 128, 1024))


# -- 5 SimHash near-dedup ---------------------------------------------------------
@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4 words, at most 4 bits."""
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)


# -- 6 toxicity ---------------------------------------------------------------------
@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from two of three folds."""
    docs, fold = table(spark, sf_dir, "documents"), held_out("doc_id", 1, 3)
    labels = table(spark, sf_dir, "labels").where(~fold)
    model = compression.train(docs, labels, "toxic", TOXICITY)
    rows = docs.select("doc_id", fold.alias("held_out"), "text")
    return compression.score_texts(rows, model, threshold=0.7, keep_text=False)


# -- 7 token files ------------------------------------------------------------------
@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = new_table_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", end_id=1)
    return read_token_files(spark, path)


# -- 8 mixing sources to target weights ---------------------------------------------
@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, as words."""
    decided = mixing_decisions(table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "size", "source_size", "target", "taken", "copies")


# -- 9 language ID ------------------------------------------------------------------
@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a CRF learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    model = language_crf.train(docs.where(~held_out("doc_id", 2, 4)))
    rows = docs.select("doc_id", held_out("doc_id", 2, 4).alias("held_out"), "text")
    return language_crf.predict_language(rows, model, keep_text=False)


# -- 10 quality classifier ------------------------------------------------------------
@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from three of four folds."""
    docs, fold = table(spark, sf_dir, "documents"), held_out("doc_id", 2, 4)
    labels = table(spark, sf_dir, "labels").where(~fold)
    model = compression.train(docs, labels, "quality", QUALITY)
    rows = docs.select("doc_id", fold.alias("held_out"), "text")
    return compression.score_texts(rows, model, threshold=0.7, keep_text=False)


# -- 11 vector code compression ---------------------------------------------------------
@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors: 16 parts, 64 entries each, two rounds."""
    coded, codebook = encode_vectors(table(spark, sf_dir, "embeddings"))
    numbers = ",".join(map(str, codebook.ravel().tolist()))
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    return coded.select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


_ASSIGN = """SELECT r, j, min(CAST(pp - 2 * list_inner_product(p, c) + cc AS HUGEINT) * 64 + e) AS best
    FROM parts JOIN {book} USING (j) GROUP BY r, j"""
_MEANS = """SELECT j, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY k) AS c
    FROM (SELECT j, e, k, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n
          FROM (SELECT j, CAST(best % 64 AS INTEGER) AS e, unnest(range(1, len(p) + 1)) AS k,
                       CAST(unnest(p) AS BIGINT) AS x
                FROM {assigned} JOIN parts USING (r, j)) GROUP BY j, e, k)
    GROUP BY j, e"""
_BOOK = """SELECT j, e, c, list_inner_product(c, c) AS cc
    FROM (SELECT o.j, o.e, coalesce(n.c, o.c) AS c FROM {old} AS o LEFT JOIN ({means}) AS n USING (j, e))"""
SQL["op11_vector_codes"] = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT *, list_inner_product(p, p) AS pp
    FROM (SELECT r, j, v[j * len(v) // 16 + 1:(j + 1) * len(v) // 16] AS p
          FROM (SELECT r, v, unnest(range(16)) AS j FROM kept))
), book0 AS MATERIALIZED (
    SELECT j, CAST(r - 1 AS INTEGER) AS e, p AS c, pp AS cc FROM parts WHERE r <= 64
), a0 AS MATERIALIZED ({_ASSIGN.format(book="book0")}
), book1 AS MATERIALIZED ({_BOOK.format(old="book0", means=_MEANS.format(assigned="a0"))}
), a1 AS MATERIALIZED ({_ASSIGN.format(book="book1")}
), book2 AS MATERIALIZED ({_BOOK.format(old="book1", means=_MEANS.format(assigned="a1"))}
), a2 AS MATERIALIZED ({_ASSIGN.format(book="book2")}
), coded AS (
    SELECT r, string_agg(printf('%02x', CAST(best % 64 AS INTEGER)), '' ORDER BY j) AS code,
           CAST(sum(best // 64) AS BIGINT) AS error
    FROM a2 GROUP BY r
), digest AS (
    SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY j, e, k)) AS h
    FROM (SELECT j, e, unnest(range(1, len(c) + 1)) AS k, unnest(c) AS x FROM book2)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT h FROM digest) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


# -- 12 periodic run detection --------------------------------------------------------
def with_planted_run(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by a hash of its id, repeats one of its passages
    to the end; where, and how long the passage is, follow from the hash."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # Columns of their own, so that they are not computed again for every word.
    marked = docs.select(
        "doc_id",
        "text",
        F.floor(h / 10).alias("g"),
        F.when(h % 10 == 0, word_list(F.col("text"))).alias("words"),
    ).withColumn("n", F.size("words"))
    marked = marked.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    marked = marked.withColumn("p", period)
    places = F.sequence(F.lit(0), F.col("n") - 1)
    place = F.transform(
        places, lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    )
    repeated = F.array_join(F.transform(place, lambda i: F.get("words", i.cast("int"))), " ")
    text = F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text"))
    return marked.select("doc_id", text.alias("text"))


def run_columns(found: DataFrame) -> DataFrame:
    """The run with the greatest exponent, and digests of all runs and kept words."""
    line = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )

    def greater(best: Column, r: Column) -> Column:
        more = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | more, r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast(RUN), greater)
    return found.withColumn("best", best).select(
        "doc_id",
        "n_words",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with a run planted in every tenth."""
    return run_columns(periodic_runs(with_planted_run(table(spark, sf_dir, "documents"))))


# -- 13 WARC --------------------------------------------------------------------------
@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    path = new_table_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL["op13_warc"] = """
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest, url
    FROM pages
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url) AS k,
           min(page_id) OVER (PARTITION BY payload_digest) AS first
    FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND k > 1 THEN first END AS refers_to
FROM ranked
"""


# -- the pipeline ---------------------------------------------------------------------
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
