"""From documents to packed training sequences, in five stages.

Every stage takes all that its predecessor kept, as a written table, and all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clubledger.llm import language_crf
from clubledger.llm.common import importable_by_workers
from clubledger.llm.mixing import mixed_documents
from clubledger.llm.packing import Limits, pack_documents
from clubledger.llm.quality_rules import apply_policy, rule_ledger
from clubledger.llm.simhash_bk import one_per_group
from clubledger.session import write_through

#: The likeliest language of each word has to have at least this mean probability;
#: the words of a document may be of several languages.
LEAST_LANGUAGE_SCORE = 0.4
POLICY = "prose-1"
SHINGLE, RADIUS = 4, 4
TOKENIZER, END_ID = "byte_bpe_50k.json", 0

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones have. Where no
    document has a label, those with a letter."""
    importable_by_workers(spark)
    model = language_crf.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    labelled = language_crf.predict_language(docs.select(*_COLUMNS), model, certainty=True)
    sure = (F.col("lang_pred") != language_crf.UNDETERMINED) & (
        F.col("certainty") >= LEAST_LANGUAGE_SCORE
    )
    return labelled.where(sure).select(*_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the policy."""
    ledger = apply_policy(rule_ledger(docs.select(*_COLUMNS)), POLICY)
    return ledger.where("kept").select(*_COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    importable_by_workers(spark)
    return one_per_group(docs.select(*_COLUMNS), shingle=SHINGLE, radius=RADIUS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixed_documents(docs.select(*_COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    importable_by_workers(spark)
    return pack_documents(docs, TOKENIZER, END_ID, limits=Limits(1024, 128, 1024))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The language model and the fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every result is written and read again."""
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = write_through(stage(spark, kept, sf_dir), name)
    return STAGES[-1][1](spark, kept, sf_dir)
