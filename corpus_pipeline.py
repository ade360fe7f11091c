"""The corpus pipeline: language ID, toxicity, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last keep the columns of
documents.  A row whose columns are null or repeated goes through like any other; the
operators' docstrings state each case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import language_id, minhash_dedup, packing, pii, toxicity
from spanforge.llm.common import DOCUMENT_COLUMNS, Scratch, table
from spanforge.llm.queries import SURROGATE_KEY, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a known language go: null, empty and letterless ones."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return language_id.keep_identified(docs, language_id.learn_languages(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score 0.7 or more go."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more."""
    return minhash_dedup.keep_one(docs.select(*DOCUMENT_COLUMNS), size=5, percent=80)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to surrogates; n_chars follows."""
    rest = [c for c in DOCUMENT_COLUMNS if c not in ("doc_id", "text")]
    new = pii.replace_entities(docs.select(*DOCUMENT_COLUMNS), SURROGATE_KEY, *rest)
    return new.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Classifiers and tokenizers aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
