"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language_id, license_scan, minhash_dedup, packing, permutation_index, pii, quality_rules, sentencepiece_fst, token_counts, toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the library has it at the same place on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(license_scan.license_scan(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents")))


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.kept_by_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encoding_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.section_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, table(spark, sf_dir, "documents"))


#: Stands in for a secret that a real run would take from its own store.
SURROGATE_KEY = "spanforge"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_permutation_index": op4_permutation_index,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_language_id": op9_language_id,
    "op10_pii": op10_pii,
    "quality_ablation": quality_ablation,
    "quality_policies": quality_policies,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op3_quality_rules": quality_rules.oracle_sql(),
    "op8_minhash_dedup": minhash_dedup.oracle_sql(2),
    "quality_ablation": quality_rules.ablation_sql(),
    "quality_policies": quality_rules.kept_by_policy_sql(),
}
