"""A training-data pipeline of five stages over `documents`.

Quality rules, near-dedup on shingle sets, benchmark decontamination, removal of personal data
and packing, each by its operator in mnemospark.llm.  All but the last return the
columns of documents; the last returns the pieces of the packed sequences.  Each stage
works on all rows that the one before it has kept, read back from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm import near_sets, op1_decontaminate, op5_quality, op6_packing, op8_pii, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return op5_quality.filter_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (shingles of five words, Jaccard 0.8), the one of least doc_id."""
    return near_sets.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    return op1_decontaminate.decontaminate(docs, shared.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return op8_pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    import public_tokenizers

    # Executors are near their limit after the stages before, so workers keep a quarter of op6's words.
    return op6_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, cache=op6_packing.CACHE // 4)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fingerprints and alignments are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
