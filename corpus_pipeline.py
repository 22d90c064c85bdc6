"""The corpus pipeline over the documents table: quality, near duplicates, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and hands
the reread table to the next stage. All but the last return the columns of documents. Null texts count as empty: the
classifier scores them like empty ones. Repeated rows stay separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata.llm.common import written
from jobstrata.llm.queries import as_documents, as_postings, labels, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rule ensemble rejects."""
    from jobstrata.llm.quality_classifier import keep_good

    return as_documents(keep_good(as_postings(docs), labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    from jobstrata.llm.near_duplicates import keep_first

    return as_documents(keep_first(as_postings(docs)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark window."""
    from jobstrata.llm.decontaminate import remove_contaminated

    return as_documents(remove_contaminated(as_postings(docs), table(spark, sf_dir, "benchmark")))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes: a row per document and pass over it, with n_chars of what is taken."""
    from jobstrata.llm.mixing import mixed_texts

    mixed = as_documents(mixed_texts(as_postings(docs)))
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the files."""
    from jobstrata.llm.queries import tokenised

    return tokenised(as_postings(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_files),
]

#: The classifier is trained, so SQL can't express the result; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
