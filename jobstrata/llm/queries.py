"""The registered queries of the corpus operators: the given tables as postings, and results back.

A document is a posting: doc_id is its id, text its description_raw, lang its language, source its source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata.llm.common import shared_folder
from jobstrata.session import ensure_utc

NAMES = {"doc_id": "id", "text": "description_raw", "lang": "language", "source": "source"}
_OTHER = "other: "  # columns that no operator reads keep their names apart from those of postings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def as_postings(documents: DataFrame) -> DataFrame:
    return documents.select(*[F.col(f"`{c}`").alias(NAMES.get(c, _OTHER + c)) for c in documents.columns])


def as_documents(jobs: DataFrame) -> DataFrame:
    back = {v: k for k, v in NAMES.items()}
    return jobs.select(*[F.col(f"`{c}`").alias(back.get(c, c.removeprefix(_OTHER))) for c in jobs.columns])


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_postings(table(spark, sf_dir, "documents"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.quality_rules import judge_quality

    return judge_quality(postings(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def op2_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.repeated_spans import remove_repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(postings(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.decontaminate import contamination

    found = contamination(postings(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.url_filter import Rule, judge_urls

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("careers_url"), F.col("html").alias("description_raw"))
    return judge_urls(pages, [Rule(*r) for r in URL_RULES]).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.personal_data import KINDS, find_personal_data

    found = find_personal_data(postings(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), *[_count(k) for k in KINDS], F.sha2(_joined("rule_spans"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("rule_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def tokenised(jobs: DataFrame) -> DataFrame:
    from jobstrata.llm.token_files import read_token_files, write_token_files

    folder = shared_folder(jobs.sparkSession, "token-files")
    write_token_files(jobs, folder)
    return read_token_files(jobs.sparkSession, folder).withColumnRenamed("id", "doc_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(postings(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.near_duplicates import near_duplicates

    return near_duplicates(postings(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.quality_classifier import score_quality

    return score_quality(postings(spark, sf_dir), labels(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.language_id import identify

    return identify(postings(spark, sf_dir)).withColumnsRenamed({"id": "doc_id", "language_pred": "lang_pred"})


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.mixing import mixed_sizes

    return mixed_sizes(postings(spark, sf_dir)).withColumnRenamed("id", "doc_id").withColumn("target", F.round("target", 6))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.fingerprints import simhash_groups

    return simhash_groups(postings(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.filter_audit import audit_filters

    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return audit_filters(postings(spark, sf_dir), marks).withColumnRenamed("source", "part")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobstrata.llm.token_alignment import align_tokenizers

    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return align_tokenizers(postings(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_repeated_spans, op3_decontamination, op4_url_filter, op5_personal_data, op6_token_files, op7_near_duplicates,
        op8_quality_classifier, op9_language_id, op10_mixing, op11_simhash, op12_filter_audit, op13_token_alignment,
    )
}
