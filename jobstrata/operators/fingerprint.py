"""Language shares and skill tags of callers' repositories. Only tags leave this module."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.functions.skills import canonical_skill, file_language, manifest_skills


def language_share(files: DataFrame) -> DataFrame:
    """Files per (fingerprint, language) and their share of all recognised files, in percent.

    Counts are combined per language first, so the window only sees a handful of rows per caller.
    """
    counts = (
        files.withColumn("language", file_language(F.col("name")))
        .filter("language IS NOT NULL")
        .groupBy("fingerprint", "language")
        .agg(F.count(F.lit(1)).alias("files"))
    )
    total = F.sum("files").over(Window.partitionBy("fingerprint"))
    return counts.withColumn("pct", F.round(F.col("files") / total * 100, 1))


def fingerprint_tags(files: DataFrame) -> DataFrame:
    """(fingerprint, skill): prominent languages and what the manifests stand for, canonical."""
    languages = language_share(files).filter(F.col("pct") >= C.LANGUAGE_SKILL_MIN_PCT).select(
        "fingerprint", F.col("language").alias("skill")
    )
    manifests = files.select("fingerprint", F.explode(manifest_skills(F.col("name"), F.col("text"))).alias("skill"))
    tags = languages.unionByName(manifests).select(
        "fingerprint", canonical_skill(F.col("skill")).alias("skill")
    )
    return tags.distinct()


def fingerprints(files: DataFrame) -> DataFrame:
    """One row per caller: tags, language shares, repositories scanned.

    The lists are bounded by the vocabulary and the language table, whatever a caller holds.
    """
    shares = language_share(files).groupBy("fingerprint").agg(
        F.map_from_entries(F.collect_list(F.struct("language", "pct"))).alias("language_pct")
    )
    skills = fingerprint_tags(files).groupBy("fingerprint").agg(
        F.array_sort(F.collect_set("skill")).alias("skills")
    )
    repos = (
        files.groupBy("fingerprint", "repo")
        .agg(F.count(F.lit(1)).alias("_files"))
        .groupBy("fingerprint")
        .agg(F.greatest(F.count("repo"), F.lit(1)).alias("repos_scanned"))
    )
    return (
        repos.join(shares, "fingerprint", "left")
        .join(skills, "fingerprint", "left")
        .select(
            F.col("fingerprint").alias("id"),
            F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
            F.coalesce("language_pct", F.create_map().cast("map<string,double>")).alias("language_pct"),
            "repos_scanned",
        )
    )
