"""Repository trees as a file table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.functions.skills import file_suffix


def files_of(paths: DataFrame, root: str) -> DataFrame:
    """(fingerprint, repo, path, name, suffix, text) from a ``path`` column below ``root``.

    Build and vendor directories are left out. The first directory below the root is the
    repository; files directly in the root belong to none.
    """
    prefix = root.rstrip("/") + "/"
    inner = F.substr("path", F.locate(prefix, "path") + len(prefix))
    parts = F.split(inner, "/")
    skipped = F.array(*[F.lit(d) for d in C.SKIPPED_DIRECTORIES])
    name = F.element_at(parts, -1)
    return paths.filter(~F.arrays_overlap(parts, skipped)).select(
        "fingerprint",
        F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).alias("repo"),
        inner.alias("path"),
        name.alias("name"),
        file_suffix(name).alias("suffix"),
        "text",
    )


def _any_case(name: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


def scan_repos(spark: SparkSession, root: str, fingerprint: str) -> DataFrame:
    """A directory tree listed in parallel; only manifests are opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    manifests = ",".join(_any_case(name) for name in C.MANIFEST_NAMES)
    texts = reader.option("pathGlobFilter", f"{{{manifests}}}").load(root).select(
        "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    )
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = listed.select(F.lit(fingerprint).alias("fingerprint"), "path").join(texts, "path", "left")
    return files_of(found, root)
