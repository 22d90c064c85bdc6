"""A caller's receipts as an append-only log of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobstrata import schemas


def append_receipts(receipts: DataFrame, path: str) -> None:
    receipts.write.mode("append").json(path)


def load_receipts(spark: SparkSession, path: str) -> DataFrame:
    """All receipts; blank lines are skipped."""
    return spark.read.schema(schemas.RECEIPTS).json(path).filter(F.col("receipt_id").isNotNull())
