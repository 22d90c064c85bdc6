"""Batch validation of application authorisations. No résumé or personal data is ever accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata import constants as C
from jobstrata.operators.guards import is_anonymous, leaked_argument_keys
from jobstrata.session import as_timestamp


def judge(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests with ``error`` (null when accepted) and the posting's apply channel.

    ``requests``: request_id, job_id, fingerprint, authorized, extra map<string,string>. The first
    failing check names the error: personal keys, fingerprint, job id, consent, existence.
    """
    known = jobs.select(F.col("id").alias("job_id"), "apply_channel", F.lit(True).alias("_known"))
    leaked = leaked_argument_keys(F.map_keys("extra"))
    return (
        requests.join(known, "job_id", "left")
        .withColumn(
            "error",
            F.when(F.size(leaked) > 0, F.lit(C.ERR_RESUME))
            .when(~is_anonymous(F.col("fingerprint")), F.lit(C.ERR_RESUME))
            .when(~is_anonymous(F.col("job_id")), F.lit(C.ERR_RESUME))
            .when(~F.coalesce("authorized", F.lit(False)), F.lit(C.ERR_UNAUTHORIZED))
            .when(F.col("_known").isNull(), F.lit(C.ERR_NO_JOB)),
        )
        .drop("_known")
    )


def receipt_id(*parts: str):
    """A deterministic id, so a replayed batch issues the same receipts."""
    return F.concat(F.lit("r_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def accepted(judged: DataFrame, now) -> DataFrame:
    """Application rows of the accepted requests, with the link the caller opens."""
    return judged.filter("error IS NULL").select(
        receipt_id("request_id", "job_id", "fingerprint").alias("receipt_id"),
        "job_id",
        "fingerprint",
        F.lit(True).alias("authorized"),
        F.lit(C.DELIVERED_VIA).alias("delivered_via"),
        as_timestamp(now).alias("created_at"),
        F.lit(False).alias("resume_transmitted"),
        "apply_channel",
    )


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter("error IS NOT NULL").select("request_id", "job_id", "error")
