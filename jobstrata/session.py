"""Session defaults and the few helpers that read session settings."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "jobstrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; a cluster sets its own sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Instants are rendered and truncated to days in UTC everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster. Only a session on one machine may do without the setting; it gets a
    temporary folder. On a cluster every executor would write to a disk of its own, so that is refused."""
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="run-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def shared_root(spark: SparkSession, name: str = "flow") -> str:
    """A new folder on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_timestamp(value: Column | dt.datetime | str) -> Column:
    """A timestamp Column from a Column, an ISO string or a datetime (naive means UTC)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.timezone.utc)
        value = value.astimezone(dt.timezone.utc).isoformat()
    elif not (value.endswith("Z") or "+" in value[10:]):
        value = value + "Z"
    return F.lit(value).cast("timestamp")


#: Rows of whole texts that a Python worker gets at once.
BATCH_ROWS = 1024


def bound_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session hands at most BATCH_ROWS of them to a Python worker at once. The default of
    ten times that is meant for narrow rows: with whole texts it takes most of a worker's memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df
