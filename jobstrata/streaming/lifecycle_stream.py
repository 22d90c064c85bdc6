"""Posting lifecycles kept up to date from a stream of crawl observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobstrata.operators.lifecycle import lifecycle_spans
from jobstrata.sources.state import StateStore
from jobstrata.streaming.batches import batch_tag

LOG = T.StructType(
    [
        T.StructField("company_id", T.StringType()),
        T.StructField("posting_id", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("observed", T.BooleanType()),
    ]
)
SPANS = T.StructType(
    [
        T.StructField("company_id", T.StringType()),
        T.StructField("posting_id", T.StringType()),
        T.StructField("live_from", T.DateType()),
        T.StructField("last_seen", T.DateType()),
        T.StructField("delisted_on", T.DateType()),
        T.StructField("crawls_seen", T.LongType()),
        T.StructField("opened_as", T.StringType()),
    ]
)
DAYS = T.StructType([T.StructField("company_id", T.StringType()), T.StructField("last_day", T.DateType())])
_KEY = ["company_id", "posting_id"]


def extend_spans(spans: DataFrame, log: DataFrame) -> DataFrame:
    """Spans after further crawls. ``log`` holds complete days later than any day seen before.

    A span still open at a company's first new crawl either goes on, when that crawl sees the
    posting, or ends there. Keyed by posting, so no state of a whole company is ever held.
    """
    fresh = lifecycle_spans(log)
    first = log.groupBy("company_id").agg(F.min("day").alias("_first"))
    starts = fresh.join(first, "company_id").withColumn("_at_start", F.col("live_from") == F.col("_first"))
    goes_on = starts.filter("_at_start").select(
        *_KEY, F.col("last_seen").alias("_seen"), F.col("delisted_on").alias("_gone"), F.col("crawls_seen").alias("_more")
    )
    is_open = F.col("delisted_on").isNull()
    touched = is_open & F.col("_first").isNotNull()
    continued = touched & F.col("_seen").isNotNull()
    old = (
        spans.join(first, "company_id", "left")
        .join(goes_on, _KEY, "left")
        .select(
            *_KEY,
            "live_from",
            F.when(continued, F.col("_seen")).otherwise(F.col("last_seen")).alias("last_seen"),
            F.when(continued, F.col("_gone")).when(touched, F.col("_first")).otherwise(F.col("delisted_on")).alias("delisted_on"),
            (F.col("crawls_seen") + F.when(continued, F.col("_more")).otherwise(0)).alias("crawls_seen"),
            "opened_as",
        )
    )
    known = spans.groupBy(*_KEY).agg(F.count_if(is_open).alias("_open"))
    new = starts.join(known, _KEY, "left").filter(~(F.col("_at_start") & (F.coalesce("_open", F.lit(0)) > 0)))
    opened = F.when(F.col("_open").isNotNull(), F.lit("revived")).otherwise(F.col("opened_as"))
    return old.unionByName(
        new.select(*_KEY, "live_from", "last_seen", "delisted_on", "crawls_seen", opened.alias("opened_as"))
    )


def apply_log(store: StateStore, log: DataFrame, tag: str) -> None:
    """Spans after one batch of the log, whatever its order.

    The log is kept next to the spans. Companies whose days all come after those seen before are extended; for one with
    a day that is late, or the rest of a day that was split, the spans are worked out again from its whole log.
    """
    if store.has_tag(tag):
        return
    kept = f"{store.root}/crawl_log"
    log.select(LOG.fieldNames()).write.mode("overwrite").parquet(f"{kept}/batch={tag}")
    batch = store.spark.read.schema(LOG).parquet(f"{kept}/batch={tag}")
    whole = store.spark.read.schema(LOG).parquet(kept).select(LOG.fieldNames())
    seen = store.read("crawl_days", DAYS)
    days = batch.groupBy("company_id").agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    late = days.join(seen, "company_id").filter(F.col("_first") <= F.col("last_day")).select("company_id")
    old = store.read("spans", SPANS)
    extended = extend_spans(old.join(late, "company_id", "left_anti"), batch.join(late, "company_id", "left_anti"))
    again = lifecycle_spans(whole.join(late, "company_id", "left_semi"))
    spans = extended.select(SPANS.fieldNames()).unionByName(again.select(SPANS.fieldNames()))
    last = seen.unionByName(days.select("company_id", F.col("_last").alias("last_day"))).groupBy("company_id").agg(F.max("last_day").alias("last_day"))
    store.write({"spans": spans.select([F.col(f.name).cast(f.dataType) for f in SPANS.fields]), "crawl_days": last}, tag)


def start_lifecycle(
    store: StateStore, log_path: str, checkpoint: str, trigger: dict | None = None, files_per_batch: int = 1000
) -> StreamingQuery:
    """Brings the spans up to date with every batch of new log files (parquet), late and split days included."""
    log = store.spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(log_path)
    return (
        log.writeStream.queryName("posting_lifecycle")
        .foreachBatch(lambda batch, number: apply_log(store, batch, batch_tag(batch, "lifecycle", number)))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 hour"}))
        .start()
    )
