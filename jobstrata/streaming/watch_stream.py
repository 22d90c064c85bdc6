"""Continuous matching of standing queries against newly seen postings.

The stream hands every posting over once, whenever it lands. Its first batch is a check like any other, from the cursors
on. From then on a watch that was checked before meets each batch whole: a posting that lands late is as new to it as any
other, so its first sighting is not compared with the cursor. A watch that was never checked meets all postings so far.

:func:`start_matching` takes postings from files that others write; :func:`start_matching_changes` follows the commits of
continuous ingest, reads the changes of each step alone, and the index only for watches that were never checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobstrata import schemas
from jobstrata.operators.predicates import active_watch
from jobstrata.operators.watches import advance_cursor, top_matches
from jobstrata.sources.state import StateStore
from jobstrata.streaming.batches import batch_tag
from jobstrata.streaming.change_stream import start_changes


def match_batch(store: StateStore, postings: DataFrame, out: str, tag: str, now) -> None:
    """Top matches of one batch of postings, written below ``out``, then the cursor moves.

    The batch's directories are replaced when the batch is replayed; a committed batch is skipped.
    """
    if store.has_tag(tag):
        return
    handed_over = f"{store.root}/handed_over"
    postings.write.mode("overwrite").parquet(f"{handed_over}/batch={tag}")
    everything = store.spark.read.schema(schemas.JOBS).parquet(handed_over).select(schemas.JOBS.fieldNames())
    this = store.spark.read.schema(schemas.JOBS).parquet(f"{handed_over}/batch={tag}")
    watches = store.read("watches", schemas.WATCHES)
    never = F.col("last_notified_at").isNull()
    # The postings so far are the baseline; a posting that changed since is matched as it is now.
    latest = everything.groupBy("id").agg(F.max("verified_at").alias("verified_at"))
    baseline = everything.join(latest, ["id", "verified_at"], "left_semi").dropDuplicates(["id"]).select(schemas.JOBS.fieldNames())
    first = top_matches(watches.filter(never), baseline, now)
    since = watches.select("watch_id", F.col("last_notified_at").alias("_since"))
    checked = watches.filter(~never)
    if store.exists("matched_batches"):
        checked = checked.withColumn("last_notified_at", F.lit(None).cast("timestamp"))
    later = top_matches(checked, this, now)
    later = later.join(since.hint("merge"), "watch_id").withColumn("since", F.col("_since")).select(first.columns)
    first.unionByName(later).write.mode("overwrite").parquet(f"{out}/batch={tag}")
    store.write({"watches": advance_cursor(watches, now), "matched_batches": store.spark.range(1)}, tag)


def start_matching(
    store: StateStore, postings_path: str, out: str, checkpoint: str, clock, trigger: dict | None = None, files_per_batch: int = 1000
) -> StreamingQuery:
    """Matches every batch of new posting files (parquet, ``schemas.JOBS``).

    ``clock`` gives the time of a batch from its number; nothing else reads a clock.
    """
    postings = store.spark.readStream.schema(schemas.JOBS).option("maxFilesPerTrigger", files_per_batch).parquet(postings_path)
    return (
        postings.writeStream.queryName("watch_matching")
        .foreachBatch(
            lambda batch, number: match_batch(store, batch, out, batch_tag(batch, "watch", number), clock(number))
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 minutes"}))
        .start()
    )


def first_sightings(changes: DataFrame) -> DataFrame:
    """The live postings that a step saw for the first time (``schemas.JOBS``). One that continues a delisted sibling, or is back
    itself, keeps its first sighting and is none of them; a posting that was new and then changed counts as it is last."""
    alive = changes.filter("after.delisted_at IS NULL")
    new = changes.filter((F.col("change") == "new") & (F.col("after.first_seen_at") == F.col("at"))).select("id")
    last = changes.groupBy("id").agg(F.max("at").alias("at"))
    return alive.join(last, ["id", "at"], "left_semi").join(new, "id", "left_semi").select("after.*")


def match_changes(index: StateStore, store: StateStore, changes: DataFrame, version: int, out: str, tag: str, now) -> None:
    """Top matches of what a batch of ingest steps brought, written below ``out``, then the cursor moves.

    A watch that was checked before meets the first sightings of these steps, and nothing older is read for it. Only if
    some active watch was never checked, it meets the index as of ``version``, the version that holds the batch's changes. The watches
    are kept in ``store``, a store of their own. Directories are replaced when a batch is replayed; a committed one is skipped.
    """
    if store.has_tag(tag):
        return
    watches = store.read("watches", schemas.WATCHES)
    never = active_watch() & F.col("last_notified_at").isNull()
    checked = watches.filter(F.col("last_notified_at").isNotNull())
    if store.exists("matched_steps"):  # the first batch is a check like any other, from the cursors on
        checked = checked.withColumn("last_notified_at", F.lit(None).cast("timestamp"))
    new = store.staged(first_sightings(changes))
    since = watches.select("watch_id", F.col("last_notified_at").alias("_since"))
    found = top_matches(checked, new, now)
    columns = found.columns
    found = found.drop("since").join(since.hint("merge"), "watch_id").withColumnRenamed("_since", "since").select(columns)
    if watches.filter(never).take(1):
        found = found.unionByName(top_matches(watches.filter(never), index.read("jobs", schemas.JOBS, version), now).select(columns))
    found.write.mode("overwrite").parquet(f"{out}/batch={tag}")
    store.write({"watches": advance_cursor(watches, now), "matched_steps": store.spark.range(1)}, tag)


def start_matching_changes(
    index: StateStore, store: StateStore, out: str, checkpoint: str, clock, trigger: dict | None = None, commits_per_batch: int = 100
) -> StreamingQuery:
    """Matches what continuous ingest commits to ``index``, as it commits it.

    ``clock`` gives the time of a batch from the version of the index it is about; nothing else reads a clock.
    """

    def handle(changes: DataFrame, tag: str, version: int) -> None:
        match_changes(index, store, changes, version, out, tag, clock(version))

    return start_changes(index, handle, checkpoint, trigger or {"processingTime": "30 minutes"}, commits_per_batch)
