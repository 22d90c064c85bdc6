"""Match counts of standing queries, kept up to date from the changes of ingest alone.

The inverted table of the watches and their counts are tables of a store. Registering watches adds what the table lacks
and counts the index once, for the new watches only. A batch of changes meets the table with the postings it touched, as they
were and as they are, so a check reads neither the index nor the conditions that no changed posting can meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobstrata import schemas
from jobstrata.operators import watches as W
from jobstrata.sources.state import StateStore

def kept_index(store: StateStore) -> W.WatchIndex:
    return W.WatchIndex(
        store.appended("watch_entries", schemas.WATCH_ENTRIES), store.appended("watch_filters", schemas.WATCH_FILTERS), store.appended("watch_subscriptions", schemas.SUBSCRIPTIONS)
    )


def register_kept(store: StateStore, watches: DataFrame, jobs: DataFrame, tag: str | None = None) -> None:
    """Takes further watches (``schemas.WATCHES``) in: their entries, and their counts over ``jobs``, the index as of the changes
    counted so far. A watch that is there already is left as it is."""
    if tag is not None and store.has_tag(tag):
        return
    known, kept = store.read("watches", schemas.WATCHES), kept_index(store)
    new = store.staged(watches.join(known.select("watch_id").hint("merge"), "watch_id", "left_anti").select(schemas.WATCHES.fieldNames()))
    more = W.new_entries(kept, new, W.skill_frequencies(jobs))
    counts = W.counts_of(W.index_watches(new), new, jobs.withColumn("weight", F.lit(1).cast("bigint")))
    store.write(
        {"watches": known.unionByName(new), "watch_totals": W.added_counts(store.read("watch_totals", schemas.WATCH_TOTALS), counts)}, tag,
        append={"watch_entries": more.entries, "watch_filters": more.filters, "watch_subscriptions": more.subscriptions},
    )


def count_changes(store: StateStore, changes: DataFrame, tag: str) -> None:
    """Brings the counts up to date with a batch of changes (``schemas.CHANGES``); a batch that was counted is skipped."""
    if store.has_tag(tag):
        return
    more = W.counts_of(kept_index(store), store.read("watches", schemas.WATCHES), W.changed_rows(changes))
    store.write({"watch_totals": W.added_counts(store.read("watch_totals", schemas.WATCH_TOTALS), more)}, tag)


def totals(store: StateStore) -> DataFrame:
    """(watch_id, matches, best_match) of every active watch, as of the last batch."""
    return W.totals_of(store.read("watches", schemas.WATCHES), store.read("watch_totals", schemas.WATCH_TOTALS))
