"""Change events: debounce by key, deletions by snapshot, and what an update of an index has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounce(events: DataFrame, key: str, gap: str) -> DataFrame:
    """The last event of every burst: events of a key less than `gap` apart are one burst (W2). Batch and stream alike.

    A stream needs a watermark on ts, after which a burst is final.
    """
    w = F.session_window("ts", gap)
    return events.groupBy(key, w).agg(F.max_by(F.struct("event_id", "kind"), F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"), F.max("ts").alias("ts")).select(key, F.col("last.event_id").alias("event_id"), F.col("last.kind").alias("kind"), "n", "ts")


def debounce_unlink(events: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """Debounce in which an unlink takes effect at once and drops what was pending (W3): event_id and action."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    nxt = events.withColumn("next_ts", F.lead("ts").over(w)).withColumn("next_kind", F.lead("kind").over(w))
    gap = F.col("next_ts").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    fires = F.col("next_ts").isNull() | (gap >= gap_seconds)
    return nxt.filter((F.col("kind") == "unlink") | fires).select(key, "event_id", F.when(F.col("kind") == "unlink", "removed").otherwise("indexed").alias("action"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "file_path", checksum: str = "checksum") -> DataFrame:
    """key, change: added, changed or removed between two snapshots; file sources never tell of deletions."""
    old, new = before.select(key, F.col(checksum).alias("old")), after.select(key, F.col(checksum).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, key, "full").withColumn("change", change).filter("change is not null").select(key, "change")


#: Changes from which on chains are built anew.
MANY_CHANGES = 5


def rebuild_needed(changes: DataFrame, asked: bool = False, least: int = MANY_CHANGES) -> DataFrame:
    """Whether chains are built anew: when asked, or from five changes on, if there is any."""
    return changes.agg(F.count("*").alias("n")).select("n", ((F.col("n") > 0) & (F.lit(asked) | (F.col("n") >= least))).alias("rebuild"))


def typed_events(changes: DataFrame, failed: DataFrame, key: str = "file_path") -> DataFrame:
    """event, key, is_new: what a watcher tells of changes (key, change) when it has dealt with them: indexed, removed, or error; at the end ready.

    Added and changed files alike count as new; a removal can't fail.
    """
    bad = failed.select(key).distinct().withColumn("_failed", F.lit(True))
    event = F.when(F.col("change") == "removed", "removed").when(F.col("_failed"), "error").otherwise("indexed")
    told = changes.join(bad, key, "left").select(event.alias("event"), key, (event == "indexed").alias("is_new"))
    return told.unionByName(changes.sparkSession.range(1).select(F.lit("ready").alias("event"), F.lit(None).cast(changes.schema[key].dataType).alias(key), F.lit(False).alias("is_new")))
