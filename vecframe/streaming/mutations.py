"""Mutation logs as streams, and event streams in windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import Files
from ..sources.store import latest, read_commits


ENTRY = "folder string, collections array<string>"


def commit_stream(spark: SparkSession, root: str, per_trigger: int = 100) -> DataFrame:
    """The published commits of a database as a stream: seq, folder, collections.

    Rows of a commit that was never published are in no entry, so they are never seen. A
    database without commits gives a stream that waits for them. Commits that ``vacuum``
    deleted before the stream read them are missed, so consume the log before.
    """
    Files(spark, root).make("log")
    rows = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.json").json(f"{root.rstrip('/')}/log")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"/log/(\d+)\.json", 1).cast("long").alias("seq"), "folder", "collections")


def apply_log(spark: SparkSession, root: str, apply: Callable[[DataFrame, int], None], checkpoint: str, collection: str | None = None, per_trigger: int = 100) -> StreamingQuery:
    """Hand the latest mutation per record of each micro-batch of commits to ``apply``; what is there now, exactly once per batch id."""
    root = root.rstrip("/")

    def batch(df: DataFrame, number: int) -> None:
        folders = [r[0] for r in df.select("folder").collect()]  # at most per_trigger
        if not folders:
            return
        rows = read_commits(df.sparkSession, root, folders)
        rows = rows if collection is None else rows.filter(F.col("collection") == collection)
        apply(latest(rows, ["collection", "id"], ["seq", "at"]), number)

    return commit_stream(spark, root, per_trigger).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums per tumbling window and key; on a stream, events later than ``late`` are dropped."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, every).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")
