"""Report messages and counts as streams.

A streamed table is a folder of changes: ``changes/batch=N`` holds what micro-batch N brought, and
nothing else, so the work of a batch grows with the batch and not with the table. Readers merge the
changes; ``compact`` merges them for good into ``base/upto=N``, while streams go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusqa.operators.reports import merge_entries, process_records, report_entries
from corpusqa.session import delete_folder

# How long after the newest message an older one may still come.
LATENESS = "30 days"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing is stored yet
        return None


def _upto(base: DataFrame | None) -> int | None:
    return None if base is None else base.agg(F.max("upto")).first()[0]


def _rows(spark: SparkSession, table: str) -> DataFrame:
    """The newest base and the changes after it; folder names decide what is read."""
    base, changes = _read(spark, f"{table}/base"), _read(spark, f"{table}/changes")
    upto = _upto(base)
    if upto is None:
        if changes is None:
            raise ValueError(f"nothing is stored in {table}")
        return changes.drop("batch")
    kept = base.filter(F.col("upto") == upto).drop("upto")
    return kept if changes is None else kept.unionByName(changes.filter(F.col("batch") > upto).drop("batch"))


def _compact(spark: SparkSession, table: str, merge: Callable[[DataFrame], DataFrame]) -> int:
    changes = _read(spark, f"{table}/changes")
    newest = None if changes is None else changes.agg(F.max("batch")).first()[0]
    upto = _upto(_read(spark, f"{table}/base"))
    if newest is None or (upto is not None and newest <= upto):
        return -1 if upto is None else upto
    # a batch that ends meanwhile is newer and stays a change
    until = changes.filter(F.col("batch").between((-1 if upto is None else upto) + 1, newest)).drop("batch")
    rows = until if upto is None else until.unionByName(_read(spark, f"{table}/base").filter(F.col("upto") == upto).drop("upto"))
    merge(rows).write.mode("overwrite").parquet(f"{table}/base/upto={newest}")
    return newest


def vacuum(spark: SparkSession, table: str) -> int:
    """Delete changes and bases that the newest base contains; returns how many folders. Run it when no reader
    still uses them."""
    base, changes = _read(spark, f"{table}/base"), _read(spark, f"{table}/changes")
    upto = _upto(base)
    if upto is None:
        return 0
    old = [f"{table}/base/upto={r[0]}" for r in base.filter(F.col("upto") < upto).select("upto").distinct().collect()]
    if changes is not None:
        old += [f"{table}/changes/batch={r[0]}" for r in changes.filter(F.col("batch") <= upto).select("batch").distinct().collect()]
    for path in old:
        delete_folder(spark, path)
    return len(old)


def _start(rows: DataFrame, table: str, checkpoint: str, mode: str, available_now: bool, of_batch: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    def store(batch: DataFrame, number: int) -> None:
        # replaying a batch replaces its folder
        of_batch(batch).write.mode("overwrite").parquet(f"{table}/changes/batch={number}")

    writer = rows.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merge_process_stream(
    reports: DataFrame, table: str, checkpoint: str, available_now: bool = True, lateness: str = LATENESS
) -> StreamingQuery:
    """Merge arriving messages into ``table``; ``merged_records`` reads it.

    Redelivered messages are dropped by Spark's state, which keeps the identity (id, kind, seq) of a message
    until the watermark, ``lateness`` behind the newest time, has passed it. Messages older than the
    watermark are dropped and counted (``late_rows``). What is new is merged per question and stored as the
    batch's changes. Merging is idempotent: a copy that comes once its identity is forgotten is
    late, too, and nothing is counted twice. A message without a time counts as of now.
    """
    at = F.coalesce(F.timestamp_millis("time"), F.current_timestamp())
    timely = reports.withColumn("_at", at).withWatermark("_at", lateness).dropDuplicatesWithinWatermark(["id", "kind", "seq"])
    return _start(timely.drop("_at"), table, checkpoint, "append", available_now, lambda batch: merge_entries(report_entries(batch)))


def late_rows(query: StreamingQuery) -> int:
    """How many rows behind the watermark the query has dropped, over the progress that it remembers."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def merged_entries(spark: SparkSession, table: str) -> DataFrame:
    return merge_entries(_rows(spark, table))


def merged_records(spark: SparkSession, table: str) -> DataFrame:
    """One record per question, of all batches so far."""
    return process_records(merged_entries(spark, table))


def compact(spark: SparkSession, table: str) -> int:
    """Merge the changes so far into a new base; returns the last batch in it. Streams may run meanwhile."""
    return _compact(spark, table, merge_entries)


def _newest_counts(rows: DataFrame) -> DataFrame:
    # a total only grows, so the largest is the newest
    return rows.groupBy("section", "key").agg(F.max("count").alias("count"))


def running_counts(
    entries: DataFrame, table: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Counts per (section, key) of arriving entries, as they grow.

    The totals are Spark's streaming state; a micro-batch stores those it has changed. ``latest_counts``
    reads the newest of each key.
    """
    counts = entries.groupBy("section", "key").agg(F.count(F.lit(1)).alias("count"))
    return _start(counts, table, checkpoint, "update", available_now, lambda batch: batch)


def latest_counts(spark: SparkSession, table: str) -> DataFrame:
    """Newest total of each key."""
    return _newest_counts(_rows(spark, table))


def compact_counts(spark: SparkSession, table: str) -> int:
    """``compact`` for a table of counts."""
    return _compact(spark, table, _newest_counts)
