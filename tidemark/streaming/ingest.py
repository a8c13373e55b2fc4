"""Structured Streaming: JSON-lines folders into the event table, and windowed counts.

Lines are validated as in batch. A stream has no dense line numbers, so the sequence number
is the position within the micro-batch over its start (`batch_id << 40`): it ascends, and a
restarted batch gives the same numbers to the same files. Repeats of an event_id within the
watermark are dropped; later ones wait for compaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import EVENTS
from ..sources.jsonl import accepted, keep_payload, rejected, validate
from ..sources.table import EventTable


def read_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Raw lines of text files as they arrive."""
    return spark.readStream.options(**options).text(folder).select(F.col("value").alias("raw"))


def with_event_time(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", delay)


def ingest_stream(lines: DataFrame, table: EventTable, checkpoint: str, bad_lines: str | None = None, **trigger) -> StreamingQuery:
    """Append valid events to `table`; rejected lines go to `bad_lines` as JSON if given."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        rows = keep_payload(batch).withColumn("line_no", F.monotonically_increasing_id())
        base = batch_id << 40
        checked = validate(rows, F.lit(base) + F.col("line_no") + 1).persist()
        try:
            # one row per id within the batch, the first
            good = accepted(checked)
            others = [c for c in EVENTS.fieldNames() if c != "event_id"]
            good = good.groupBy("event_id").agg(F.min_by(F.struct(*others), "sequence_num").alias("r")).select("event_id", "r.*")
            # a batch that was written before a restart is not written again
            done = table.events().filter(F.col("sequence_num").between(base + 1, base + (1 << 40) - 1)).limit(1)
            if done.isEmpty():
                table.append(good)
                if bad_lines:
                    rejected(checked).withColumn("batch", F.lit(batch_id)).write.mode("append").json(bad_lines)
        finally:
            checked.unpersist()

    return lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_events(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Valid events of a stream with event_time, repeats within the watermark dropped. Sequence numbers are 0."""
    checked = validate(keep_payload(lines), F.lit(0))
    good = checked.filter("error IS NULL").select(*EVENTS.fieldNames())
    return with_event_time(good, delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and statistics per entity, type and epoch-anchored window (the batch form anchors at the first event)."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    out = events.groupBy(w, "entity", "type").agg(F.count("*").alias("event_count"), F.avg("value_num").alias("mean"), F.min("value_num").alias("min"), F.max("value_num").alias("max"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "entity", "type", "event_count", "mean", "min", "max")
