"""Structured Streaming: ingestion into tables, windows, watermarked dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.temporal import apply_changes
from ..session import stored
from ..sources.table import SnapshotTable


def _triggered(writer, trigger: str, every: str | None):
    if trigger == "availableNow":
        return writer.trigger(availableNow=True)
    if trigger == "processingTime":
        return writer.trigger(processingTime=every or "1 minute")
    raise ValueError(f"unknown trigger {trigger!r}")


def append_stream(stream: DataFrame, table: SnapshotTable, checkpoint: str, trigger: str = "availableNow", every: str | None = None) -> StreamingQuery:
    """Start one query that appends micro-batches to a table, with new columns
    merged in. Batches are committed under (checkpoint, number), so a batch that
    is replayed after a failure is not added twice."""

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.append(batch, merge_schema=True, batch=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).outputMode("append")
    return _triggered(writer, trigger, every).start()


def ingest(stream: DataFrame, table: SnapshotTable, checkpoint: str, continuous: bool = False, every: str = "1 minute") -> int | StreamingQuery:
    """Drain what is there into the table; rows that this run added. With
    ``continuous`` start micro-batches on a timer instead and return the running
    query, which the caller stops."""
    if continuous:
        return append_stream(stream, table, checkpoint, "processingTime", every)
    before = set(table.entry().files) if table.exists() else set()
    append_stream(stream, table, checkpoint).awaitTermination()
    return table.rows_in([f for f in table.entry().files if f not in before]) if table.exists() else 0


def apply_changes_into(
    stream: DataFrame, target: SnapshotTable, log: SnapshotTable, keys: list[str], sequence_by: str, track: list[str], checkpoint: str, trigger: str = "availableNow", every: str | None = None
) -> StreamingQuery:
    """Keep ``target`` at the versions (``operators.temporal.apply_changes``) of a
    change stream. Changes are kept in ``log``; a batch rebuilds the versions of
    its keys, late changes included, and rewrites the files that hold them. A
    batch that is replayed changes nothing; of equal (keys, sequence) one counts."""

    def commit(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        log.append(batch, merge_schema=True, batch=(checkpoint, number))
        touched = stored(batch.select(*keys).distinct(), "touched")
        changes = log.read().join(touched, keys, "left_semi").dropDuplicates([*keys, sequence_by])
        rows = apply_changes(changes, keys, sequence_by, track)
        if not target.exists():
            target.overwrite(rows)
            return
        files = target.files_with(target.read(), touched, keys)
        others = target.read_files(files).join(touched, keys, "left_anti")
        target.replace(files, others.unionByName(rows, allowMissingColumns=True), "apply_changes")

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).outputMode("append")
    return _triggered(writer, trigger, every).start()


def dedup_within(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """First rows by key, with state that the watermark bounds."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, window: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """Rows by event-time window and keys; ``delay`` bounds the state."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    if delay:
        stream = stream.withWatermark(time, delay)
    return stream.groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))


def collect_stream(stream: DataFrame, table: SnapshotTable, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stateful stream over what is there and return what it emitted (in
    mode complete: its last state)."""

    def commit(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            table.overwrite(batch)
        else:
            table.append(batch, batch=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).outputMode(mode)
    _triggered(writer, "availableNow", None).start().awaitTermination()
    return table.read()
