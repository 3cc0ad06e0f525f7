"""Resumable append and history as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ridgeline.sources.sinks import append_pruned


def append_stream(rows: DataFrame, path: str, checkpoint: str, *keys: str, available_now: bool = True, prefixes: int = 256) -> StreamingQuery:
    """Append each micro-batch's new keys to a table, of which it reads the folders of its own keys; a batch that is played again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        append_pruned(batch, path, *keys, prefixes=prefixes)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
