"""Streams: settled changes as sessions, latest positions, and jobs for each batch.

Event time comes from the source; the watermark is the debounce time, beyond which
a late mark starts a session of its own.  A session window joins a mark that
comes exactly one gap later, where the batch form starts anew, so that the
gap is a microsecond shorter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselite.operators import jobs as j
from tesselite.operators import markers as m
from tesselite.plans.spec import Profile


def settled_sessions(marks: DataFrame, debounce_seconds: int) -> DataFrame:
    """Marks (dimension, chunk_x, chunk_z, ts) of a chunk with smaller gaps than the debounce time, once they settled."""
    gap = F.session_window("ts", f"{debounce_seconds * 1_000_000 - 1} microseconds")
    return marks.withWatermark("ts", f"{debounce_seconds} seconds").groupBy("dimension", "chunk_x", "chunk_z", gap).agg(F.count("*").alias("marks"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("session_window")


def _trigger(every: str | None) -> dict:
    """Once through what is there, or again after each such time ("5 seconds")."""
    return {"processingTime": every} if every else {"availableNow": True}


def start_jobs(marks: DataFrame, profile: Profile, debounce_seconds: int, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Hands each batch's distinct jobs to the sink; runs through what is there, or with ``every`` until it is stopped."""

    def batch(df: DataFrame, number: int) -> None:
        sink(j.metatile_jobs(df.select("dimension", "chunk_x", "chunk_z").distinct(), profile), number)

    return settled_sessions(marks, debounce_seconds).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def start_latest_store(positions: DataFrame, path: str, checkpoint: str, parts: int = 64, every: str | None = None) -> StreamingQuery:
    """Hands on each one's latest position of every batch to Parquet at ``path``, one folder a batch; ``m.latest`` over the folders
    is what holds now.  A batch that is run again replaces its folder, and nothing is kept on the driver."""

    def batch(df: DataFrame, number: int) -> None:
        m.latest(df).repartition(parts, "uuid").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return positions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def start_latest(positions: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps each one's latest position in an in-memory table of the session, for a few; else ``start_latest_store``."""
    return m.latest(positions).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
