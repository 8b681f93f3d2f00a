"""Idle sessions in a stream of images."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rotaloom.session import new_path

SCHEMA = "session_id string, images bigint, last_image_at timestamp"


def idle_sessions(images: DataFrame, idle_seconds: int = 25, lateness: str = "10 seconds", clock: str = "event") -> DataFrame:
    """Sessions of a streaming table of images that got none for ``idle_seconds``: one row each.

    ``images``: session_id, created_at (event time); rows with nulls are left out. The state of a session
    is a count and a time. It closes when the watermark passes its last image by the idle time; images
    that come later open it anew only if they are within the watermark, older ones are dropped.

    The watermark stands still while no image of any session comes. With ``clock="processing"`` a session
    closes when the machine's clock is ``idle_seconds`` past its last batch, in a quiet stream too.
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock must be event or processing")
    gap = idle_seconds * 1000

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "images": [count], "last_image_at": [pd.Timestamp(last, unit="ms")]})
            return
        for batch in batches:
            count += len(batch)
            last = max(last, int(batch.created_at.max().timestamp() * 1000))
        state.update((count, last))
        if clock == "processing":
            state.setTimeoutDuration(gap)
        else:
            state.setTimeoutTimestamp(max(last + gap, state.getCurrentWatermarkMs() + 1))

    kept = images.where("session_id is not null and created_at is not null").select(F.col("session_id").cast("string").alias("session_id"), "created_at")
    kept, timeout = (kept, GroupStateTimeout.ProcessingTimeTimeout) if clock == "processing" else (kept.withWatermark("created_at", lateness), GroupStateTimeout.EventTimeTimeout)
    return kept.groupBy("session_id").applyInPandasWithState(step, SCHEMA, "images bigint, last bigint", "append", timeout)


def each_batch(frame: DataFrame, write, checkpoint: str, interval: str = "5 seconds"):
    """Starts ``frame``, giving ``write(batch, batch_id)`` every batch; a single writer for each sink."""
    return frame.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(write).start()


def run_to_end(frame: DataFrame) -> DataFrame:
    """The rows that a streaming frame appends for all input that is there now, written to the shared folder."""
    spark = frame.sparkSession
    out = new_path(spark)
    frame.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{out}/rows")
