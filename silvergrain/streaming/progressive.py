"""Progressive loading, debouncing and throttling with Structured Streaming."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from silvergrain.operators.ordering import with_next


def stream_records(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1, format: str = "parquet") -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def load_progressively(records: DataFrame, states: DataFrame, target: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, key: str = "full_path") -> StreamingQuery:
    """Append each batch, joined with the review states, to target; what is there is read once and then the query ends.

    A batch that is run again after a failure replaces what it wrote: each batch
    has a folder of its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        joined = batch.join(states, key, "left").withColumns({"rating": F.coalesce("rating", F.lit(0)), "status": F.coalesce("status", F.lit("None"))})
        joined.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if on_batch:
            on_batch(joined, number)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loads_progressively(inputs: DataFrame, recursive: bool, many: int = 180) -> DataFrame:
    """progressive: recursive loads, many inputs, or any folder."""
    return inputs.agg((F.lit(recursive) | (F.count(F.lit(1)) >= many) | F.coalesce(F.bool_or("is_folder"), F.lit(False))).alias("progressive"))


def debounced(events: DataFrame, key: str, at: str, quiet: str, *tie: str) -> DataFrame:
    """Of each key's events those that no other one follows within quiet (the last one always)."""
    order = [F.col(at), *[F.col(t) for t in tie]]
    followed = with_next(events, [key], order, at, "__follows")
    return followed.where(F.col("__follows").isNull() | (F.col("__follows") - F.col(at) >= F.expr(f"interval {quiet}"))).drop("__follows")


def debounced_stream(events: DataFrame, key: str, at: str, quiet: str, late: str) -> DataFrame:
    """One row per quiet-separated session of a key, with its last time; keyed.debounced_exactly gives the rows of debounced."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, quiet), key).agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("events"))


def refreshes(batch: Column, total: Column, busy: Column, every: int = 3, large: int = 960, huge: int = 2400) -> Column:
    """Whether a batch redraws: the first always, then every few, fewer for larger inputs and while busy."""
    step = F.lit(every) + F.when(total >= huge, 5).when(total >= large, 2).otherwise(0) + F.when(busy, 1).otherwise(0)
    return (batch <= 1) | (batch % step == 0)


def throttled(progress: DataFrame, every: int, order: str = "done") -> DataFrame:
    """Progress rows at each multiple of every and the last."""
    last = progress.agg(F.max(order).alias("__last"))
    return progress.crossJoin(F.broadcast(last)).where((F.col(order) % every == 0) | (F.col(order) == F.col("__last"))).drop("__last")  # one row


class ProgressReports(StreamingQueryListener):
    """Calls report(query, batch, rows so far, final) for a stream's progress: at each stride-th batch, or when interval seconds are over, and always for the last one."""

    def __init__(self, report: Callable[[str, int, int, bool], None], stride: int = 10, interval: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.report, self.stride, self.interval, self.clock = report, max(1, stride), interval, clock
        self.lock, self.rows, self.told, self.waits = threading.Lock(), {}, {}, {}

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.told[str(event.id)] = self.clock()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            name = str(p.id)
            if p.numInputRows or name not in self.waits:
                self.rows[name] = self.rows.get(name, 0) + p.numInputRows
            now = self.clock()
            self.waits[name] = p.batchId
            if (p.batchId + 1) % self.stride and now - self.told.get(name, -self.interval) < self.interval:
                return
            self.told[name] = now
            due = (name, p.batchId, self.rows[name], False)
        self.report(*due)

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            name = str(event.id)
            if name not in self.waits:
                return
            due = (name, self.waits.pop(name), self.rows.pop(name), True)
        self.report(*due)
