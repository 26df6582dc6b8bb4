"""Streams with a state for each key: debouncing, and stores of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that these streams need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_store(df: DataFrame) -> DataFrame:
    """df, after its session was told to keep states in the store that timers and lists need."""
    df.sparkSession.conf.set(*STORE)
    return df


def debounced_exactly(events: DataFrame, key: str, at: str, quiet_seconds: float, tie: str, late: str) -> DataFrame:
    """(key, at, tie) of each key's events that no other one follows within quiet: the rows of debounced, for any split into batches.

    events: a stream whose rows come no more than late after later ones. Events
    that follow each other within quiet are a session, of which the last stays; it is
    decided once the watermark has passed its quiet time. A state holds an undecided
    session's last event rather than its events, so the last
    ones of a stream come out when its time goes on. tie: a long that orders events
    of one time. Nulls in key or at take no part.
    """
    # a session's end still belongs to it, so it is a microsecond less than the quiet time
    gap = f"{round(quiet_seconds * 1_000_000) - 1} microseconds"
    named = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    last = F.max(F.struct(F.col(at).alias("at"), F.col(tie).cast("long").alias("tie")))
    out = named.groupBy(F.session_window(at, gap), F.col(key).alias("__key")).agg(last.alias("__last"))
    return out.select(F.col("__key").alias(key), F.col("__last.at").alias(at), F.col("__last.tie").alias(tie))


class _Store(StatefulProcessor):
    """A bucket's entries by recency, within a number and a budget of bytes; what is written now is never thrown out by its own write."""

    def __init__(self, most: int | None, budget: int | None):
        self.most, self.budget = most, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "bytes long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: (int(v[0]), int(v[1])) for k, v in self.entries.iterator()}
        before = dict(held)
        events = sorted((int(a), k, int(b), bool(w)) for part in rows for a, k, b, w in zip(part["at"], part["key"], part["bytes"], part["write"], strict=True))
        for at, name, size, write in events:
            if not write:
                if name in held:  # a hit makes it recent
                    held[name] = (held[name][0], at)
                continue
            held[name] = (size, at)
            total = sum(b for b, _ in held.values())
            for old in sorted(held, key=lambda k: (held[k][1], k)):
                over = (self.budget is not None and total > self.budget) or (self.most is not None and len(held) > self.most)
                if not over:
                    break
                if old != name:
                    total -= held.pop(old)[0]
        for name in before.keys() - held.keys():
            self.entries.removeKey((name,))
        for name, value in held.items():
            if before.get(name) != value:
                self.entries.updateValue((name,), value)
        changed = [(n, *held.get(n, before.get(n)), n in held) for n in sorted(before.keys() | held.keys()) if before.get(n) != held.get(n)]
        if changed:
            yield pd.DataFrame([(key[0], *c) for c in changed], columns=["bucket", "key", "bytes", "at", "held"])

    def close(self) -> None:
        pass


def store_changes(accesses: DataFrame, most: int | None = None, budget: int | None = None) -> DataFrame:
    """bucket, key, bytes, at, held: what each batch changes in stores of bounded size, one for each bucket.

    accesses: a stream of bucket, key, bytes, at (a long that orders a bucket's
    accesses) and write. A write puts or replaces an entry and then throws out
    the least recent others while there are more than most, or more than
    budget bytes; it stays itself, however large. A read makes an entry recent and does
    nothing for one that isn't held. A bucket's state is as large as its store,
    so a bucket is what one task can hold: the limits bound it. Within a
    batch accesses go by at; a later batch is later. Of an entry thrown out, its last
    bytes and access come with held false.
    """
    if most is None and budget is None:
        raise ValueError("a store needs a number of entries or a budget")
    kind = T.StructType.fromDDL("bucket string, key string, bytes long, at long, held boolean")
    rows = accesses.select(F.col("bucket").cast("string").alias("bucket"), F.col("key").cast("string").alias("key"), F.col("bytes").cast("long").alias("bytes"), F.col("at").cast("long").alias("at"), "write")
    return with_store(rows).groupBy("bucket").transformWithStateInPandas(_Store(most, budget), kind, "Update", "None")


def store_table(changes: DataFrame, batch: str = "batch") -> DataFrame:
    """bucket, key, bytes, at of what is held after all changes (with the number of their batch)."""
    last = changes.groupBy("bucket", "key").agg(F.max_by(F.struct("bytes", "at", "held"), batch).alias("l"))
    return last.select("bucket", "key", "l.*").where("held").drop("held")
