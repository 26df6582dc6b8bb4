"""Streams with keyed states against plain loops, for several splits into batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from silvergrain.streaming import keyed, progressive

START = dt.datetime(2024, 1, 1)


def in_batches(spark, folder, batches, schema):
    """A stream of the given rows, each list a batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k:03}")
    # one file a batch, oldest first
    import glob
    import os

    for k, name in enumerate(sorted(glob.glob(f"{folder}/*/*.parquet"))):
        os.utime(name, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(stream, mode, tmp_path):
    out = []

    def keep(batch, number):
        out.extend((number, *r) for r in batch.collect())

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return out


@pytest.mark.parametrize("cuts", [1, 4])
def test_debounced_stream_equals_the_batch(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    schema = "user_id long, event_id long, ts timestamp"
    rows = sorted((rng.randrange(500), rng.randrange(4)) for _ in range(120))
    rows = [(u, k, START + dt.timedelta(seconds=s)) for k, (s, u) in enumerate(rows)]
    batches = [rows[k * 120 // cuts : (k + 1) * 120 // cuts] for k in range(cuts)]
    for b in batches:
        rng.shuffle(b)
    # time goes on: nothing of this key is held against the others
    batches += [[(-1, 1000 + k, START + dt.timedelta(hours=1 + k))] for k in range(2)]
    events = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {(r["user_id"], r["event_id"]) for r in progressive.debounced(events, "user_id", "ts", "20 seconds", "event_id").collect() if r["user_id"] >= 0}
    stream = keyed.debounced_exactly(in_batches(spark, tmp_path / "in", batches, schema), "user_id", "ts", 20, "event_id", "60 seconds")
    got = run(stream, "append", tmp_path)
    assert len(got) == len(set(got))
    assert {(r[1], r[3]) for r in got if r[1] >= 0} == want


def test_a_state_holds_a_session_rather_than_its_events(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    crowd = [(1, k, START + dt.timedelta(milliseconds=k)) for k in range(400)]
    # exactly the quiet time apart is followed by nothing, a microsecond less is
    edge = [(2, 1000, START), (2, 1001, START + dt.timedelta(seconds=20)), (2, 1002, START + dt.timedelta(seconds=40, microseconds=-1)), (2, 1003, START + dt.timedelta(seconds=40, microseconds=-1))]
    later = [[(-1, -k, START + dt.timedelta(hours=k))] for k in (1, 2)]
    stream = keyed.debounced_exactly(in_batches(spark, tmp_path / "in", [crowd + edge, *later], schema), "user_id", "ts", 20, "event_id", "60 seconds")
    out = []
    q = stream.writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["user_id"], r["event_id"]) for r in out if r["user_id"] > 0} == {(1, 399), (2, 1000), (2, 1003)}
    assert max(sum(o["numRowsTotal"] + o["customMetrics"].get("numRegisteredTimers", 0) for o in p["stateOperators"]) for p in q.recentProgress) <= 4


def plain_store(events, most, budget):
    held = {}
    for at, name, size, write in events:
        if not write:
            if name in held:
                held[name] = (held[name][0], at)
            continue
        held[name] = (size, at)
        while (budget is not None and sum(b for b, _ in held.values()) > budget) or (most is not None and len(held) > most):
            others = [k for k in held if k != name]
            if not others:
                break
            del held[min(others, key=lambda k: (held[k][1], k))]
    return held


@pytest.mark.parametrize("most,budget", [(5, None), (None, 100), (4, 90)])
def test_store_equals_stepwise_eviction_after_each_batch(spark, tmp_path, most, budget):
    rng = random.Random(most or 1)
    schema = "bucket string, key string, bytes long, at long, write boolean"
    rows = [(rng.choice(["preview", "thumb"]), f"k{rng.randrange(9)}", rng.choice([10, 30, 60, 150]), k, rng.random() < 0.7) for k in range(90)]
    batches = [rows[:1], rows[1:30], rows[30:60], rows[60:]]
    got = run(keyed.store_changes(in_batches(spark, tmp_path / "in", batches, schema), most, budget), "update", tmp_path)
    done = []
    for number, batch in enumerate(batches):
        done += batch
        changes = spark.createDataFrame([r for r in got if r[0] <= number], "batch long, bucket string, key string, bytes long, at long, held boolean")
        held = {(r["bucket"], r["key"]): (r["bytes"], r["at"]) for r in keyed.store_table(changes).collect()}
        assert held == {(b, k): v for b in ("preview", "thumb") for k, v in plain_store([(a, k, s, w) for x, k, s, a, w in done if x == b], most, budget).items()}
    assert any(not r[5] for r in got)


def test_a_store_needs_a_limit(spark):
    with pytest.raises(ValueError):
        keyed.store_changes(spark.range(1).select(F.col("id").alias("bucket")))
