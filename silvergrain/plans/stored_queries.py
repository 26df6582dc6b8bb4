"""Queries whose rows go through what the library keeps: streams run to their end, states, snapshots and logs that are written and read again.

Each writes below the folder of spark.checkpoint.dir, under a name of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.functions import naming
from silvergrain.operators import lookups, ordering, state
from silvergrain.plans import export
from silvergrain.plans.queries import query
from silvergrain.sources import sinks, versions
from silvergrain.sources.catalog import documents_catalog, documents_review
from silvergrain.sources.staging import shared_dir
from silvergrain.streaming import keyed, progressive, scan


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a table that is one file or a folder: by a pattern, since a stream of a plain path has to be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _run_to_end(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """What the stream has written so far, with the number of the batch, after all that is there was worked on."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{folder}/rows")


@query("SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts >= INTERVAL 1 HOUR")
def q_debounced_stream(spark, sf_dir):
    folder = _folder(spark, "debounced")
    at = F.col("ts").cast("timestamp").alias("ts")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long"), "event_id", at)
    schema = "user_id long, event_id long, ts timestamp"
    events.write.parquet(f"{folder}/in")
    stream = keyed.debounced_exactly(spark.readStream.schema(schema).parquet(f"{folder}/in"), "user_id", "ts", 3600, "event_id", "1 minute")
    _run_to_end(stream, "append", f"{folder}/out")
    end = events.agg(F.max("ts")).first()[0]
    # time goes on, so that the last events are decided: rows without a user's key, a day and two days later
    for days in (1, 2) if end else ():
        later = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-days).cast("long").alias("event_id"), (F.lit(end) + F.make_dt_interval(F.lit(days))).alias("ts"))
        later.write.mode("append").parquet(f"{folder}/in")
        out = _run_to_end(stream, "append", f"{folder}/out")
    return out.where("event_id >= 0").select("user_id", "event_id") if end else events.select("user_id", "event_id")


@query('SELECT user_id::VARCHAR AS bucket, event_type AS key, bytes, "at" FROM (SELECT user_id, event_type, max(event_id) AS "at", max_by(floor(abs(value))::BIGINT * 40, event_id) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS r FROM events GROUP BY user_id, event_type) WHERE r <= 2')
def q_store_stream(spark, sf_dir):
    accesses = _streamed(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("bucket"), F.col("event_type").alias("key"), (F.floor(F.abs("value")) * 40).alias("bytes"), F.col("event_id").alias("at"), F.lit(True).alias("write"))
    changes = _run_to_end(keyed.store_changes(accesses, most=2), "update", _folder(spark, "store"))
    return keyed.store_table(changes)


@query("SELECT doc_id, rating, status FROM reviewed")
def q_loaded_stream(spark, sf_dir):
    folder = _folder(spark, "loaded")
    records = _streamed(spark, f"{sf_dir}/documents.parquet").select("doc_id")
    progressive.load_progressively(records, documents_review(spark, sf_dir), f"{folder}/rows", f"{folder}/checkpoint", key="doc_id").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("doc_id", "rating", "status")


@query("SELECT doc_id, row_number() OVER (ORDER BY size_bytes DESC, lower(file_name), file_name, full_path) - 1 AS index, rating, status FROM reviewed")
def q_scanned_stream(spark, sf_dir):
    folder = _folder(spark, "scanned")
    c = documents_catalog(spark, sf_dir).withColumns({"folder": naming.folder(F.col("full_path")), "is_root": F.lit(False)})
    scan.publish(scan.scan_batches(ordering.numbered(c, [], [F.col("folder"), F.col("file_name")], "index")), f"{folder}/batches")
    load = scan.load_scan(spark, f"{folder}/batches", documents_review(spark, sf_dir), f"{folder}/rows", f"{folder}/checkpoint", key="doc_id")
    try:
        load.processAllAvailable()
    finally:
        load.stop()
    return scan.finish_load(spark, f"{folder}/rows", "size", f"{folder}/final").select("doc_id", "index", "rating", "status")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 5 ELSE rating END::INT AS rating, CASE WHEN doc_id % 10 = 3 THEN 'Keep' ELSE status END AS status FROM reviewed WHERE doc_id % 10 <> 7 AND (doc_id % 10 = 3 OR rating <> 0 OR status <> 'None')")
def q_versioned_review(spark, sf_dir):
    root = _folder(spark, "versions")
    c = documents_catalog(spark, sf_dir)
    reviewed = lookups.with_review(c, documents_review(spark, sf_dir), "doc_id").select("doc_id", "rating", "status").where("rating <> 0 OR status <> 'None'")
    versions.create(reviewed, root, ["doc_id"], 16)
    better = c.where("doc_id % 10 = 3").select("doc_id", F.lit(5).alias("rating"), F.lit("Keep").alias("status"), F.col("modified_at").alias("changed_at"))
    versions.upsert(better, root, lambda old, new: state.upsert_review(old, new, "doc_id"))
    cleared = c.where("doc_id % 10 = 7").select("doc_id", F.lit(0).alias("rating"), F.lit("None").alias("status"), F.col("modified_at").alias("changed_at"))
    versions.upsert(cleared, root, lambda old, new: state.upsert_review(old, new, "doc_id"))
    return versions.read(spark, root)


@query("SELECT doc_id, rating, status FROM reviewed WHERE rating > 0")
def q_snapshot(spark, sf_dir):
    path = _folder(spark, "snapshot")
    rated = lookups.with_review(documents_catalog(spark, sf_dir), documents_review(spark, sf_dir), "doc_id").select("doc_id", "rating", "status").where("rating > 0")
    written = sinks.write_snapshot(rated, path, "doc_id")
    again = spark.read.schema(rated.schema).json(path)
    # the same rows in another order have the same hash, so nothing is written while path is read
    sinks.write_snapshot(again.repartition(3), path, unless=written)
    return again


@query("SELECT event_id, event_type, ts::DATE::VARCHAR AS day FROM events")
def q_appended_events(spark, sf_dir):
    path = _folder(spark, "events")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts")
    for half in (0, 1):
        sinks.append_events(e.where(F.col("event_id") % 2 == half), path)
    return spark.read.schema("event_id long, event_type string, day date").json(path).select("event_id", "event_type", F.col("day").cast("string").alias("day"))


@query("SELECT doc_id AS key, CASE WHEN doc_id % 120 > 100 THEN 100 WHEN doc_id % 120 = 0 THEN 1 ELSE doc_id % 120 END::INT AS quality, doc_id % 120 > 0 AS within FROM documents")
def q_quality_search(spark, sf_dir):
    size = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), (F.coalesce("n_chars", F.lit(0)) + 1).alias("a"))
    items = size.select("key", (F.col("a") * (F.col("key") % 120)).alias("target"))
    probe = lambda rows: rows.join(size, "key").select("key", "quality", (F.col("a") * F.col("quality")).alias("bytes"))
    return export.search_quality(items, probe, 1, 100).select("key", "quality", "within")
