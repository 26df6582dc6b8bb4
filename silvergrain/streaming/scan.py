"""A progressive scan as a stream: batches end where a reader of one folder after another would show what it has."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from silvergrain.operators.ordering import indexed
from silvergrain.sources.files import opened

# Entries of a batch; of the first and the other early ones; of one at a folder's end; entries that count as early.
BATCH, FIRST, EARLY, AT_FOLDER, EARLY_UNTIL = 160, 24, 48, 12, 200

#: Batches that are published as one folder, and that one task reads.
TOGETHER = 32


def early_ends(folders: list[tuple[str, bool]], size: int = BATCH) -> list[int]:
    """Where the early batches end, from the first entries' folders (name, whether it is an input) in order.

    While no more than EARLY_UNTIL entries are known, a batch ends when it is
    full, when an input folder is done, or when another folder is done
    and AT_FOLDER entries wait. An entry beyond EARLY_UNTIL says whether the folder before it is done.
    """
    first, early, boundary = min(size, FIRST), min(size, EARLY), min(size, EARLY, AT_FOLDER)
    ends, held = [], 0
    for k, (folder, is_root) in enumerate(folders[: EARLY_UNTIL + 1], 1):
        held += 1
        last = k == len(folders) or folders[k][0] != folder
        if held >= size or (k <= EARLY_UNTIL and (held >= (first if k <= first else early) or (last and (is_root or held >= boundary)))):
            ends.append(k)
            held = 0
    return ends


def scan_batches(entries: DataFrame, size: int = BATCH, index: str = "index", folder: str = "folder", is_root: str = "is_root") -> DataFrame:
    """Add batch (from 0) to entries numbered in the order of the walk.

    Only the first EARLY_UNTIL + 2 entries reach the driver: beyond them batches are equal.
    """
    known = entries.where(F.col(index) < EARLY_UNTIL + 2).select(index, folder, is_root).collect()
    ends = early_ends([(r[folder], r[is_root]) for r in sorted(known, key=lambda r: r[index])], size)
    last = ends[-1] if ends else 0
    number: Column = F.floor((F.col(index) - last) / size) + len(ends)
    for k, end in reversed(list(enumerate(ends))):
        number = F.when(F.col(index) < end, F.lit(k)).otherwise(number)
    return entries.withColumn("batch", number.cast("int"))


def publish(batched: DataFrame, target: str) -> int:
    """Write a folder for each TOGETHER batches and, last, their number; returns it. A reader sees all batches or none."""
    n = int(batched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = batched.withColumn("together", F.floor(F.col("batch") / TOGETHER))
    kept.repartitionByRange(n, "batch", "index").sortWithinPartitions("together", "batch", "index").write.mode("overwrite").partitionBy("together").parquet(target)
    last = batched.sparkSession.read.schema(batched.schema).parquet(target).agg(F.max("batch")).first()[0]
    total = 0 if last is None else last + 1
    system, inner = opened(target)
    with system.open_output_stream(f"{inner}/_batches.json") as f:
        f.write(json.dumps({"batches": total, "schema": batched.schema.json()}).encode())
    return total


def _described(path: str) -> dict:
    system, inner = opened(path)
    with system.open_input_stream(f"{inner}/_batches.json") as f:
        return json.loads(f.read())


class _Reader(DataSourceStreamReader):
    """Offsets count batches. Each trigger gets one more batch than the last planned one, later a quarter of what was planned.

    So triggers grow with the logarithm of the batches, which keep their ends. What has been planned is kept in progress: a restarted stream goes on after
    it, once Spark has run again what its checkpoint holds as planned.
    """

    def __init__(self, options: dict):
        self.path, self.progress = options["path"], options["progress"]
        self.total = _described(self.path)["batches"]
        self.planned: int | None = None

    def _last(self) -> int:
        if self.planned is None:
            system, inner = opened(self.progress)
            try:
                with system.open_input_stream(inner) as f:
                    self.planned = int(f.read())
            except FileNotFoundError:
                self.planned = 0
        return self.planned

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        return {"batch": min(self._last() + max(1, self._last() // 4), self.total)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["batch"] > start["batch"]:
            self.planned = end["batch"]
            system, inner = opened(self.progress)
            with system.open_output_stream(inner) as f:
                f.write(str(self.planned).encode())
        return [InputPartition((max(k, start["batch"]), min(k + TOGETHER, end["batch"]))) for k in range(start["batch"] // TOGETHER * TOGETHER, end["batch"], TOGETHER)]

    def read(self, partition: InputPartition) -> Iterator:
        first, end = partition.value
        wanted = (pc.field("batch") >= first) & (pc.field("batch") < end)
        system, inner = opened(self.path)
        for info in sorted(system.get_file_info(fs.FileSelector(f"{inner}/together={first // TOGETHER}")), key=lambda i: i.path):
            if info.path.endswith(".parquet"):
                with system.open_input_file(info.path) as f:
                    yield from pq.ParquetFile(f).read().filter(wanted).to_batches()


class ScanSource(DataSource):
    """Published batches as a stream, one a trigger at first, more as it goes on; column batch tells them apart. Options: path (from publish), progress (a file of the stream's own)."""

    @classmethod
    def name(cls) -> str:
        return "scan_batches"

    def schema(self):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(_described(self.options["path"])["schema"]))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def scan_stream(spark: SparkSession, path: str, progress: str) -> DataFrame:
    spark.dataSource.register(ScanSource)
    return spark.readStream.format("scan_batches").option("path", path).option("progress", progress).load()


def load_scan(spark: SparkSession, path: str, states: DataFrame, target: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, key: str = "full_path") -> StreamingQuery:
    """Start appending the published batches, joined with the review states, to target/load=0, 1 and so on, a folder a trigger.

    The first triggers bring a batch each, later ones a quarter of what is there;
    column batch tells batches apart, and on_batch is called a trigger. A trigger
    that runs again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        joined = batch.join(states, key, "left").withColumns({"rating": F.coalesce("rating", F.lit(0)), "status": F.coalesce("status", F.lit("None"))})
        joined.write.mode("overwrite").parquet(f"{target}/load={number}")
        if on_batch:
            on_batch(joined, number)

    return scan_stream(spark, path, f"{checkpoint}-progress").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def finish_load(spark: SparkSession, target: str, mode: str, final: str) -> DataFrame:
    """All appended batches rewritten in the order of mode, as a load ends."""
    every = spark.read.parquet(target).drop("load", "batch", "index")
    indexed(every, mode).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "index").sortWithinPartitions("index").write.mode("overwrite").parquet(final)
    return spark.read.parquet(final)
