"""Tables written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the run that is open, if any.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)
#: Lets shuffle files of a job go at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of the open run, else of spark.checkpoint.dir. Where a session names none, one is made on a single machine; on a cluster that raises."""
    if _RUN.get():
        return _RUN.get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="silvergrain-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files; the session's own setting holds again afterwards."""
    before = spark.conf.get(CLEANUP, None)
    if before == "true":
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet and read it again: later jobs start from the files, and what was shuffled for them goes at once."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(spark: SparkSession) -> Iterator[str]:
    """A run: tables written between jobs inside it lie below one folder, which goes at its end, also after an error.

    DataFrames made inside read those tables, so what is to stay has to be
    written elsewhere, or collected, before the end. An inner run lies in the
    outer one's folder. Threads started inside aren't part of the run.
    """
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    before = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def outside() -> Iterator[None]:
    """Tables written inside lie beside the folder of the open run, and stay when it goes."""
    run = _RUN.get()
    before = _RUN.set(run and run.rsplit("/", 1)[0])
    try:
        yield
    finally:
        _RUN.reset(before)
