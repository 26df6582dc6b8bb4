"""States as snapshot versions: a reader sees one whole version, a failed writer changes none.

A state lies in buckets of its key's hash. A version is a small manifest that
names each bucket's folder; it counts once it stands under its final name. An
upsert writes only the buckets that its changes touch.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvergrain.sources.files import opened
from silvergrain.sources.staging import cut

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer made the version first; nothing of this one counts."""


def _manifests(root: str) -> list[int]:
    system, inner = opened(f"{root}/versions")
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted(int(i.base_name[1:-5]) for i in found if i.base_name.startswith("v") and i.base_name.endswith(".json"))


def latest(root: str) -> int:
    """The number of the newest version; 0 where there is none."""
    return (_manifests(root) or [0])[-1]


def _manifest(root: str, version: int) -> dict:
    system, inner = opened(f"{root}/versions/v{version:09d}.json")
    with system.open_input_stream(inner) as f:
        return json.loads(f.read())


def _publish(root: str, version: int, manifest: dict) -> None:
    system, inner = opened(f"{root}/versions")
    system.create_dir(inner, recursive=True)
    name, final = f"{inner}/.{uuid.uuid4().hex}", f"{inner}/v{version:09d}.json"
    with system.open_output_stream(name) as f:
        f.write(json.dumps(manifest).encode())
    if system.get_file_info(final).type != fs.FileType.NotFound:
        system.delete_file(name)
        raise Conflict(f"version {version} of {root} is there already")
    system.move(name, final)


def _write(df: DataFrame, root: str, key: list[str], buckets: int) -> dict[str, str]:
    """The folder of each bucket that df has rows of."""
    folder = f"{root}/data/{uuid.uuid4().hex}"
    df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
    system, inner = opened(folder)
    return {i.base_name.removeprefix(f"{BUCKET}="): f"{folder}/{i.base_name}" for i in system.get_file_info(fs.FileSelector(inner)) if i.base_name.startswith(f"{BUCKET}=")}


def bucket_of(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def create(state: DataFrame, root: str, key: list[str], buckets: int = 64) -> int:
    """Write the first version. buckets is fixed for good: as many as keep one bucket a task's work."""
    version = latest(root) + 1
    if version > 1:
        raise Conflict(f"{root} holds a state already")
    _publish(root, version, {"key": key, "buckets": buckets, "schema": state.schema.jsonValue(), "files": _write(state, root, key, buckets)})
    return version


def read(spark: SparkSession, root: str, version: int | None = None, only: list[str] | None = None) -> DataFrame:
    """A whole version, the newest if none is named; only: some of its buckets. A root without versions raises."""
    m = _manifest(root, version or latest(root))
    schema = T.StructType.fromJson(m["schema"])
    paths = [p for b, p in m["files"].items() if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(changes: DataFrame, root: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Write the next version: merge(rows of the touched buckets, changes); the other buckets keep their files.

    merge must return rows of the same keys or leave keys out; rows are put into
    buckets anew. changes are written first, so that merge and the list of
    touched buckets see the same rows, and that list is all the driver holds. A writer that
    fails leaves the newest version as it was; where another one was faster, Conflict is raised and
    nothing counts.
    """
    spark = changes.sparkSession
    was = latest(root)
    m = _manifest(root, was)
    key, buckets = m["key"], m["buckets"]
    new = cut(changes, "changes")
    touched = {str(r[0]) for r in new.select(bucket_of(key, buckets)).distinct().collect()}  # buckets rows at most
    merged = merge(read(spark, root, was, sorted(touched)), new).select(*[f.name for f in T.StructType.fromJson(m["schema"])])
    files = _write(merged, root, key, buckets)
    if not set(files) <= touched:
        raise ValueError("merge has made keys of buckets that no change touches")
    kept = {b: p for b, p in m["files"].items() if b not in touched}
    _publish(root, was + 1, {**m, "files": kept | files})
    return was + 1


def forget(root: str, keep: int = 2) -> int:
    """Drop all but the newest keep versions and the folders that none of those names; returns how many folders went.

    For when nobody writes or reads older versions: a writer's folders count only once its version does.
    """
    known = _manifests(root)
    held = {p for v in known[-keep:] for p in _manifest(root, v)["files"].values()}
    system, inner = opened(root)
    for v in known[:-keep]:
        system.delete_file(f"{inner}/versions/v{v:09d}.json")
    gone = 0
    names = {opened(p)[1] for p in held}
    for run in system.get_file_info(fs.FileSelector(f"{inner}/data", allow_not_found=True)):
        for i in system.get_file_info(fs.FileSelector(run.path)):
            if i.type == fs.FileType.Directory and i.path not in names:
                system.delete_dir(i.path)
                gone += 1
    return gone
