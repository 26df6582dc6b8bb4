"""Walking folders, level by level: the frontier is a table, and tasks list its folders."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvergrain.functions.naming import is_picture
from silvergrain.operators.ordering import numbered
from silvergrain.sources.catalog import absolute
from silvergrain.sources.files import listed, opened
from silvergrain.sources.staging import cut

ENTRIES = "kind string, full_path string, size_bytes long, modified_at timestamp, folder string, error string"
#: Entries that a task hands on at a time, so that a folder of any size is never held.
AT_A_TIME = 4096


@dataclass
class Walked:
    """files: full_path, file_name, size_bytes, modified_at, folder; folders: full_path, root, level; errors: full_path, error."""

    files: DataFrame
    folders: DataFrame
    errors: DataFrame


def _normal(path: str) -> str:
    plain = path.removeprefix("file:").replace("///", "/", 1) if path.startswith("file:") else path
    return absolute(plain.strip())


def _listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string()]
    names = [c.split(" ")[0] for c in ENTRIES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows: list[tuple] = []
    for b in batches:
        for folder in b.column(0).to_pylist():
            try:
                for kind, path, size, at in listed(folder):
                    when = dt.datetime.fromtimestamp(at, dt.UTC) if kind == "file" else None
                    rows.append((kind, path, size if kind == "file" else None, when, folder, "not readable" if kind == "error" else None))
                    if len(rows) >= AT_A_TIME:
                        yield batch(rows)
                        rows = []
            except Exception as e:  # the folder ends here, the others go on
                rows.append(("error", folder, None, None, folder, f"{type(e).__name__}: {e}"))
    if rows:
        yield batch(rows)


def walk(spark: SparkSession, paths: list[str], recursive: bool = False, pictures_only: bool = True) -> Walked:
    """What lies under the inputs, breadth first.

    Blank inputs are dropped, relative ones made absolute, repeated ones walked
    once; an input may be a file. Each level's folders are a table that tasks
    list, so the driver only counts them; a folder is listed once, whichever
    way it is reached. Links to folders are not followed (an input may be one), links to files are files.
    Names that begin with a point or an underscore are entries like others. A
    folder or file that can't be read is a row of errors and ends nothing else;
    a missing input is one too.
    """
    inputs = list(dict.fromkeys(_normal(p) for p in paths if p and p.strip()))
    kinds: list[tuple[str, int, str]] = []
    for k, p in enumerate(inputs):
        system, inner = opened(p)
        kind = system.get_file_info(inner).type.name
        kinds.append((p.rstrip("/") or "/", k, {"File": "file", "Directory": "folder"}.get(kind, "error")))
    named = spark.createDataFrame(kinds, "full_path string, root int, kind string")
    frontier = cut(named.where("kind = 'folder'").select("full_path", "root", F.lit(0).alias("level")), "frontier")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen, levels, level = frontier, [], 0
    while True:
        todo = frontier.count()
        if not todo:
            break
        found = cut(frontier.select("full_path").repartition(min(todo, 4 * n)).mapInArrow(_listing, ENTRIES), "entries")
        levels.append(found)
        if not recursive:
            break
        level += 1
        children = found.where("kind = 'folder'").join(frontier.select(F.col("full_path").alias("folder"), "root"), "folder").groupBy("full_path").agg(F.min("root").alias("root"))
        frontier = cut(children.join(seen.select("full_path"), "full_path", "left_anti").select("full_path", "root", F.lit(level).alias("level")), "frontier")
        seen = seen.unionByName(frontier)
    alone = named.where("kind = 'file'")
    own = alone.select(F.regexp_replace("full_path", "/[^/]*$", "").alias("full_path")).distinct().repartition(n).mapInArrow(_listing, ENTRIES).where("kind = 'file'").join(alone.select("full_path"), "full_path", "left_semi")
    entries = own
    for f in levels:
        entries = entries.unionByName(f)
    entries = cut(entries, "walked")
    files = entries.where("kind = 'file'")
    if pictures_only:
        files = files.where(is_picture(F.col("full_path")))
    files = files.groupBy("full_path").agg(*[F.min(c).alias(c) for c in ("size_bytes", "modified_at", "folder")])
    errors = entries.where("kind = 'error'").select("full_path", "error").unionByName(named.where("kind = 'error'").select("full_path", F.lit("missing").alias("error"))).distinct()
    return Walked(files.select("full_path", F.regexp_extract("full_path", "([^/]*)$", 1).alias("file_name"), "size_bytes", "modified_at", "folder"), seen, errors)


def in_walk_order(walked: Walked, to: str = "index") -> DataFrame:
    """files with their place from 0 in a walk of one folder after another: by input, level, folder and name; is_root marks those of an input folder."""
    places = walked.folders.select(F.col("full_path").alias("folder"), "root", "level")
    placed = walked.files.join(places, "folder", "left").withColumns({"is_root": F.coalesce(F.col("level") == 0, F.lit(True)), "level": F.coalesce("level", F.lit(0)), "root": F.coalesce("root", F.lit(0))})
    return numbered(placed, [], [F.col("root"), F.col("level"), F.col("folder"), F.col("file_name"), F.col("full_path")], to)


