"""Catalogs of files: scanning folders, and the catalog view of the documents table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvergrain.functions.naming import PICTURE_EXTENSIONS, file_name, is_picture

#: Extensions dealt to the documents: mixed case and one that is no picture, so that filters have work.
DEALT = ("jpg", "png", "webp", "JPEG", "tif", "gif", "bmp", "avif", "heic", "txt", "CR3", "psd")


def absolute(path: str) -> str:
    """A local path from the root; paths with a scheme as they are."""
    return path if "://" in path or path.startswith("file:") else os.path.abspath(path)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the inputs that any of Spark's file systems finds."""
    from pyspark.errors import AnalysisException

    found = []
    for p in paths:
        try:
            spark.read.format("binaryFile").load(p)
            found.append(p)
        except AnalysisException:
            pass
    return found


def scan(spark: SparkSession, paths: list[str], recursive: bool = False, pictures_only: bool = True) -> DataFrame:
    """Records of the files under paths: full_path, file_name, size_bytes, modified_at.

    Blank inputs are dropped, relative ones made absolute, repeated ones read
    once; missing ones don't fail the rest. A file reached from two inputs is
    one record; unreadable files and those that vanish are skipped.
    Only names and sizes are read, never contents.
    """
    inputs = existing(spark, list(dict.fromkeys(absolute(p.strip()) for p in paths if p and p.strip())))
    if not inputs:
        return spark.createDataFrame([], "full_path string, file_name string, size_bytes long, modified_at timestamp")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(inputs).select("path", "length", "modificationTime")
    plain = F.regexp_replace("path", "^file:/*", "/")
    records = found.select(plain.alias("full_path"), file_name(plain).alias("file_name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    if pictures_only:
        records = records.where(is_picture(F.col("full_path")))
    return records.dropDuplicates(["full_path"])


def signatures(records: DataFrame) -> DataFrame:
    """The key by which stored results of a file stay valid: path, size, time."""
    return records.select("full_path", "size_bytes", F.unix_micros(F.col("modified_at").cast("timestamp")).alias("stamp"))


def focus(sorted_first: str | None, inputs: list[tuple[str, bool]]) -> str | None:
    """Which entry is shown first: a single file itself; of several inputs the first file; else the first entry.

    inputs: (path, whether it is an existing file). A file counts even when its type is no picture's.
    """
    files = [p for p, is_file in inputs if is_file]
    return files[0] if files else sorted_first


def load_state(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON state file; missing or unreadable ones are empty."""
    from pyspark.errors import AnalysisException

    try:
        loaded = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
        loaded.limit(1).count()
        return loaded
    except AnalysisException:
        return spark.createDataFrame([], schema)


def dealt_extension(doc_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in DEALT]), (F.pmod(doc_id, F.lit(len(DEALT))) + 1).cast("int"))


def documents_catalog(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The documents table as a catalog of files; more: further columns of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat(F.lit("doc_"), F.format_string("%06d", "doc_id"), F.lit("."), dealt_extension(F.col("doc_id")))
    return docs.select(
        "doc_id",
        name.alias("file_name"),
        F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("full_path"),
        (F.col("n_chars") * 1024).alias("size_bytes"),
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"), F.lit(0))).alias("modified_at"),
        *more,
    )


def documents_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table as review states: doc_id, rating (0 to 5), status."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", (F.col("doc_id") % 6).cast("int").alias("rating"), F.when(F.col("toxic") == 1, "Reject").when(F.col("quality") == 1, "Keep").otherwise("None").alias("status"))


assert len(set(PICTURE_EXTENSIONS)) == 19
