"""Joins of a catalog with states, selections and path maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_review(catalog: DataFrame, states: DataFrame, key: str = "full_path") -> DataFrame:
    """Rating and status of each entry; (0, None) without a state."""
    return catalog.join(states, key, "left").withColumns({"rating": F.coalesce("rating", F.lit(0)), "status": F.coalesce("status", F.lit("None"))})


def selected(catalog: DataFrame, keys: DataFrame, key: str = "full_path") -> DataFrame:
    return catalog.join(keys.select(key).distinct(), key, "left_semi")


def not_selected(catalog: DataFrame, keys: DataFrame, key: str = "full_path") -> DataFrame:
    return catalog.join(keys.select(key).distinct(), key, "left_anti")


def remapped(catalog: DataFrame, moves: DataFrame, order: str = "full_path") -> DataFrame:
    """Paths after moves (old_path, new_path); if two end alike, the first in order stays."""
    moved = catalog.join(moves, catalog["full_path"] == moves["old_path"], "left").withColumn("__to", F.coalesce("new_path", "full_path"))
    # the smallest of each path by partial aggregates: very many moves to one path are no one task's
    one = moved.groupBy("__to").agg(F.min_by(F.struct(*catalog.columns), F.struct(order, "full_path")).alias("__first"))
    return one.select(*[F.col("__to").alias("full_path") if c == "full_path" else F.col(f"__first.`{c}`").alias(c) for c in catalog.columns])


def with_fallback(keys: DataFrame, visible: DataFrame, everything: DataFrame, key: str, value: str) -> DataFrame:
    """value of each key: from the visible rows, else from all; 'hidden' tells which."""
    a = visible.select(key, F.col(value).alias("__a"))
    b = everything.select(key, F.col(value).alias("__b"))
    return keys.join(a, key, "left").join(b, key, "left").select(*keys.columns, F.coalesce("__a", "__b").alias(value), (F.col("__a").isNull() & F.col("__b").isNotNull()).alias("hidden"))


def sizes_of(paths: DataFrame, catalog: DataFrame) -> DataFrame:
    return paths.join(catalog.select("full_path", "size_bytes"), "full_path", "left").withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))


def same_order(a: DataFrame, b: DataFrame, key: str, rank: str) -> DataFrame:
    """same: whether both hold the same keys at the same ranks."""
    both = a.select(rank, F.col(key).alias("__a")).join(b.select(rank, F.col(key).alias("__b")), rank, "full")
    return both.agg(F.coalesce(F.bool_and(F.col("__a").eqNullSafe(F.col("__b"))), F.lit(True)).alias("same"))
