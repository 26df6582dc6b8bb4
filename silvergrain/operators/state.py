"""Keyed states: results kept by file signature, trimmed by recency, count or bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.operators.ordering import running_sums

KEY = ["full_path", "size_bytes", "stamp"]


def get_or_compute(wanted: DataFrame, state: DataFrame, compute, value: str = "value") -> DataFrame:
    """The value of each signature: kept ones as they are, the others from compute (once per distinct signature)."""
    keys = wanted.select(*KEY).distinct()
    kept = keys.join(state.select(*KEY, value), KEY)
    return kept.unionByName(compute(keys.join(state.select(*KEY), KEY, "left_anti")).select(*KEY, value))


def without_stale(state: DataFrame, by: str = "written_at", *kind: str) -> DataFrame:
    """Of each path (and kind) only the newest signature."""
    newest = Window.partitionBy(*kind, "full_path").orderBy(F.desc(by), *[F.desc(c) for c in KEY[1:]])
    return state.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def newest(state: DataFrame, most: int, by: str = "accessed", key: str = "key", pinned: str | None = None) -> DataFrame:
    """The most newest keys; a pinned one goes first. A bounded top-k, not a sort of everything."""
    last = state.groupBy(key).agg(F.max(by).alias(by), *([F.max(pinned).alias(pinned)] if pinned else []))
    order = [*([F.desc(pinned)] if pinned else []), F.desc(by), F.col(key)]
    return last.orderBy(*order).limit(most)


def within_budget(state: DataFrame, budget: int, bucket: str = "bucket", by: str = "accessed", size: str = "bytes", protected: str | None = None) -> DataFrame:
    """Newest entries of each bucket whose bytes together stay within budget; larger ones are never kept.

    protected: a boolean column; such an entry is kept whatever it takes.
    """
    fits = state.where(F.col(size) <= budget) if protected is None else state.where((F.col(size) <= budget) | F.col(protected))
    order = [*([F.desc(protected)] if protected else []), F.desc(by), F.col("key")]
    keep = F.col("running") <= budget if protected is None else (F.col("running") <= budget) | F.col(protected)
    return running_sums(fits, [bucket], order, size, "running").where(keep)


def best_resolution(state: DataFrame, requested: int) -> DataFrame:
    """Per path the largest stored edge, and whether it serves the request."""
    best = state.groupBy("full_path").agg(F.max("edge").alias("edge"))
    return best.withColumn("hit", F.col("edge") >= requested)


def upsert_review(states: DataFrame, changes: DataFrame, key: str = "full_path") -> DataFrame:
    """States after changes (key, rating, status, changed_at): the last change of a key wins, ratings stay in 0 to 5, (0, None) deletes."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("rating", "status"), "changed_at").alias("__c"))
    both = states.select(key, F.col("rating").alias("__r"), F.col("status").alias("__s")).join(last, key, "full")
    out = both.select(key, F.greatest(F.least(F.coalesce("__c.rating", "__r"), F.lit(5)), F.lit(0)).alias("rating"), F.coalesce("__c.status", "__s").alias("status"))
    return out.where((F.col("rating") > 0) | (F.col("status") != "None"))


def limits(mode: str) -> dict[str, int]:
    """Entries kept in each state."""
    # Text, hash and dimension states by mode.
    held = {"saver": (2048, 4096, 2048), "balanced": (4096, 8192, 4096), "fast": (8192, 16384, 8192)}
    return dict(zip(("text", "hash", "dimensions"), held[mode], strict=True))


def newest_results(results: DataFrame, most: int = 24, by: str = "saved_at") -> DataFrame:
    """Kept results by signature, mode and threshold: the last one saved of each key, and of these the most newest."""
    key = ["signature", "mode", "threshold"]
    rest = [c for c in results.columns if c not in key and c != by]
    last = results.groupBy(*key).agg(F.max(F.struct(by, *rest)).alias("__r")).select(*key, "__r.*")
    return last.orderBy(F.desc(by), *key).limit(most)
