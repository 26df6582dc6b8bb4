"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from silvergrain.sources.staging import cut, outside, shared_dir, staged  # noqa: F401

#: A word is a maximal run of characters that are neither a space nor 0x09-0x0D.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def with_ranks(df: DataFrame, group: list[str], order: list[str], to: str, pieces: int | None = None) -> DataFrame:
    """Add a gapless rank from 0 inside each group without sorting a whole group in one task.

    A group is cut into hash pieces; each piece is numbered on its own and
    shifted by the sizes of the pieces before it. The ranks are stable for a
    given table and number of pieces: order must name columns that tell the
    rows of a group apart (rows alike in them may swap ranks).
    """
    n = pieces or partitions(df.sparkSession)
    piece = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(n)).cast("int")
    cut_up = df.withColumn("__piece", piece)
    sizes = cut_up.groupBy(*group, "__piece").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    own = Window.partitionBy(*group, "__piece").orderBy(*order)
    numbered = cut_up.withColumn("__own", F.row_number().over(own) - 1)
    same = [numbered[c].eqNullSafe(starts[c]) for c in [*group, "__piece"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return numbered.join(starts, on, "left").select(*[numbered[c] for c in df.columns], (numbered["__own"] + starts["__start"]).cast("long").alias(to))


def broadcast_if_small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df with a broadcast hint where it has no more than most rows (counted), else as it is: the join then shuffles, and splits skewed keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def long_type(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]
