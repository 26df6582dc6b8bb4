"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as
Parquet and read again as the docs of the next one. Rows are told apart by
hashes of what they hold rather than by their ids, so that null and repeated ids
have a defined result in each stage. Other columns than doc_id, text, lang,
source and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvergrain.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from silvergrain.llm.common import cut, outside, partitions, staged, table

#: Names of columns that stages add and take away again.
K1, K2, KEPT, ID, SAME, SPANS = "__stage_key_1", "__stage_key_2", "__stage_text", "__stage_id", "__stage_same", "__stage_spans"


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Add 128 bits of hash over columns; which of them are null counts as well. Columns with maps count as their JSON."""
    whole = [F.col(f"`{c}`") for c in columns]
    cols = [c if _hashable(docs.schema[name].dataType) else F.to_json(F.struct(c.alias("c"))) for name, c in zip(columns, whole, strict=True)]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in whole])
    return docs.withColumns({K1: F.xxhash64(*cols, nulls), K2: F.xxhash64(F.lit(29), *cols, nulls)})


def _cut_outside(df: DataFrame, label: str) -> DataFrame:
    """What a stage's result still reads; the tables that led there go with their run."""
    with outside():
        return cut(df, label)


def _shown(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or stand out of their language and source go.

    A verdict depends on text, language and source alone: rows alike in these
    share it, whatever their ids; null ids make no difference. Null and empty
    texts go.
    """
    with staged(spark):
        fit = _cut_outside(quality.estimates(docs), "estimates")
    return quality.kept_documents(docs, fit)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, and of the rows that repeat its id one.

    Of those the one of least hash stays. Rows with a null id have no group: of
    equal texts without an id one row stays, of least hash again.
    """
    with staged(spark):
        groups = jaccard_join.near_duplicates(docs)
        others = _cut_outside(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "copies")
    named = F.when(F.col("doc_id").isNull(), F.concat_ws(":", F.xxhash64("text"), F.xxhash64(F.lit(29), "text")))
    # ids that come again are found without whole documents, which are not written here
    again = cut(docs.select("doc_id", named.alias(KEPT)).join(others, "doc_id", "left_anti").groupBy("doc_id", KEPT).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(ID), F.col(KEPT).alias(SAME)), "repeated")
    left = docs.join(others, "doc_id", "left_anti")
    if again.limit(1).count() == 0:
        return _shown(left, docs)
    left = _keyed(left, *docs.columns).withColumn(KEPT, named)
    same = F.col("doc_id").eqNullSafe(F.col(ID)) & F.col(KEPT).eqNullSafe(F.col(SAME))
    once = left.join(again, same, "left_semi").groupBy("doc_id", KEPT).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(K1, K2)).alias(SAME)).select(f"{SAME}.*")
    return _shown(left.join(again, same, "left_anti"), docs).unionByName(_shown(once, docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut out; documents of which nothing is left go.

    Rows alike in id and text lose the same. Rows with a null id stay as they
    are. n_chars, if there is such a column, follows the text.
    """
    with staged(spark):
        found = suffix_dedup.dedup(docs, with_spans=True).where("doc_id is not null and n_removed > 0")
        spans = _cut_outside(found.groupBy("doc_id", "text_hash", "text_hash_2").agg(F.first("spans").alias(SPANS)), "spans")
    keyed = docs.withColumns({K1: suffix_dedup.text_hash(F.col("text")), K2: suffix_dedup.text_hash(F.col("text"), 2)})
    met = keyed.join(spans.withColumnsRenamed({"text_hash": K1, "text_hash_2": K2}), ["doc_id", K1, K2], "left")
    shortened = met.withColumn(KEPT, suffix_dedup.without_spans(F.when(F.col(SPANS).isNotNull(), F.col("text")), F.col(SPANS))).where(F.col(KEPT).isNull() | (F.trim(KEPT) != ""))
    changed = {"text": F.coalesce(KEPT, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(KEPT).isNull(), F.col("n_chars")).otherwise(F.length(KEPT)).cast(docs.schema["n_chars"].dataType)
    return _shown(shortened.withColumns(changed), docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows lie by output shard, in the mix's order.

    A document that the last round cuts is used whole. Rows alike in all columns
    are one that is used as often as all of them. Null ids make no difference.
    """
    keyed = _keyed(docs, *docs.columns)
    with staged(spark):
        drawn = mixing.mix(keyed, carry=(K1, K2))
        dealt = _cut_outside(drawn.select(K1, K2, "place", F.explode("shards").alias("__stage_shard")).groupBy(K1, K2, "__stage_shard").agg(F.min("place").alias("__stage_place"), F.count(F.lit(1)).alias("__stage_times")), "drawn")
    if keyed.groupBy(K1, K2).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        keyed = keyed.dropDuplicates([K1, K2])
    used = keyed.join(dealt, [K1, K2]).withColumn("__stage_copy", F.explode(F.sequence(F.lit(1), F.col("__stage_times").cast("int"))))
    # a shard is spread over as many tasks as there are for it; within them its rows are in the mix's order
    n = partitions(spark)
    tasks = F.pmod("__stage_place", F.lit(max(1, n // 16)))
    return _shown(used.repartition(n, "__stage_shard", tasks).sortWithinPartitions("__stage_shard", "__stage_place", "__stage_copy"), docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens.

    Null texts are empty; null and repeated ids are packed as often as they come.
    """
    import public_tokenizers  # where it is missing, only this stage can't run

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", target_mix),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL expresses the robust estimates, the components or the packing; tests/llm holds run() against plain versions.
ORACLE_SQL = None
