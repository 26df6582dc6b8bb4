"""Shards of near equal bytes by k-d tree partitioning.

The points are the distinct texts with their metadata (length, language,
source). A node is split along the dimension in which it is widest, at the
weighted median, until each leaf is one shard. The median is found from sums
of bytes in histograms of fixed size, refined twice; points alike in the
dimension are ordered by hash, so that no run of equal values is too heavy.
Equal texts stay together, but for texts whose copies exceed a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.common import cut, with_ranks

#: Bits of a refinement: a node's histogram has 2**BITS bins.
BITS = 12
#: Texts whose copies hold more than this part of a shard are placed before the tree is grown.
HEAVY = 1 / 64
DIMENSIONS = ("d0", "d1", "d2")


def _code(dim: Column) -> Column:
    """Order along a dimension: its coordinate (0 to 1) in BITS bits, then a hash in 2 * BITS bits."""
    coordinate = F.least(F.floor(dim * (1 << BITS)), F.lit((1 << BITS) - 1))
    return coordinate * (1 << 2 * BITS) + F.pmod(F.col("h"), F.lit(1 << 2 * BITS))


def _case(values: dict[int, object], default: object) -> Column:
    """A value for each node, as literals: at most shards of them."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("node")), F.lit(default))


def _splits(points: DataFrame, nodes: dict[int, tuple[int, int]], room: list[float]) -> tuple[dict[int, str], dict[int, int]]:
    """The dimension and the code at which each node is split."""
    spans = points.groupBy("node").agg(*(F.min(d).alias(f"a{d}") for d in DIMENSIONS), *(F.max(d).alias(f"z{d}") for d in DIMENSIONS), F.sum("bytes").alias("bytes")).collect()
    widest = {r["node"]: max(DIMENSIONS, key=lambda d: r[f"z{d}"] - r[f"a{d}"]) for r in spans if r["node"] in nodes}
    wanted = {}
    for r in spans:
        if r["node"] in nodes:
            lo, hi = nodes[r["node"]]
            mid = (lo + hi) // 2
            wanted[r["node"]] = float(r["bytes"]) * sum(room[lo:mid]) / max(sum(room[lo:hi]), 1e-9)
    coded = points.where(F.col("node").isin(*wanted)).withColumn("code", _code(F.coalesce(*[F.when(_case({n: k for n, k in widest.items()}, "") == d, F.col(d)) for d in DIMENSIONS])).cast("long"))
    at = dict.fromkeys(wanted, 0)
    for depth in (2, 1, 0):
        width = 1 << depth * BITS
        inside = F.col("code").between(_case(at, 0), _case({n: v + (width << BITS) - 1 for n, v in at.items()}, 0)) if depth < 2 else F.lit(True)
        bins = coded.where(inside).groupBy("node", F.floor(F.col("code") / width).alias("bin")).agg(F.sum("bytes").alias("bytes")).collect()  # shards * 2**BITS rows at most
        per: dict[int, list[tuple[int, int]]] = {n: [] for n in wanted}
        for r in bins:
            per[r["node"]].append((r["bin"], r["bytes"]))
        for n, rows in per.items():
            for k, weight in sorted(rows):
                at[n] = k * width
                if weight > wanted[n]:
                    break
                wanted[n] -= weight
                at[n] = (k + 1) * width
            else:
                continue
    return widest, at


def shards(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot (gapless from 0 in its shard).

    size: UTF-8 bytes plus one, so that null and empty texts (equal to each
    other here) weigh one. Null languages and sources are values of their own.
    Copies of one text that exceed a shard are dealt by id instead. Rows alike
    in id and text may swap slots. Of very long texts only size and hashes are
    moved. Other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(1 << 20)) / float(1 << 20)
    rows = cut(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            place(lang_column).alias("d1"),
            place(source_column).alias("d2"),
        ),
        "rows",
    )
    texts = rows.groupBy("h", "text_crc32", F.col("size").alias("each")).agg(F.sum("size").alias("bytes"), F.min("d1").alias("d1"), F.min("d2").alias("d2"))
    texts = cut(texts, "texts")
    total = texts.agg(F.sum("bytes")).first()[0] or 0
    goal = total / shards
    room = [float(goal)] * shards
    heavy = {}
    # each holds more than HEAVY of a shard: at most shards / HEAVY of them
    for r in sorted(texts.where(F.col("bytes") > goal * HEAVY).collect(), key=lambda r: (-r["bytes"], r["h"])):
        s = max(range(shards), key=lambda k: (room[k], -k))
        if r["bytes"] <= room[s]:
            heavy[r["h"], r["text_crc32"], r["each"]] = s
            room[s] -= r["bytes"]
    kept = docs.sparkSession.createDataFrame([(*k, v) for k, v in heavy.items()], "h long, text_crc32 long, each long, fixed int")
    key = ["h", "text_crc32", "each"]
    fixed = texts.join(F.broadcast(kept), key, "left")  # at most shards / HEAVY rows
    apart = F.col("fixed").isNull() & (F.col("bytes") > goal * HEAVY)
    # too large for any shard: its rows go into the tree one by one
    large = fixed.where(apart).select(*key, F.lit(True).alias("apart"))
    by_row = rows.withColumn("each", F.col("size")).join(F.broadcast(large), key).select(F.xxhash64("doc_id", "h").alias("h"), "text_crc32", "each", F.col("size").alias("bytes"), "d1", "d2", F.col("doc_id").alias("row"))
    free = fixed.where(F.col("fixed").isNull() & ~apart).select("h", "text_crc32", "each", "bytes", "d1", "d2", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("row")).unionByName(by_row)
    points = cut(free.withColumn("d0", F.log1p(F.col("each").cast("double")) / 16).withColumn("node", F.lit(0)), "points")
    nodes = {0: (0, shards)}
    while any(hi - lo > 1 for lo, hi in nodes.values()) and total:
        open_nodes = {n: v for n, v in nodes.items() if v[1] - v[0] > 1}
        widest, at = _splits(points, open_nodes, room)
        coordinate = F.coalesce(*[F.when(_case(widest, "") == d, F.col(d)) for d in DIMENSIONS], F.lit(0.0))
        right = _code(coordinate).cast("long") >= _case(at, 1 << 62)
        middle = {n: (lo + hi) // 2 for n, (lo, hi) in open_nodes.items()}
        points = cut(points.withColumn("node", F.when(F.coalesce(right, F.lit(False)), _case(middle, 0)).otherwise(F.col("node")).cast("int")), "nodes")
        nodes = {k: v for n, (lo, hi) in nodes.items() for k, v in ([(n, (lo, middle[n])), (middle[n], (middle[n], hi))] if n in middle else [(n, (lo, hi))])}
    by_text = points.where(F.col("row").isNull()).select(*key, F.col("node").alias("shard")).unionByName(kept.withColumnRenamed("fixed", "shard"))
    one = rows.withColumn("each", F.col("size")).join(by_text, key, "left")
    rest = points.where(F.col("row").isNotNull()).select(F.col("h").alias("rh"), F.col("node").alias("own")).dropDuplicates(["rh"])
    dealt = one.withColumn("rh", F.xxhash64("doc_id", "h"))
    dealt = dealt.join(rest, "rh", "left").withColumn("shard", F.coalesce("shard", "own", F.lit(0))) if rest.limit(1).count() else dealt.withColumn("shard", F.coalesce("shard", F.lit(0)))
    out = cut(dealt.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")), "dealt")
    return with_ranks(out, ["shard"], ["doc_id", "text_crc32"], "slot").withColumnRenamed("doc_id", id_column)
