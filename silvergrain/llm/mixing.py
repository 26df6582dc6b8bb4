"""Mixing sources to target weights through a splitting tree, with DataFrame functions only.

Targets: the sources share a budget by weight, no target above a multiple of
its source; the excess is shared again among the rest (water filling).
Quotas: a hash permutes each source's documents; their words in that order are
cut into blocks of equal length, and a target is worth a number of blocks: all
of them in whole rounds, the first ones in the last round.
Tree: the quotas of all sources are split among the output shards. At each node
the left half of the shards gets half of the node's blocks, and how many of each
source these are is a multivariate-hypergeometric draw. A leaf's quota of a
source is the next run of its permuted blocks, so leaves are disjoint and what
they hold together is what the mix takes. Inside a shard rows come in hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.llm.common import cut, words

#: Most words of a block, and the blocks that a shard gets at least (smaller tables have smaller blocks).
BLOCK_WORDS, SHARD_BLOCKS = 1 << 20, 256
#: Rows that share a piece of the permutation, on average at most.
PIECE_ROWS = 1024
#: Most rounds that a source gives.
MOST = 3
#: Logarithms of the first factorials; larger ones follow Stirling's series.
_FIRST = [math.lgamma(k + 1) for k in range(16)]


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = MOST) -> DataFrame:
    """source, source_size -> source, source_size, target.

    Sources are weighted in code-point order, null last, the weights repeating.
    Sources are ordered by how soon they fill up (size by weight); those that
    fill up take most times their size, the rest shares what is left by weight:
    one pass of running sums instead of rounds of resharing. One task sees a
    row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighted = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    by_fill = Window.orderBy(F.col("source_size") / F.col("__w"), F.col("source").isNull(), F.col("source"))
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = weighted.withColumns(
        {
            "__full": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most,
            "__rest": F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
            "__all": F.sum("source_size").over(everything) * share,
        }
    ).withColumn("__part", (F.col("__all") - F.col("__full")) * F.col("__w") / F.col("__rest"))
    # once a source stays below its limit, so do all after it, at the same level
    stays = F.col("__part") <= F.col("source_size") * most
    level = F.first(F.when(stays, (F.col("__all") - F.col("__full")) / F.col("__rest")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(level * F.col("__w"), F.lit(float("inf"))))
    return filled.withColumn("target", target.cast("double")).select("source", "source_size", "target")


def _let(value: Column, f) -> Column:
    """f(value), value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _log_factorial(x: Column) -> Column:
    def series(y: Column) -> Column:
        return (y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y

    return F.when(x < len(_FIRST), F.get(F.array(*[F.lit(v) for v in _FIRST]), x.cast("int"))).otherwise(series(x.cast("double")))


def hypergeometric(everything: Column, kind: Column, drawn: Column, u: Column) -> Column:
    """How many of a kind (kind of everything) are among drawn ones: the law's quantile at u, a uniform number from 0 to 1.

    Counts farther than ten standard deviations and ten from the mean (odds
    below 1e-20) are left out of the inversion.
    """
    log_weight = lambda p, x: -(_log_factorial(x) + _log_factorial(p["k"] - x) + _log_factorial(p["d"] - x) + _log_factorial(p["n"] - p["k"] - p["d"] + x))

    def moments(p: Column) -> Column:
        mean = F.when(p["n"] > 0, p["d"].cast("double") * p["k"] / p["n"]).otherwise(F.lit(0.0))
        return _let(mean, lambda m: F.struct(p["n"].alias("n"), p["k"].alias("k"), p["d"].alias("d"), m.alias("mean"), (10 + 10 * F.sqrt(F.when(p["n"] > 1, m * (1 - p["k"] / p["n"]) * (p["n"] - p["d"]) / (p["n"] - 1)).otherwise(F.lit(0.0)))).alias("far")))

    def bounds(p: Column) -> Column:
        least = F.greatest(F.lit(0).cast("bigint"), p["d"] - (p["n"] - p["k"]), F.floor(p["mean"] - p["far"]))
        most = F.least(p["k"], p["d"], F.ceil(p["mean"] + p["far"]))
        return F.struct(p["n"].alias("n"), p["k"].alias("k"), p["d"].alias("d"), least.alias("least"), most.alias("most"), F.round(p["mean"]).cast("bigint").alias("near"))

    def inverted(p: Column) -> Column:
        # the largest weight is about 1, so sums neither over- nor underflow
        scale = log_weight(p, F.greatest(p["least"], F.least(p["most"], p["near"])))
        weights = _let(scale, lambda c: F.transform(F.sequence(p["least"], p["most"]), lambda x: F.exp(log_weight(p, x) - c)))

        def place(w: Column) -> Column:
            def search(wanted: Column) -> Column:
                step = lambda a, x: _let(a["sum"] + x, lambda t: F.struct(t.alias("sum"), F.when(t < wanted, a["at"] + 1).otherwise(a["at"]).alias("at")))
                return F.aggregate(w, F.struct(F.lit(0.0).alias("sum"), p["least"].alias("at")), step)["at"]

            return _let(u * F.aggregate(w, F.lit(0.0), lambda a, x: a + x), search)

        return F.least(_let(weights, place), p["most"])

    given = F.struct(everything.cast("bigint").alias("n"), kind.cast("bigint").alias("k"), drawn.cast("bigint").alias("d"))
    return _let(_let(_let(given, moments), bounds), inverted)


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, quotas): each leaf's part of the quotas.

    quotas: one row with an array of longs, an entry per source. A node's
    sources are drawn one after the other, each from what the ones before it
    left over. Parts add up exactly, and leaves differ by one block a level at most.
    """
    nodes = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("quotas").cast("array<bigint>").alias("quotas"))
    uniform = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), i), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def draw(a: Column, i: Column) -> Column:
        q = F.get("quotas", i)
        k = hypergeometric(a["rest"], q, a["need"], uniform(i))
        return _let(k, lambda x: F.struct((a["need"] - x).alias("need"), (a["rest"] - q).alias("rest"), F.concat(a["out"], F.array(x)).alias("out")))

    # the expressions are the same at each level
    width = F.col("hi") - F.col("lo")
    middle = (F.col("lo") + F.floor(width / 2)).cast("int")
    total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda a, q: a + q)
    half = F.round(F.col("total") * (F.col("middle") - F.col("lo")) / width).cast("bigint")
    start = F.struct(F.col("half").alias("need"), F.col("total").alias("rest"), F.array().cast("array<bigint>").alias("out"))
    places = F.when(F.size("quotas") > 0, F.sequence(F.lit(0), F.size("quotas") - 1)).otherwise(F.array().cast("array<int>"))
    left = F.aggregate(places, start, draw)["out"]
    right = F.zip_with("quotas", "left", lambda q, x: q - x)
    both = F.array(F.struct("lo", F.col("middle").alias("hi"), F.col("left").alias("quotas")), F.struct(F.col("middle").alias("lo"), "hi", right.alias("quotas")))
    parts = F.explode(F.when(F.col("middle") > F.col("lo"), both).otherwise(F.array(F.struct("lo", "hi", "quotas")))).alias("n")
    for _ in range(max(0, (shards - 1).bit_length())):
        nodes = nodes.withColumns({"total": total, "middle": middle}).withColumn("half", half).withColumn("left", left).select(parts).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def _words_before(sized: DataFrame, rows: int) -> DataFrame:
    """Add __from, the words of the source before a row in the order of its hash.

    Rows are cut into pieces by the upper bits of the hash, pieces into runs of
    pieces, so that no window sees more than a source's runs, a run's pieces or
    a piece's rows.
    """
    bits = max(0, math.ceil(math.log2(max(rows, 1) / PIECE_ROWS)))
    bits += bits % 2
    shift = lambda n: F.shiftrightunsigned(F.shiftrightunsigned("__h", 1), 63 - n) if n else F.lit(0).cast("long")
    cut_up = sized.withColumns({"__run": shift(bits // 2), "__piece": shift(bits)})
    pieces = cut_up.groupBy("__s", "__run", "__piece").agg(F.sum("size").alias("__size"))
    runs = pieces.groupBy("__s", "__run").agg(F.sum("__size").alias("__size"))
    upto = lambda *by: F.coalesce(F.sum("__size").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_runs = runs.select("__s", "__run", upto("__s", "__run").alias("__a"))
    starts = pieces.withColumn("__b", upto("__s", "__run", "__piece")).join(of_runs, ["__s", "__run"]).select("__s", "__run", "__piece", (F.col("__a") + F.col("__b")).alias("__start"))
    inside = F.sum("size").over(Window.partitionBy("__s", "__run", "__piece").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return cut_up.withColumn("__upto", inside).join(starts, ["__s", "__run", "__piece"]).withColumn("__from", F.col("__start") + F.col("__upto") - F.col("size")).drop("__run", "__piece", "__start", "__upto")


def mix(docs: DataFrame, seed: int = 17, shards: int = 16, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, size, source_size, target, taken, copies, shards, place and the columns of carry.

    size counts words. A row is used in copies (0 to MOST) rounds, in the output
    shards listed in shards; in the last round, the source's document at the
    border gives only as many words as are left, so that a source's taken words
    miss its target by less than one. Rows without words are used as often as
    the whole rounds say; very long texts are one row like others and go to the
    block in which they start. Null texts have no words, null sources are one
    source, the last. Repeated rows count and return as often as they come; rows
    alike in id and text are told apart by no column and may swap copies. Other
    columns are ignored, whatever their names. The same seed gives the same mix.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    named = F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit(""))
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.size(words(F.col(text_column))).cast("long").alias("size"), F.col(source_column).alias("source"), named.alias("__s"), F.xxhash64(F.col(id_column), F.col(text_column), F.lit(seed)).alias("__h"), *(F.col(c).alias(f"__carry{k}") for k, c in enumerate(carry)))
    sized = cut(narrow, "sized")
    sources = cut(sized.groupBy("source", "__s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows")), "sources")
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__rows"), F.lit(0))).first()
    block = min(BLOCK_WORDS, max(1, -(-int(whole[0] * share) // (shards * SHARD_BLOCKS))))
    goals = targets(sources.select("source", "source_size"), weights, share).withColumn("__s", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source")
    part_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumns({"__rounds": F.least(F.floor(part_of), F.lit(MOST)).cast("long"), "__blocks": F.ceil(F.col("source_size") / block)})
    goals = goals.withColumn("__more", F.when(F.col("__rounds") < MOST, F.greatest(F.floor(F.col("target") - F.col("__rounds") * F.col("source_size")), F.lit(0))).otherwise(F.lit(0)))
    goals = cut(goals.withColumn("__quota", F.col("__rounds") * F.col("__blocks") + F.ceil(F.col("__more") / block)).withColumn("__i", F.row_number().over(Window.orderBy("__s")) - 1), "goals")
    quotas = goals.agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__quota"))), lambda x: x["__quota"]).alias("quotas"))  # an entry per source
    leaves = cut(splitting_tree(quotas, shards, seed), "leaves")
    # each source's leaves as running sums of their quotas: a block's place in the permutation finds its leaf
    by_source = leaves.select("shard", F.posexplode("quotas").alias("__i", "q")).groupBy("__i").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "q"))), lambda x: x["q"]).alias("__q"))
    ends = F.transform("__q", lambda q, i: F.aggregate(F.slice("__q", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    dealt = cut(goals.join(by_source, "__i", "left").withColumn("__ends", ends).select("__s", "source_size", "target", "__rounds", "__blocks", "__more", "__ends"), "dealt")
    rows = _words_before(sized, whole[1]).join(dealt, "__s")
    at = F.greatest(F.least(F.floor(F.col("__from") / block), F.col("__blocks") - 1), F.lit(0))
    last = F.greatest(F.least(F.col("__more") - F.col("__from"), F.col("size")), F.lit(0))
    rows = rows.withColumns({"__at": at, "__last": last})
    drawn = F.when(F.col("__rounds") + (F.col("__last") > 0).cast("long") > 0, F.sequence(F.lit(0).cast("long"), F.col("__rounds") + (F.col("__last") > 0).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    leaf = lambda r: F.size(F.filter("__ends", lambda e: e <= r * F.col("__blocks") + F.col("__at")))
    # a draw counts if a leaf holds its block
    held = F.filter(F.transform(drawn, lambda r: F.struct(r.alias("round"), leaf(r).alias("shard"))), lambda d: d["shard"] < shards)
    rows = rows.withColumn("__held", held)
    taken = F.aggregate("__held", F.lit(0).cast("long"), lambda a, d: a + F.when(d["round"] < F.col("__rounds"), F.col("size")).otherwise(F.col("__last")))
    return rows.select(F.col("doc_id").alias(id_column), "size", "source_size", "target", taken.alias("taken"), F.size("__held").alias("copies"), F.transform("__held", lambda d: d["shard"]).alias("shards"), F.xxhash64("__h", F.lit(seed + 1)).alias("place"), *(F.col(f"__carry{k}").alias(c) for k, c in enumerate(carry)))
