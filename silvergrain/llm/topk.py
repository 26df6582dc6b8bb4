"""Exact top-k by inner product through a pivot-distance index.

Vectors get one more component so that all have the same length; the k largest
inner products are then the k nearest vectors. Every vector is keyed by its
nearest pivot and the distance r to it, and each pivot's distances are cut into
annuli. A query first looks into the annuli around its own place, which bounds
its k-th distance by D; after that only annuli with |d(query, pivot) - r| <= D
can hold better rows, and inside them only that slice of the sorted distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.llm.common import cut

#: Pivots grow with the root of the number of vectors, between these bounds.
PIVOTS = (24, 2048)
#: Rows that the pivots are fitted on, and rows for each pivot if those are more; every row is indexed.
SAMPLE, PER_PIVOT = 4096, 16
#: Rows of one annulus; a table has CELLS annuli at most (besides one for each pivot), larger ones beyond that.
BLOCK, CELLS = 8192, 1 << 17
#: Queries that one task holds against one annulus.
QUERIES = 1 << 16
#: Relative and absolute slack of computed distances against rounding.
SLACK = 1e-7


def quantised(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Ragged lists of longs as a matrix of longs, short rows filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _lifted(m: np.ndarray, most: float) -> np.ndarray:
    m = m.astype(float)
    return np.hstack([m, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", m, m), 0))[:, None]])


def _fit(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """A few rounds of k-means on the distinct sample rows."""
    rows = np.unique(sample, axis=0)
    pivots = rows[np.random.default_rng(seed).permutation(len(rows))[:count]]
    for _ in range(5):
        near = np.argmin(_squared(rows, pivots), 1)
        pivots = np.array([rows[near == k].mean(0) if (near == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def best_rows(m: np.ndarray, rough: np.ndarray, slack: np.ndarray | None, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[list[int], list[int]]:
    """(ids, scores) of the k rows of m with the largest inner product with q, ties to the smaller id, rows called own left out.

    rough: the products in floats; slack: bounds of their rounding, None where
    they are exact. With slack, floats only choose the rows that rounding can't
    rule out; these are scored by whole numbers, held at a long's limits.
    """
    rough = np.where(ids == own, -np.inf, rough)
    near = rough > -np.inf
    if near.sum() > k:
        kth = np.partition(rough, len(rough) - k)[len(rough) - k]
        near &= rough >= kth if slack is None else rough + slack >= min(kth - slack.max(), 2.0**62)
    at = np.flatnonzero(near)
    if slack is None:
        scores = rough[at].astype(np.int64).tolist()
    else:
        whole = q.tolist()
        scores = [max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole, row, strict=True)))) for row in m[at].tolist()]
    found = ids[at].tolist()
    order = sorted(range(len(scores)), key=lambda j: (-scores[j], found[j]))[:k]
    return [found[j] for j in order], [scores[j] for j in order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer inner products with other rows.

    queries: rows of vectors (same columns); of a query id with several vectors
    the least one asks. A row is never its own candidate: rows with the query's
    id are left out, so repeated rows of one id aren't each other's; otherwise
    repeated rows count as often as they come. Ties go to the smaller id. Rows
    with a null id, or a null vector or component or one that isn't finite, take
    no part; missing components of a shorter vector count as zero. Products and
    sums are whole numbers of any size; components beyond a long after scaling
    are held at its limits, and so are scores, before they are ranked. Long vectors are
    worked on whole, other columns ignored. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    takes_part = F.coalesce(F.col(id_column).isNotNull() & F.forall(vector_column, finite), F.lit(False))
    ready = lambda df: df.where(takes_part).select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector_column), scale).alias("v"))
    base = cut(ready(vectors), "vectors")
    asked = cut(ready(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, width, most = base.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(length)).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not total:
        return empty
    far = asked.agg(F.max(F.size("v"))).first()[0]
    width, most = max(width, far or 0, 1), float(most) + 1
    count = min(max(round(total**0.5 / 8), PIVOTS[0]), PIVOTS[1])
    sampled = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(SAMPLE, PER_PIVOT * count)).toArrow()
    pivots = _fit(_lifted(_matrix(sampled["v"], width), most), count, seed)

    def keyed(batches):
        for b in batches:
            d = np.sqrt(_squared(_lifted(_matrix(b.column(1), width), most), pivots))
            p = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], names=["id", "v", "p", "r"])

    index = cut(base.mapInArrow(keyed, "id long, v array<long>, p int, r double"), "index")
    rows = max(BLOCK, -(-total // CELLS))
    sizes = {r["p"]: r["n"] for r in index.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per pivot
    fine = min(1024, max(-(-n // rows) for n in sizes.values()))
    quantiles = [j / fine for j in range(1, fine)]
    cuts: list[tuple[int, list[float]]] = [(p, []) for p in sizes]
    if quantiles:
        found = index.groupBy("p").agg(F.percentile_approx("r", quantiles, 10000).alias("e")).collect()  # fine numbers per pivot
        # of the finest edges each pivot keeps as many as its rows need
        cuts = [(r["p"], sorted({r["e"][min(fine - 1, -(-j * fine // parts)) - 1] for parts in [-(-sizes[r["p"]] // rows)] for j in range(1, min(parts, fine))})) for r in found]
    edges = spark.createDataFrame(pa.table({"p": pa.array([c[0] for c in cuts], pa.int32()), "edges": pa.array([c[1] for c in cuts], pa.list_(pa.float64()))}))
    ringed = index.join(F.broadcast(edges), "p").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("r")))).drop("edges")  # a row per pivot
    known = ringed.groupBy("p", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).orderBy("p", "ring").collect()  # CELLS rows and PIVOTS at most
    cells = np.array([(c["p"], c["n"], c["low"], c["high"]) for c in known])
    columns = {"p": [c["p"] for c in known], "ring": [c["ring"] for c in known], "cell": range(len(known)), "parts": [-(-c["n"] // rows) for c in known]}
    names = spark.createDataFrame(pa.table({c: pa.array(v, pa.int32()) for c, v in columns.items()}))
    # vectors at one distance can't be told apart by it: an annulus that holds too many is cut by id
    data = ringed.join(F.broadcast(names), ["p", "ring"]).select("id", "v", "r", "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))  # a row per annulus

    # annuli lie by pivot and distance: a query's ones of a pivot are a run, found by two binary searches in one line of pivots
    of, held = cells[:, 0].astype(int), cells[:, 1]
    end = float(cells[:, 3].max()) * (1 + SLACK) + SLACK
    span, slip = end * 2, end * 1e-9
    lows, highs = of * span + cells[:, 2], of * span + cells[:, 3]
    present = np.unique(of)
    opens = np.searchsorted(of, present)
    closes = np.append(opens[1:], len(of))

    def placed(batches, first: bool):
        """A row for each query and annulus that it looks into; low, high: the slice of distances to the pivot."""
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                q = _matrix(part.column(1), width).astype(float)
                d = np.sqrt(_squared(np.hstack([q, np.zeros((len(q), 1))]), pivots))
                norm = (q * q).sum(1)
                reach = np.full(len(q), np.inf)
                dp, at = d[:, present], present * span
                if first:
                    # of each pivot the annulus next to the query, of the pivots as many as hold k rows
                    near = np.clip(np.searchsorted(highs, at + np.clip(dp, 0, end)), opens, closes - 1)
                    gap = np.maximum(np.maximum(cells[near, 2] - dp, dp - cells[near, 3]), 0)
                    order = np.argsort(gap, axis=1, kind="stable")
                    rows_of = np.take_along_axis(held[near], order, 1)
                    use = np.zeros(gap.shape, bool)
                    np.put_along_axis(use, order, np.cumsum(rows_of, 1) - rows_of < k + 1, 1)
                    i, c = np.nonzero(use)
                    j = near[i, c]
                else:
                    best = part.column(2).to_numpy(zero_copy_only=False)
                    reach = np.sqrt(np.maximum(norm + most - 2 * np.nan_to_num(best, nan=-np.inf), 0)) * (1 + SLACK) + SLACK * np.sqrt(most + norm)
                    start = np.searchsorted(highs, at + np.clip(dp - reach[:, None] - slip, 0, end), "left")
                    stop = np.searchsorted(lows, at + np.clip(dp + reach[:, None] + slip, 0, end), "right")
                    n = np.maximum(stop - start, 0).ravel()
                    i = np.repeat(np.repeat(np.arange(len(q)), len(present)), n)
                    j = np.repeat(start.ravel(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(d[i, of[j]] - reach[i]), pa.array(d[i, of[j]] + reach[i])], names=["query_id", "q", "cell", "low", "high"])

    def searched(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows) and len(wanted):
            rows = rows.sort_by("r")
            r, ids, m = rows["r"].to_numpy(), rows["id"].to_numpy(), _matrix(rows["v"], width)
            queries, low, high, q = wanted["query_id"].to_numpy(), wanted["low"].to_numpy(), wanted["high"].to_numpy(), _matrix(wanted["q"], width)
            a, z = np.searchsorted(r, low, "left"), np.searchsorted(r, high, "right")
            mf, qf = m.astype(float), q.astype(float)
            exact = width * float(np.abs(mf).max()) * float(np.abs(qf).max()) < 2**52
            for lo in range(0, len(q), 64):
                rough = qf[lo : lo + 64] @ mf.T
                # the rounding of a sum and of the conversions
                slack = None if exact else (width + 4) * 2.0**-52 * (np.abs(qf[lo : lo + 64]) @ np.abs(mf).T)
                for s, name in enumerate(queries[lo : lo + 64].tolist()):
                    part = slice(a[lo + s], z[lo + s])
                    found, scores = best_rows(m[part], rough[s, part], None if exact else slack[s, part], ids[part], q[lo + s], name, k)
                    out["query_id"] += [name] * len(found)
                    out["vec_id"] += found
                    out["score"] += scores
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    def search(first: bool, wanted: DataFrame) -> DataFrame:
        looks = wanted.mapInArrow(lambda b: placed(b, first), "query_id long, q array<long>, cell int, low double, high double")
        # an annulus that many queries look into goes to as many tasks as they need
        turns = cut(looks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns")).join(names.select("cell", "parts"), "cell"), "turns")
        asking = looks.join(F.broadcast(turns), "cell").withColumn("turn", F.pmod(F.xxhash64("query_id"), "turns").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))  # a row per annulus
        blocks = data.join(F.broadcast(turns.select("cell", "turns")), "cell").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))  # a row per annulus
        key = ["cell", "part", "turn"]
        return blocks.select("id", "v", "r", *key).groupBy(*key).cogroup(asking.select("query_id", "q", "low", "high", *key).groupBy(*key)).applyInArrow(searched, "query_id long, vec_id long, score long")

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = search(True, asked).withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("best"))
    bounded = cut(asked.join(near, "id", "left").select("id", "v", "best"), "bounds")
    found = search(False, bounded)
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
