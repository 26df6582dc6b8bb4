"""Hard negatives by norm-bucketed search.

Candidates are sorted by length (longest first) and cut into buckets of equal
size. An inner product is at most the product of both lengths, so a bucket whose
longest row times the anchor's length stays below what the anchor still wants
can be left out, and with it all later ones: what an anchor asks is a prefix of
the buckets. It wants scores from its window's lower limit on, and once a window
is full, from its running k-th score on. Anchors ask in turns, a few buckets first
and sixteen times as many each next turn, so that later turns know good limits.
Positives are found in the same way, with an open window among rows of the
anchor's label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silvergrain.llm.common import cut
from silvergrain.llm.topk import _matrix as matrix
from silvergrain.llm.topk import quantised
from silvergrain.operators.ordering import numbered

#: Rows of a bucket; a table has BUCKETS at most, larger ones beyond that.
BLOCK, BUCKETS = 8192, 1 << 17
#: Anchors that one task holds against one bucket.
ANCHORS = 1 << 14
#: How many more buckets each turn asks.
GROWTH = 16
#: Relative slack of computed lengths against rounding.
SLACK = 1e-9
#: The limits of a long, at which scores are held.
LEAST, MOST = -(1 << 63), (1 << 63) - 1

_FOUND = "anchor_id long, w int, vec_id long, score long"


def _scores(m: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of rows at of m with q in whole numbers, held at a long's limits."""
    whole = q.tolist()
    return np.array([max(LEAST, min(MOST, sum(a * b for a, b in zip(whole, row, strict=True)))) for row in m[at].tolist()], np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))][:k] if scores.min() > LEAST else np.lexsort((ids, [-int(s) for s in scores]))[:k]
    return np.array(sorted(range(len(scores)), key=lambda j: (-int(scores[j]), int(ids[j]))), int)


class _Buckets:
    """The candidates in norm order, and the search of many windows in them."""

    def __init__(self, base: DataFrame, total: int, width: int):
        rows = max(BLOCK, -(-total // BUCKETS))
        placed = numbered(base, [], [F.desc("norm"), F.col("id")], "place")
        self.data = cut(placed.withColumn("bucket", F.floor(F.col("place") / rows).cast("int")), "by-norm")
        tops = self.data.groupBy("bucket").agg(F.max("norm").alias("top")).orderBy("bucket").collect()  # BUCKETS rows at most
        self.tops, self.width = np.array([t["top"] for t in tops]), width

    def _asks(self, wanted: DataFrame, start: int, stop: int) -> DataFrame:
        falling, slack = -self.tops, 1 + SLACK

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                norm, limits = b.column(3).to_numpy(), b.column(4).to_pylist()
                need = np.array([min(float(max(w["lo"], w["bound"])) for w in windows) for windows in limits])
                # the prefix of buckets whose longest row may reach what is wanted
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(need > 0, np.searchsorted(falling * slack, -need / norm, "right"), len(falling))
                here = np.clip(np.minimum(reach, stop) - start, 0, None)
                at = np.repeat(np.arange(len(b)), here)
                bucket = start + np.arange(len(at)) - np.repeat(np.cumsum(here) - here, here)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in (b.column(0), b.column(1), b.column(2), b.column(4))] + [pa.array(bucket.astype(np.int32))], names=["anchor_id", "label", "q", "windows", "bucket"])

        kind = "anchor_id long, label long, q array<long>, windows array<struct<lo:long,hi:long,bound:long>>, bucket int"
        return wanted.select("id", "label", "v", "norm", "windows").mapInArrow(run, kind)

    def _look(self, wanted: DataFrame, start: int, stop: int, k: int, same: bool) -> DataFrame | None:
        asks = cut(self._asks(wanted, start, stop), "asks")
        turns = asks.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("turns"))
        turns = cut(turns, "turns")
        if turns.limit(1).count() == 0:
            return None
        width = self.width

        def searched(rows: pa.Table, asked: pa.Table) -> pa.Table:
            out: dict[str, list] = {"anchor_id": [], "w": [], "vec_id": [], "score": []}
            if len(rows) and len(asked):
                ids, labels, m = rows["id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["v"], width)
                names, own, q, windows = asked["anchor_id"].to_numpy(), asked["label"].to_numpy(), matrix(asked["q"], width), asked["windows"].to_pylist()
                mf, qf = m.astype(float), q.astype(float)
                exact = width * float(np.abs(mf).max()) * float(np.abs(qf).max()) < 2**52
                for lo in range(0, len(q), 64):
                    rough = qf[lo : lo + 64] @ mf.T
                    slack = None if exact else (width + 4) * 2.0**-52 * (np.abs(qf[lo : lo + 64]) @ np.abs(mf).T)
                    for s in range(len(rough)):
                        j = lo + s
                        fits = (labels == own[j]) if same else (labels != own[j])
                        fits &= ids != names[j]
                        for w, limit in enumerate(windows[j]):
                            least = max(limit["lo"], limit["bound"])
                            if slack is None:
                                at = np.flatnonzero(fits & (rough[s] >= least) & (rough[s] <= limit["hi"]))
                                scores = rough[s, at].astype(np.int64)
                            else:
                                at = np.flatnonzero(fits & (rough[s] + slack[s] >= float(least) * (1 - SLACK if least > 0 else 1 + SLACK)) & ((rough[s] - slack[s] <= float(limit["hi"]) * (1 + SLACK if limit["hi"] > 0 else 1 - SLACK)) | (limit["hi"] == MOST)))
                                scores = _scores(m, q[j], at)
                                inside = (scores >= least) & (scores <= limit["hi"])
                                at, scores = at[inside], scores[inside]
                            best = _best(ids[at], scores, k)
                            out["anchor_id"] += [names[j]] * len(best)
                            out["w"] += [w] * len(best)
                            out["vec_id"] += ids[at[best]].tolist()
                            out["score"] += scores[best].tolist()
            return pa.table({n: pa.array(v, pa.int32() if n == "w" else pa.int64()) for n, v in out.items()})

        key = ["bucket", "turn"]
        asking = asks.join(F.broadcast(turns), "bucket").withColumn("turn", F.pmod(F.xxhash64("anchor_id"), "turns").cast("int"))  # a row per bucket
        blocks = self.data.join(F.broadcast(turns), "bucket").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))  # a row per bucket
        return blocks.select("id", "label", "v", *key).groupBy(*key).cogroup(asking.select("anchor_id", "label", "q", "windows", *key).groupBy(*key)).applyInArrow(searched, _FOUND)

    def search(self, anchors: DataFrame, limits: DataFrame, k: int, same: bool) -> DataFrame:
        """anchor_id, w, vec_id, score, rank: the k best rows of each window.

        anchors: id, label, v, norm. limits: id, w (from 0, gapless), lo, hi.
        """
        order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
        best: DataFrame | None = None
        start, stop = 0, 1
        while start < len(self.tops):
            known = limits.withColumn("bound", F.col("lo"))
            if best is not None:
                full = best.where(F.col("rank") == k).select(F.col("anchor_id").alias("id"), "w", F.col("score").alias("kth"))
                known = limits.join(full, ["id", "w"], "left").withColumn("bound", F.coalesce("kth", "lo"))
            windows = known.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "lo", "hi", "bound"))), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), s["bound"].alias("bound"))).alias("windows"))
            found = self._look(anchors.join(windows, "id"), start, min(stop, len(self.tops)), k, same)
            if found is None and best is not None:
                break
            if found is not None:
                every = found if best is None else best.drop("rank").unionByName(found)
                best = cut(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
            start, stop = stop, stop * GROWTH
        return best if best is not None else anchors.sparkSession.createDataFrame([], _FOUND + ", rank int")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors: rows of vectors (same columns); of an anchor id with several rows
    the least label and vector asks. An anchor's positives are its first other
    rows of its label by score, the larger first, ties to the smaller id; its
    negatives, for each of them, the first rows of other labels whose score is
    from window[0] to window[1] hundredths of the positive's. A positive score
    below 0 has no such row, one of 0 only rows of score 0. Scores are whole inner products of
    components scaled and rounded down, of any size, held at a long's limits.
    Rows with a null id, label or vector or with a component that is null or not
    finite take no part; missing components of a shorter vector count as zero.
    A row is never its own anchor's: rows of the anchor's id are left out;
    otherwise repeated rows count as often as they come, as positives too.
    Long vectors are worked on whole, other columns ignored, whatever their
    names. Empty tables give no rows, nor do anchors without positives.
    """
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    takes_part = F.coalesce(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & F.forall(vector_column, finite), F.lit(False))
    ready = lambda df: df.where(takes_part).select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), quantised(F.col(vector_column), scale).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm")
    base = cut(ready(vectors).select("id", "label", "v", norm), "vectors")
    asked = cut(ready(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v").select("id", "label", "v", norm), "anchors")
    total, width, far = (*base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first(), asked.agg(F.max(F.size("v"))).first()[0])
    if not total or far is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    buckets = _Buckets(base, total, max(width, far, 1))
    is_open = asked.select("id", F.lit(0).alias("w"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    near = buckets.search(asked, is_open, positives, same=True)
    low, high = window

    def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([-(-low * p // 100) for p in scores], pa.int64()), pa.array([high * p // 100 for p in scores], pa.int64())], names=["id", "w", "positive_id", "positive_score", "lo", "hi"])

    pairs = near.select(F.col("anchor_id").alias("id"), (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # windows that hold nothing are left in, so that w stays gapless: nothing fits them
    limits = cut(pairs.mapInArrow(limited, "id long, w int, positive_id long, positive_score long, lo long, hi long"), "windows")
    found = buckets.search(asked, limits.select("id", "w", "lo", "hi"), negatives, same=False)
    named = limits.select(F.col("id").alias("anchor_id"), "w", "positive_id", "positive_score")
    return found.join(named, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
