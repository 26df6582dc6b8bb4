"""Which keys of a text occur elsewhere: counts asked for by block.

Texts are dealt to blocks by a hash of their id. Each block counts its own keys
and sends them, packed as sorted arrays, to the bucket of their hash; the bucket
sums up and answers every asking row with those of its keys that were seen more
than once. Nothing holds more than one block or bucket, and a key that is in
every text is one entry of each asking row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.common import partitions

ASKED = "bucket int, block int, keys binary, more binary"
ANSWERS = "block int, bucket int, keys binary, counts binary"


def block_of(id_column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(41), F.col(id_column)), F.lit(n)).cast("int")


def packed(hashes: np.ndarray, block: int, n: int) -> pa.RecordBatch:
    """Rows of ASKED for the keys of a block; more holds places and counts of those that the block has several times.

    A bucket takes the low part of the hash, its keys are the high 32 bits: a
    chance meeting of two keys (fewer than one in a thousand for millions of
    keys in a bucket) makes a key look repeated, never the other way.
    """
    code, times = np.unique(hashes % np.uint64(n) << np.uint64(32) | hashes >> np.uint64(32), return_counts=True)
    key = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    edges = np.searchsorted(code >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
    buckets = np.flatnonzero(np.diff(edges))
    keys, more = [], []
    for a, z in zip(edges[buckets], edges[buckets + 1], strict=True):
        again = np.flatnonzero(times[a:z] > 1)
        keys.append(key[a:z].tobytes())
        more.append(np.r_[again, times[a:z][again]].astype(np.uint32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(np.full(len(buckets), block, np.int32)), pa.array(keys, pa.binary()), pa.array(more, pa.binary())], names=["bucket", "block", "keys", "more"])


def _answer(rows: pa.Table) -> pa.Table:
    raw = rows["keys"].to_pylist()
    sizes = np.array([len(x) // 4 for x in raw], np.int64)
    ends = np.cumsum(sizes)
    keys = np.frombuffer(b"".join(raw), np.uint32)
    times = np.ones(len(keys), np.uint32)
    for start, more in zip(ends - sizes, rows["more"].to_pylist(), strict=True):
        at, own = np.frombuffer(more, np.uint32).reshape(2, -1)
        times[start + at.astype(np.int64)] = own
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    count = np.bincount(run, times[order]).astype(np.int64)[run] if len(ranked) else run
    level = np.zeros(len(keys), np.uint8)
    level[order] = np.floor(np.log2(np.maximum(count, 1))).astype(np.uint8) + (count > 1)
    again = np.zeros(len(keys), bool)
    again[order] = count > 1
    out_keys, out_levels = [], []
    for a, z in zip(ends - sizes, ends, strict=True):
        keep = again[a:z]
        out_keys.append(keys[a:z][keep].tobytes())
        out_levels.append(level[a:z][keep].tobytes())
    return pa.table([rows["block"], rows["bucket"], pa.array(out_keys, pa.binary()), pa.array(out_levels, pa.binary())], names=["block", "bucket", "keys", "counts"])


def repeated(asked: DataFrame) -> DataFrame:
    """Rows of ANSWERS: the keys seen more than once; counts holds 1 + floor(log2(times)) for each."""
    n = partitions(asked.sparkSession)
    return asked.repartition(n, "bucket").groupBy("bucket").applyInArrow(_answer, ANSWERS)


class Known:
    """A block's answers, to be asked by hash."""

    def __init__(self, answers: pa.Table, n: int):
        buckets, keys, levels = answers["bucket"].to_pylist(), answers["keys"].to_pylist(), answers["counts"].to_pylist()
        key = np.frombuffer(b"".join(k or b"" for k in keys), np.uint32).astype(np.uint64)
        bucket = np.repeat(np.array(buckets, np.uint64), [len(k or b"") // 4 for k in keys])
        code = bucket << np.uint64(32) | key
        self.codes, first = np.unique(code, return_index=True)
        self.levels = np.frombuffer(b"".join(x or b"" for x in levels), np.uint8)[first]
        self.n = np.uint64(n)

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """0 for keys seen once."""
        if not len(self.codes):
            return np.zeros(len(hashes), np.uint8)
        code = hashes % self.n << np.uint64(32) | hashes >> np.uint64(32)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.levels[at], np.uint8(0))
