"""Exact and similar duplicates.

Exact: entries of equal size, then of equal sample hash, then of equal full hash;
each stage reads only what the one before left over. Similar: 64-bit
fingerprints, pairs within a Hamming distance, connected components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.operators.components import components
from silvergrain.operators.ordering import numbered
from silvergrain.sources.files import opened
from silvergrain.sources.staging import cut

#: Bytes of a sample, taken at the start, the middle and the end.
SAMPLE = 128 * 1024


def full_hash(content: Column) -> Column:
    return F.upper(F.sha2(content, 256))


def sample_is_full(size: Column) -> Column:
    return size <= 3 * SAMPLE


def sample_hash(content: Column, size: Column) -> Column:
    """Hash of the size (eight little-endian bytes) and three samples; of everything where they would overlap."""
    little = F.reverse(F.regexp_replace(F.lpad(F.hex(size), 16, "0"), "(.)(.)", "$2$1"))
    start = F.substring(content, 1, SAMPLE)
    middle = F.substr(content, F.floor((size - SAMPLE) / 2).cast("int") + 1, F.lit(SAMPLE))
    end = F.substr(content, (size - SAMPLE).cast("int") + 1, F.lit(SAMPLE))
    parts = F.when(sample_is_full(size), content).otherwise(F.concat(start, middle, end))
    return F.upper(F.sha2(F.concat(F.unhex(little), parts), 256))


def exact_groups(entries: DataFrame) -> DataFrame:
    """entries (key, size_bytes, content, modified_at, file_name, rank) -> (group_first, member, key, size_bytes, hash).

    group_first is the smallest rank in a group, which orders the groups; member
    counts from 1 by time, name and rank, which tells entries apart. A null
    content never groups.
    """
    light = entries.select("key", "size_bytes", "modified_at", "file_name", "rank")
    sizes = light.groupBy("size_bytes").count().where("count > 1").select("size_bytes")
    left = entries.join(sizes, "size_bytes", "left_semi").where("content is not null")
    sampled = left.withColumn("sample", sample_hash(F.col("content"), F.col("size_bytes")))
    alike = sampled.groupBy("size_bytes", "sample").count().where("count > 1").select("size_bytes", "sample")
    hashed = sampled.join(alike, ["size_bytes", "sample"], "left_semi").withColumn("hash", F.when(sample_is_full(F.col("size_bytes")), F.col("sample")).otherwise(full_hash(F.col("content"))))
    small = cut(hashed.select("key", "size_bytes", "modified_at", "file_name", "rank", "hash"), "hashed")
    groups = small.groupBy("size_bytes", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("group_first")).where("n > 1").drop("n")
    placed = numbered(small.join(groups, ["size_bytes", "hash"]), ["group_first"], [F.col("modified_at"), F.lower("file_name"), F.col("file_name"), F.col("rank")], "member", 1)
    return placed.select("group_first", F.col("member").cast("int").alias("member"), "key", "size_bytes", "hash")


def _hashed(sampled: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of files in tasks: of their size and three samples, or of all they hold in chunks."""

    def one(path: str, size: int) -> tuple[str, int]:
        system, inner = opened(path)
        with system.open_input_file(inner) as f:
            if f.size() != size:
                raise ValueError("size has changed")
            if not sampled:
                digest, taken = hashlib.sha256(), 0
                while chunk := f.read(1 << 20):
                    digest.update(chunk)
                    taken += len(chunk)
                return digest.hexdigest().upper(), taken
            parts = [f.read_at(size, 0)] if size <= 3 * SAMPLE else [f.read_at(SAMPLE, at) for at in (0, (size - SAMPLE) // 2, size - SAMPLE)]
            return hashlib.sha256(size.to_bytes(8, "little") + b"".join(parts)).hexdigest().upper(), sum(map(len, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if len(b)):
            rows = []
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows.append((path, *one(path, size), None))
                except Exception as e:
                    rows.append((path, None, 0, f"{type(e).__name__}: {e}"))
            columns = zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["full_path", "hash", "bytes_read", "error"])

    return run


def exact_file_groups(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, report, failures) of files by what they hold, reading only what the stage before leaves.

    records: full_path, file_name, size_bytes, modified_at and rank (which
    orders and tells them apart). Sizes alone come first; of files that share
    one, at most three samples of 128 KiB are read by their places; only of those whose
    samples agree, and that hold more than the samples, everything is read.
    groups is as in exact_groups with full_path as key; report: stage, files,
    bytes_read; failures: full_path, error of files that could not be read or
    have changed, which are in no group and counted.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "full_path string, hash string, bytes_read long, error string"
    sizes = records.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size_bytes")
    alike = cut(records.join(sizes, "size_bytes", "left_semi").select("full_path", "size_bytes", "file_name", "modified_at", "rank"), "one-size")
    # dealt by path, so that neighbours of one folder don't wait for one task
    sampled = cut(alike.select("full_path", "size_bytes").repartition(n, "full_path").mapInArrow(_hashed(True), kind), "samples")
    named = alike.join(sampled.where("error is null").select("full_path", "hash"), "full_path")
    again = named.groupBy("size_bytes", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    left = cut(named.join(again, ["size_bytes", "hash"], "left_semi"), "one-sample")
    large = left.where(~sample_is_full(F.col("size_bytes")))
    read = cut(large.select("full_path", "size_bytes").repartition(n, "full_path").mapInArrow(_hashed(False), kind), "contents")
    whole = large.drop("hash").join(read.where("error is null").select("full_path", "hash"), "full_path")
    known = left.where(sample_is_full(F.col("size_bytes"))).unionByName(whole)
    groups = known.groupBy("size_bytes", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("group_first")).where("n > 1").drop("n")
    placed = numbered(known.join(groups, ["size_bytes", "hash"]), ["group_first"], [F.col("modified_at"), F.lower("file_name"), F.col("file_name"), F.col("rank")], "member", 1)
    count = lambda df, stage, taken: df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(taken), F.lit(0)).cast("long").alias("bytes_read"))
    report = count(records, "sizes", F.lit(0)).unionByName(count(sampled, "samples", F.col("bytes_read"))).unionByName(count(read, "contents", F.col("bytes_read")))
    failures = sampled.unionByName(read).where("error is not null").select("full_path", "error")
    return placed.select("group_first", F.col("member").cast("int").alias("member"), F.col("full_path").alias("key"), "size_bytes", "hash"), report, failures


def exact_summary(groups: DataFrame) -> DataFrame:
    per = groups.groupBy("group_first").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("redundant"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def suggested(groups: DataFrame, similar: bool = False) -> DataFrame:
    """Members to remove: all but the first of exact groups, all of similar ones."""
    return groups if similar else groups.where("member > 1")


def others_if_kept(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(group_first, kept, other): the members that keeping one of a group selects.

    kept: (group_first, kept), a row per group at most, so that a group costs a
    row per member.
    """
    return groups.join(kept.select("group_first", "kept"), "group_first").where(F.col("key") != F.col("kept")).select("group_first", "kept", F.col("key").alias("other"))


def saturated_sum(value: Column) -> Column:
    """Negatives count as 0; the sum stops at the largest long."""
    most = (1 << 63) - 1
    return F.least(F.coalesce(F.sum(F.greatest(value, F.lit(0)).cast("decimal(38,0)")), F.lit(0)), F.lit(most).cast("decimal(38,0)")).cast("long")


def prefilter_pays(entries: DataFrame) -> DataFrame:
    """pays: whether exact content is to be compared before similarity.

    Three entries at least, two of them of a shared size, and those are a sixth
    of all or hold 16 MiB.
    """
    sizes = entries.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("alike"), saturated_sum(F.when(F.col("n") > 1, F.col("n") * F.col("size_bytes"))).alias("bytes"))
    pays = (F.col("n") >= 3) & (F.col("alike") >= 2) & ((F.col("alike") >= F.greatest(F.lit(2), F.floor(F.col("n") / 6))) | (F.col("bytes") >= 16 * 1024 * 1024))
    return totals.select(pays.alias("pays"), F.col("alike").cast("long").alias("alike"))


#: Texts that a task signs at a time, and their bytes, unless one text has more.
SIGNED_TEXTS, SIGNED_BYTES = 512, 1 << 21


def signed_at_a_time(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of stretches of texts of these sizes."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + SIGNED_TEXTS, int(np.searchsorted(ends, before + SIGNED_BYTES, "right"))))
        yield lo, hi - lo
        lo = hi


def laid_out(own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of strings without nulls, and where each starts and the last one ends."""
    kind = np.int64 if pa.types.is_large_string(own.type) or pa.types.is_large_binary(own.type) else np.int32
    if not len(own):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = own.buffers()
    at = np.frombuffer(at, kind)[own.offset : own.offset + len(own) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


SEPARATES = np.isin(np.arange(256), list(b"\t\n\f\r "))


def word_places(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; none goes on over an edge."""
    inside = ~SEPARATES[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = edges[(edges > 0) & (edges < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def bit_sums(bits: np.ndarray, word: np.ndarray, firsts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of bits[word], 64 bytes of 0 or 1 each, over runs that start at firsts and have so many words.

    Up to 255 rows are added as eight words of eight bytes, none of which overflows.
    """
    parts = -(-words // 255)
    heads = np.cumsum(parts) - parts
    sub = np.repeat(firsts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(heads, parts))
    sums = np.add.reduceat(bits.view(np.uint64)[word], sub, axis=0).view(np.uint8)
    return np.add.reduceat(sums, heads, axis=0, dtype=np.int32)


def text_fingerprints(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint): a word-set SimHash; a bit is set if more than half of the distinct words set it.

    Words are what stands between spaces, tabs, line feeds, form feeds and carriage returns.
    A text without words, or null, has a null fingerprint, which is like no other.
    """

    def signed(own: pa.Array) -> pa.Array:
        data, edges = laid_out(pc.fill_null(own, ""))
        starts, ends = word_places(data, edges)
        out, some = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        if len(starts):
            # words and what stands between them, in turn
            turns = np.c_[starts, ends].ravel().astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(turns) - 1, [None, pa.py_buffer(turns), pa.py_buffer(data)]).dictionary_encode()
            raw, at = laid_out(coded.dictionary)
            raw, at = raw.tobytes(), at.tolist()
            # each distinct word is hashed once
            digests = np.frombuffer(b"".join([hashlib.md5(raw[a:z]).digest()[:8] for a, z in zip(at, at[1:], strict=False)]), np.uint8).reshape(-1, 8)
            row = np.repeat(np.arange(len(own)), np.diff(np.searchsorted(starts, edges)))
            pairs = row * np.int64(len(digests)) + coded.indices.to_numpy()[::2]
            pairs.sort()
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
            row, word = pairs // len(digests), pairs % len(digests)
            firsts = np.flatnonzero(np.diff(row, prepend=-1))
            words = np.diff(np.append(firsts, len(row)))
            most = bit_sums(np.unpackbits(digests, axis=1), word, firsts, words) * 2 > words[:, None]
            out[row[firsts]] = np.packbits(most, axis=1).view(">i8")[:, 0]
            some[row[firsts]] = True
        return pa.array(out, mask=~some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, number in signed_at_a_time(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()):
                part = batch.slice(lo, number)
                yield pa.RecordBatch.from_arrays([part.column(0), signed(part.column(1))], names=["key", "fingerprint"])

    return texts.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {texts.schema[key].dataType.simpleString()}, fingerprint long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ball(bits: int, radius: int) -> int:
    """How many values differ from one of so many bits in radius of them at most."""
    return sum(math.comb(bits, k) for k in range(radius + 1))


#: Fingerprints of a piece of a cell: pieces meet as tiles of so many by so many.
PIECE = 512

#: Pairs that a task links up at a time.
LINKED_PAIRS = 1 << 18


def cells_of(n: int, most: int, blocks: int | None = None) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of the cells in which n fingerprints meet, for so many blocks or what costs least.

    A pair within most differs in at most the radius in one of the blocks, whose radii
    and one each make up most + 1; a cell takes as many of its block's bits as costs
    least in tiles, in pieces that meet and in bytes (seconds as measured on one core).
    """

    def cost(bits: int, radius: int) -> float:
        near = ball(bits, radius)
        return n * n / 2 * near / 2**bits * 1.3e-9 + min(2**bits, n) * near / 2 * 20e-6 + n * near * 20e-9

    def cut_into(m: int) -> list[tuple[int, int, int]]:
        radius, more = divmod(most + 1 - m, m)
        bounds = [round(k * 64 / m) for k in range(m + 1)]
        cells = []
        for k, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)):
            r = radius + (k < more)
            cells.append((a, min((c for c in range(1, z - a + 1) if ball(c, r) <= 1024 or c == 1), key=lambda c: cost(c, r)), r))
        return [c for c in cells if c[2] >= 0]

    sets = [cut_into(m) for m in ([blocks] if blocks else range(1, most + 2))]
    return min(sets, key=lambda cells: sum(cost(c, r) for _, c, r in cells))


def _pieces(once: DataFrame, cells: list[tuple[int, int, int]]) -> DataFrame:
    """(block, value, old, prints, id): the fingerprints (fingerprint, old) of each cell, PIECE of them in a row of bytes."""
    n = int(once.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for k, (a, bits, _) in enumerate(cells):
                value = ((prints >> np.uint64(a)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), k, np.int32)), pa.array(value), batch.column(1), batch.column(0)], names=["block", "value", "old", "fingerprint"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(parts: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": k, "value": v, "old": o, "prints": p.tobytes()} for k, v, o, p in parts], schema=schema)

        schema = pa.schema([("block", pa.int32()), ("value", pa.int64()), ("old", pa.bool_()), ("prints", pa.binary())])
        cell, held = None, np.array([], np.int64)
        for batch in (b for b in batches if len(b)):
            block, value, old, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            starts = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(value) != 0) | (old[1:] != old[:-1])])
            out = []
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True):
                here = (int(block[at]), int(value[at]), bool(old[at]))
                if here != cell:
                    if len(held):
                        out.append((*cell, held))
                    cell, held = here, held[:0]
                held = np.concatenate([held, prints[at:end]])
                while len(held) >= PIECE:
                    out.append((*cell, held[:PIECE]))
                    held = held[PIECE:]
            if out:
                yield rows(out)
        if len(held):
            yield rows([(*cell, held)])

    dealt_out = once.mapInArrow(dealt, "block int, value long, old boolean, fingerprint long").repartition(n, "block", "value").sortWithinPartitions("block", "value", "old")
    return cut(dealt_out.mapInArrow(packed, "block int, value long, old boolean, prints binary").withColumn("id", F.monotonically_increasing_id()), "pieces")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what the links a, b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (further := root[root] != root).any():
            root[further] = root[root[further]]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _near(fingerprints: DataFrame, most: int, blocks: int | None, known: DataFrame | None, links: bool) -> DataFrame:
    """Pairs (a, b, distance) of distinct fingerprints, or (a, b) that link what these pairs link, fewer where they are many."""
    if not 0 <= most < 64:
        raise ValueError("fingerprints have 64 bits")
    once = fingerprints.where("fingerprint is not null").select("fingerprint").distinct().withColumn("old", F.lit(False))
    if known is not None:
        old = cut(known.where("fingerprint is not null").select("fingerprint").distinct(), "known")
        once = once.join(old, "fingerprint", "left_anti").unionByName(old.withColumn("old", F.lit(True)))
    once = cut(once, "fingerprints")
    cells = cells_of(once.count(), most, blocks)
    n = int(once.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = _pieces(once, cells)
    flips = [[sum(1 << b for b in c) for k in range(r + 1) for c in combinations(range(bits), k)] for _, bits, r in cells]
    masks = [np.uint64(((1 << bits) - 1) << a) for a, bits, _ in cells]
    radii = [r for _, _, r in cells]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        differ, counts = np.empty((PIECE, PIECE), np.uint64), np.empty((PIECE, PIECE), np.uint8)
        for batch in batches:
            for block, left, right, same in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                d, c = differ.ravel()[: len(p) * len(q)].reshape(len(p), len(q)), counts.ravel()[: len(p) * len(q)].reshape(len(p), len(q))
                np.bitwise_xor(p[:, None], q, out=d)
                np.bitwise_count(d, out=c)
                found = np.flatnonzero(c.ravel() <= most)
                if same and len(found):  # each pair of a piece with itself once
                    found = found[found // len(q) < found % len(q)]
                # the first block in which a pair meets reports it
                for k in range(block):
                    if not len(found):
                        break
                    found = found[np.bitwise_count(d.ravel()[found] & masks[k]) > radii[k]]
                if len(found):
                    yield p[found // len(q)].view(np.int64), q[found % len(q)].view(np.int64), c.ravel()[found]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, far in _gathered(met(batches), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(far.astype(np.int32))], names=["a", "b", "distance"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.array([], np.int64)
        for x, y, _ in _gathered(met(batches), LINKED_PAIRS):
            a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
            if len(a) > LINKED_PAIRS // 2:  # the links of other batches go on from these
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a = b = np.array([], np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # a cell names the cells near it that come after it, and itself
    near = F.explode(F.transform(F.element_at(F.array(*[F.array(*[F.lit(f) for f in fs]) for fs in flips]), F.col("block") + 1), lambda f: F.col("value").bitwiseXOR(f.cast("long"))))
    left = pieces.select("block", F.col("value").alias("own"), F.col("old").alias("was"), F.col("prints").alias("left"), F.col("id").alias("lid"), near.alias("value")).where("value >= own").repartition(n, "block", "value")
    right = pieces.select("block", "value", "old", F.col("prints").alias("right"), "id").repartition(n, "block", "value").hint("merge")
    units = left.join(right, ["block", "value"]).where("not (was and old) and (value > own or lid <= id)").select("block", "left", "right", F.expr("lid = id").alias("same"))
    return units.mapInArrow(linked, "a long, b long") if links else units.mapInArrow(paired, "a long, b long, distance int")


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The parts' arrays, joined to at least so many."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= least:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def banded_pairs(fingerprints: DataFrame, most: int, blocks: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, distance), a < b, of distinct fingerprints within most (below 64) of each other.

    known: fingerprints whose pairs among themselves aren't wanted again; those of
    fingerprints with them are.

    The bits are cut into blocks with a radius each, so that a pair within most is
    within the radius of at least one. Fingerprints are packed by the value
    of each block's cell; pieces of cells near each other meet by an equi-join and are
    compared as tiles. The first block in which a pair meets reports it. Blocks and
    cells follow the number of fingerprints. Pieces are never broadcast, and a task
    holds two of them. Null fingerprints have no pairs.
    """
    return _near(fingerprints, most, blocks, known, False)


def banded_links(fingerprints: DataFrame, most: int, blocks: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) with the components of banded_pairs: each task leaves a forest of its pairs, so that n near copies leave n - 1 links rather than n * n / 2."""
    return _near(fingerprints, most, blocks, known, True)


def computed_once(entries: DataFrame, key: str, content: Column, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compute's row of each key, worked out for the first entry of each exact content and shared by its copies.

    compute: rows of entries -> (key, ...). A null content is never shared.
    Where compute leaves an entry out (a failure), its copies are computed alone.
    """
    return _shared(entries, key, cut(entries.select(key, F.sha2(content, 256).alias("__same")), "named"), compute)


def _shared(entries: DataFrame, key: str, named: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """computed_once with the contents' hashes at hand (key, __same); only copies are looked up, so contents move once."""
    named = named.where("__same is not null")
    leads = named.groupBy("__same").agg(F.min(key).alias("__lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = cut(named.join(leads, "__same").where(F.col(key) != F.col("__lead")).select(key, "__lead"), "copies")
    done = cut(compute(entries.join(copies.select(key), key, "left_anti")), "computed")
    found = done.unionByName(copies.join(done.withColumnRenamed(key, "__lead"), "__lead").drop("__lead"))
    failed = cut(copies.join(done.select(F.col(key).alias("__lead")), "__lead", "left_anti").select(key), "failed")
    if failed.limit(1).count() == 0:
        return found
    return found.unionByName(compute(entries.join(failed, key, "left_semi")).select(*found.columns))


def pairs_of_entries(fingerprints: DataFrame, most: int) -> DataFrame:
    """Pairs (left, right, distance) of keys, left < right, that stand for all within most of each other.

    Entries of one fingerprint are a class, named by its smallest key: classes
    are paired by these keys, and every other member is paired with its own
    class's, at distance 0. A class of n copies so costs n - 1 rows, not n * n.
    Null fingerprints have no pairs.
    """
    fingerprints = cut(fingerprints.where("fingerprint is not null").select("key", "fingerprint"), "keyed")  # worked out once
    classes = cut(fingerprints.groupBy("fingerprint").agg(F.min("key").alias("lead")), "classes")
    lead = lambda c: classes.select(F.col("fingerprint").alias(c), F.col("lead").alias(f"l{c}"))
    between = banded_pairs(classes, most).join(lead("a"), "a").join(lead("b"), "b").select(F.least("la", "lb").alias("left"), F.greatest("la", "lb").alias("right"), "distance")
    within = fingerprints.join(classes, "fingerprint").where("key <> lead").select(F.col("lead").alias("left"), F.col("key").alias("right"), F.lit(0).alias("distance"))
    return between.unionByName(within)


def similar_groups(fingerprints: DataFrame, most: int) -> DataFrame:
    """(group_first, member, key, fingerprint): components of keys under single linkage, of two or more.

    Equal fingerprints are linked through their smallest key rather than to each
    other, so a large group of copies costs one link per member. Entries with a
    null fingerprint are in no group.
    """
    fingerprints = cut(fingerprints.where("fingerprint is not null").select("key", "fingerprint"), "keyed")  # worked out once
    first = fingerprints.groupBy("fingerprint").agg(F.min("key").alias("lead"))
    near = banded_links(fingerprints, most)
    lead = lambda c: first.select(F.col("fingerprint").alias(c), F.col("lead").alias(f"l{c}"))
    between = near.join(lead("a"), "a").join(lead("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    within = fingerprints.join(first, "fingerprint").where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    comps = components(between.unionByName(within))
    placed = comps.join(fingerprints, comps["node"] == fingerprints["key"]).select(F.col("comp").alias("group_first"), "key", "fingerprint")
    return numbered(placed, ["group_first"], [F.col("key")], "member", 1).select("group_first", F.col("member").cast("int").alias("member"), "key", "fingerprint")


def similar_entries(entries: DataFrame, most: int, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(group_first, member, key, fingerprint) of entries (key, size_bytes, content, modified_at, file_name, rank), from contents to ordered groups.

    compute: rows of entries -> (key, fingerprint); entries it leaves out, or
    gives null, are in no group. Where comparing exact contents pays, each content is computed once
    and its copies share the result. Members go by time, name and rank, which tells entries apart;
    group_first is the smallest rank, and a group's fingerprint that of its first member.
    Contents are read from entries twice, for their hashes and by compute, and are written nowhere,
    so entries that differ from one reading to the next are to be written before.
    """
    light = cut(entries.select("key", "size_bytes", "modified_at", "file_name", "rank", F.sha2("content", 256).alias("__same")), "entries")
    pays = prefilter_pays(light).first()["pays"]
    prints = _shared(entries, "key", light.select("key", "__same"), compute) if pays else compute(entries)
    found = similar_groups(prints.select("key", "fingerprint"), most).select(F.col("group_first").alias("__group"), "key", "fingerprint")
    held = cut(found.join(light.select("key", "modified_at", "file_name", "rank"), "key"), "members")
    firsts = held.groupBy("__group").agg(F.min("rank").alias("group_first"), F.min_by("fingerprint", F.struct("modified_at", F.lower("file_name"), "file_name", "rank")).alias("fingerprint"))
    placed = numbered(held.drop("fingerprint").join(firsts, "__group"), ["group_first"], [F.col("modified_at"), F.lower("file_name"), F.col("file_name"), F.col("rank")], "member", 1)
    return placed.select("group_first", F.col("member").cast("int").alias("member"), "key", "fingerprint")


def grown_groups(state: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """(key, fingerprint, comp) of a stored state of that form once new (key, fingerprint) is taken in.

    comp is the smallest key of an entry's component, its own where it stands
    alone. Only pairs of new fingerprints, with each other and with stored
    ones, are looked for; stored components are single nodes, and only those that new links
    touch get other labels. Keys of new that the state holds are left as they
    are; null fingerprints have no links. An empty state starts one.
    """
    state = cut(state.select("key", "fingerprint", "comp"), "stored")
    new = cut(new.select("key", "fingerprint").join(state.select("key"), "key", "left_anti"), "new")
    stored = state.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("comp").alias("label"))
    # a fingerprint's label: that of its stored component, else its smallest new key
    fresh = new.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("key").alias("own"))
    labels = cut(fresh.join(stored, "fingerprint", "full").select("fingerprint", "own", F.coalesce("label", "own").alias("label")), "labels")
    near = banded_links(new, most, known=state)
    label = lambda c: labels.select(F.col("fingerprint").alias(c), F.col("label").alias(f"l{c}"))
    links = near.join(label("a"), "a").join(label("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    # a new key of a stored fingerprint may be smaller than its component's label
    links = links.unionByName(labels.where("own is not null").select(F.col("label").alias("a"), F.col("own").alias("b")))
    comps = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("__least"))
    named = new.join(labels.drop("own"), "fingerprint", "left").select("key", "fingerprint", F.coalesce("label", "key").alias("comp"))
    return state.unionByName(named).join(comps, "comp", "left").select("key", "fingerprint", F.coalesce("__least", "comp").alias("comp"))


def leading_suggestion(groups: DataFrame, similar: bool = False) -> DataFrame:
    """What suggested() selects in the group that comes first."""
    first = groups.agg(F.min("group_first").alias("group_first"))
    return suggested(groups.join(F.broadcast(first), "group_first", "left_semi"), similar)  # one row


def exclusions(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """scanned, failed, groups, redundant: how many entries were looked at, had no content and so are in no group, and what was found."""
    seen = entries.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("content").isNull()).alias("failed"))
    return seen.crossJoin(exact_summary(groups).select("groups", "redundant"))  # one row each


def group_labels(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per group: members, folders and the names of the first three."""
    named = groups.join(catalog.select(F.col("doc_id").alias("key"), "file_name", "full_path"), "key")
    first = named.where("member <= 3").groupBy("group_first").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("member", "file_name"))), lambda s: s["file_name"]), ", ").alias("first_names"))
    per = named.groupBy("group_first").agg(F.count(F.lit(1)).alias("members"), F.count_distinct(F.regexp_replace("full_path", "/[^/]*$", "")).alias("folders"))
    return per.join(first, "group_first")


#: Rows of a block of a collection's signature, in the mean, at most.
SIGNED = 4096


def collection_signature(entries: DataFrame) -> DataFrame:
    """signature of a whole collection: a hash of the sorted rows' hashes.

    Rows are summed up by blocks of their path's hash first, as many as keep
    SIGNED rows each; the blocks' hashes, in order, are summed up by 256 until
    256 are left, which are the last level. No task holds the collection. The
    value depends on the rows alone: their number settles the levels.
    """
    digits, n = 2, entries.count()
    while n > SIGNED * 16**digits:
        digits += 2
    row = F.concat(F.col("full_path"), F.lit("\n"), F.col("size_bytes").cast("string"), F.lit("\n"), F.col("stamp").cast("string"), F.lit("\n"))
    level = entries.select(F.substring(F.md5("full_path"), 1, digits).alias("block"), row.alias("row")).groupBy("block").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("row")), ""), 256).alias("hash"))
    together = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "hash"))), lambda s: s["hash"]), ""), 256)
    while digits > 2:
        digits -= 2
        level = level.groupBy(F.substring("block", 1, digits).alias("above")).agg(together.alias("hash")).withColumnRenamed("above", "block")
    return level.agg(F.upper(together).alias("signature"))


def flattened(buckets: DataFrame, members: str = "members") -> DataFrame:
    """A row per member of each bucket's array, with its place from 0."""
    return buckets.select(*[c for c in buckets.columns if c != members], F.posexplode(members).alias("place", "member"))


def group_paths(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """(group_first, member, full_path): each group's paths in order, a row each, so that no row holds a group."""
    return groups.join(catalog.select(F.col("doc_id").alias("key"), "full_path"), "key").select("group_first", "member", "full_path")


def after_confirming(groups: DataFrame, confirmed: DataFrame) -> DataFrame:
    """remaining and reviewed groups once those of confirmed (group_first) are dropped."""
    every = groups.select("group_first").distinct()
    counts = every.join(confirmed.select("group_first").distinct().withColumn("__done", F.lit(True)), "group_first", "left")
    return counts.agg(F.count_if(F.col("__done").isNull()).alias("remaining"), F.count_if("__done").alias("reviewed"))


def next_focus(index: Column, remaining: Column) -> Column:
    """The group shown after the one at index is gone; null when none is left."""
    return F.when(remaining > 0, F.least(index, remaining - 1))
