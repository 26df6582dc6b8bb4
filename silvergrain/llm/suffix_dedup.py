"""Repeated passages by a suffix array built with a common-prefix-aware distributed merge sort.

A passage of LENGTH bytes is named by its anchor: of the GRAM-byte strings in it,
the one with the least hash. Equal passages have equal anchors at equal offsets,
so only suffixes that start at anchors are sorted, and of those only the ones
whose anchor occurs more than once. Each block of documents sorts its suffixes
and sends them as front-coded runs (the length of the prefix shared with the
suffix before, then the rest) to the bucket of the anchor; the bucket merges
the runs with a loser tree that compares lengths of known common prefixes and
reads bytes only beyond them. Neighbours' common prefixes and the bytes before
the anchors then tell which passages also start earlier. The passages of a
frequent anchor are dealt in pieces of PIECE offsets, each to the bucket of the
bytes that all passages of the piece hold, so that an anchor with very many
different surroundings isn't one bucket's alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.blocks import ASKED, Known, block_of, packed, repeated
from silvergrain.llm.common import cut, partitions
from silvergrain.llm.text_arrays import U, flat, window_hashes

LENGTH = 100
GRAM = 52
WIDE = LENGTH - GRAM + 1
#: Offsets of one piece of a frequent anchor's passages.
PIECE = 7
#: An anchor is frequent from this level on: seen 1024 times or more.
FREQUENT = 11
#: Window starts of one segment of a long text; places in a segment fit the low bits of a hash.
SEGMENT = 1 << 22
LOW = U((1 << 24) - 1)
RUNS = "bucket int, block int, docs binary, places binary, least binary, most binary, shared binary, rest binary, left binary, marks binary"
MARKS = "block int, marks binary"


def segments(texts: pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before the segment in its text, bytes, offsets); only texts longer than a slice are cut."""
    for first, data, offsets in flat(texts):
        if len(data) <= 2 * SEGMENT:
            yield first, 0, data, offsets
        else:
            for at in range(0, len(data) - LENGTH + 1, SEGMENT):
                part = data[at : at + SEGMENT + LENGTH - 1]
                yield first, at, part, np.array([0, len(part)])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per run of passages with one anchor: text, place of the anchor, first and last start, hash of the anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(U)
    grams = window_hashes(data, GRAM)
    low = (grams & ~LOW) | np.arange(len(grams), dtype=U)
    step = 1
    while 2 * step <= WIDE:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    n = len(data) - LENGTH + 1
    low = np.minimum(low[:n], low[WIDE - step : WIDE - step + n])
    place = (low & LOW).astype(np.int64)
    change = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    np.add.at(change, offsets[long], 1)
    np.add.at(change, offsets[long + 1] - LENGTH + 1, -1)
    inside = np.cumsum(change[:n]) > 0
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, none, none.astype(U)
    of = place[starts]
    new = np.r_[True, (of[1:] != of[:-1]) | (np.diff(starts) > 1)]
    edge = np.flatnonzero(new)
    first, last = starts[edge], starts[np.r_[edge[1:], len(starts)] - 1]
    return np.searchsorted(offsets, first, "right") - 1, of[edge], first, last, grams[of[edge]]


def shared_prefix(a: bytes, b: bytes, at: int) -> tuple[int, bool]:
    """Length of the common prefix, known to be at least at, and whether a comes first."""
    m = min(len(a), len(b))
    x, y = a[at:m], b[at:m]
    if x == y:
        return m, len(a) <= len(b)
    p, q = int.from_bytes(x, "big"), int.from_bytes(y, "big")
    return at + (m - at) - ((p ^ q).bit_length() + 7) // 8, p < q


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int]]:
    """(run, prefix shared with the string before) in sorted order.

    runs: sorted strings with the prefix that each shares with the one before.
    Every loser keeps the length of its common prefix with the last winner: of
    two strings the one that shares more with it comes first, and only equal
    lengths are settled by bytes, from that length on.
    """
    k = len(runs)
    size = 1
    while size < max(k, 1):
        size *= 2
    strings, shares = [r[0] for r in runs], [r[1] for r in runs]
    at = [0] * k
    loser, depth = [-1] * size, [-1] * size
    winner = [i if i < k and strings[i] else -1 for i in range(size)]
    row = winner
    level = size
    while level > 1:
        up = []
        for j in range(0, level, 2):
            a, b = row[j], row[j + 1]
            node = (level + j) // 2
            if a < 0 or b < 0:
                loser[node], depth[node] = (a, -1) if b >= 0 else (b, -1)
                up.append(b if a < 0 else a)
            else:
                d, first = shared_prefix(strings[a][0], strings[b][0], 0)
                loser[node], depth[node] = (b, d) if first else (a, d)
                up.append(a if first else b)
        row, level = up, level // 2
    who, share = (row[0], 0) if k else (-1, 0)
    while who >= 0:
        yield who, share
        at[who] += 1
        i = at[who]
        if i < len(strings[who]):
            share = shares[who][i]
        else:
            share = -1
        node = (size + who) // 2
        while node:
            d = depth[node]
            if share < d:
                who, loser[node], share, depth[node] = loser[node], who, d, share
            elif share == d and d >= 0:
                other = loser[node]
                c, first = shared_prefix(strings[who][at[who]], strings[other][at[other]], d)
                depth[node] = c
                if not first:
                    who, loser[node] = other, who
            node //= 2
        if share < 0:
            return


def dealt(frequent: np.ndarray, gram: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """What travels for runs of passages: row, least and most offset of the anchor, bucket. Equal passages meet in one bucket.

    place: where the anchors stand in data.
    """
    pieces = np.where(frequent, most // PIECE - least // PIECE + 1, 1)
    row = np.repeat(np.arange(len(least)), pieces)
    piece = least[row] // PIECE + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = np.where(frequent[row], np.maximum(least[row], piece * PIECE), least[row])
    hi = np.where(frequent[row], np.minimum(most[row], piece * PIECE + PIECE - 1), most[row])
    bucket = (gram[row] % U(n)).astype(np.int64)
    often = np.flatnonzero(frequent[row])
    raw = memoryview(data)
    bucket[often] = [zlib.crc32(raw[p : p + LENGTH - PIECE + 1]) % n for p in (place[row] - piece * PIECE)[often].tolist()]
    return row, lo, hi, bucket


def _sorted_runs(table: dict[str, np.ndarray], right: list[bytes], left: list[bytes], block: int, marks: np.ndarray, mark_bucket: np.ndarray, n: int) -> pa.Table:
    """One row of RUNS per bucket; marks of the bucket's anchors ride along."""
    out = {k.split()[0]: [] for k in RUNS.split(", ")}
    by = np.argsort(table["bucket"], kind="stable")
    cuts = np.searchsorted(table["bucket"][by], np.arange(n + 1))
    m_by = np.argsort(mark_bucket, kind="stable")
    m_cuts = np.searchsorted(mark_bucket[m_by], np.arange(n + 1))
    for b in range(n):
        own, ride = by[cuts[b] : cuts[b + 1]], m_by[m_cuts[b] : m_cuts[b + 1]]
        if not len(own) and not len(ride):
            continue
        order = sorted(own.tolist(), key=right.__getitem__)
        before, shared, rest = b"", [], []
        for i in order:
            s = right[i]
            c = shared_prefix(before, s, 0)[0]
            shared.append(c)
            rest.append(s[c:])
            before = s
        own = np.array(order, np.int64)
        row = (b, block, table["doc"][own].tobytes(), table["place"][own].tobytes(), table["least"][own].tobytes(), table["most"][own].tobytes(), bytes(shared), b"".join(rest), b"".join([left[i] for i in order]), marks[ride].tobytes())
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    return pa.table([pa.array(v, pa.int32() if k in ("bucket", "block") else pa.binary()) for k, v in out.items()], names=list(out))


def _merge(rows: pa.Table) -> pa.Table:
    """MARKS per block: (document, first start, last start) of passages that also start earlier."""
    blocks = rows["block"].to_pylist()
    runs, docs, places, least, most, lefts, of = [], [], [], [], [], [], []
    for k, r in enumerate(rows.drop_columns(["block", "marks"]).to_pylist()):
        strings, at, before = [], 0, b""
        low = np.frombuffer(r["least"], np.uint8)
        for share, lo in zip(r["shared"], low.tolist(), strict=True):
            size = LENGTH - lo - share
            before = before[:share] + r["rest"][at : at + size]
            at += size
            strings.append(before)
        runs.append((strings, list(r["shared"])))
        docs.append(np.frombuffer(r["docs"], np.int64))
        places.append(np.frombuffer(r["places"], np.int64))
        least.append(low)
        most.append(np.frombuffer(r["most"], np.uint8))
        lefts.append(np.frombuffer(r["left"], np.uint8))
        of.append(np.full(len(low), k))
    base = np.cumsum([0, *map(len, docs)])
    taken, order, shared = [0] * len(runs), [], []
    for who, share in merged(runs):
        order.append(int(base[who]) + taken[who])
        shared.append(share)
        taken[who] += 1
    del runs
    order, shared = np.array(order, np.int64), np.array(shared, np.int64)
    docs, places, least, most, of = (np.concatenate([*x, np.zeros(0, np.int64)])[order].astype(np.int64) for x in (docs, places, least, most, of))
    left = np.concatenate([*lefts, np.zeros(0, np.uint8)])
    left_end = np.cumsum(np.concatenate([*[np.frombuffer(m, np.uint8) for m in rows["most"].to_pylist()], np.zeros(0, np.uint8)]).astype(np.int64))[order]
    # alone in its neighbourhood: no other suffix shares even the anchor
    after = np.r_[shared[1:], 0] if len(shared) else shared
    keep = np.maximum(shared, after) >= GRAM
    group = np.cumsum(shared < GRAM)
    first, last = np.full(len(docs), np.iinfo(np.int64).max), np.full(len(docs), -1)
    rank = np.empty(len(docs), np.int64)
    rank[np.lexsort((places, docs))] = np.arange(len(docs))
    some = np.flatnonzero(keep)
    edges = np.r_[0, np.flatnonzero(np.diff(group[some])) + 1, len(some)] if len(some) else np.zeros(1, int)
    at = 0
    while at < len(edges) - 1:  # whole groups, some ten thousand suffixes at once
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + 50_000)))
        to = min(to, len(edges) - 1)
        _earlier(some[edges[at] : edges[to]], shared, rank, places, least, most, left, left_end, first, last)
        at = to
    hit = last >= 0
    marks = np.c_[docs[hit], first[hit], last[hit]].astype(np.int64)
    where = of[hit]
    by = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[by], np.arange(len(blocks) + 1))
    out = [marks[by[cuts[k] : cuts[k + 1]]].tobytes() + (m or b"") for k, m in enumerate(rows["marks"].to_pylist())]
    return pa.table([pa.array(blocks, pa.int32()), pa.array(out, pa.binary())], names=["block", "marks"])


def _earlier(some: np.ndarray, shared: np.ndarray, rank: np.ndarray, places: np.ndarray, least: np.ndarray, most: np.ndarray, left: np.ndarray, left_end: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
    """For each offset of the anchor in the passage: passages equal on both sides; all but the earliest are marked."""
    by_rank = some[np.argsort(rank[some], kind="stable")]
    # neighbours in sorted order that share fewer than LENGTH - offset bytes are told apart
    span = np.arange(some[0], some[-1] + 1)
    # rows alike in the bytes before the anchor, one byte more each time, have one class
    before = np.zeros(len(by_rank), np.int64)
    for o in range(WIDE):
        use = (least[by_rank] <= o) & (o <= most[by_rank])
        if o:
            has = most[by_rank] >= o
            byte = np.zeros(len(by_rank), np.int64)
            byte[has] = left[left_end[by_rank[has]] - o]
            before = np.unique(np.where(has, before * 256 + byte, -1), return_inverse=True)[1].ravel()
        if not use.any():
            continue
        part = np.cumsum(shared[span] < LENGTH - o)
        rows = by_rank[use]
        key = part[rows - some[0]] * (len(before) + 1) + before[use]
        _, one = np.unique(key, return_index=True)
        later = np.ones(len(rows), bool)
        later[one] = False
        hit = rows[later]
        start = places[hit] - o
        first[hit] = np.minimum(first[hit], start)
        last[hit] = np.maximum(last[hit], start)


def equal_windows(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int = LENGTH, at_once: int = 1 << 21) -> np.ndarray:
    """Whether data[a : a + width] equals data[b : b + width], byte by byte; runs of neighbouring pairs are read once."""
    out = np.ones(len(a), bool)
    if not len(a):
        return out
    edges = np.r_[np.flatnonzero(np.r_[True, (np.diff(a) != 1) | (np.diff(b) != 1)]), len(a)]
    sizes = np.diff(edges) + width - 1
    ends = np.cumsum(sizes)
    k = 0
    while k < len(sizes):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + at_once, "right")))
        n = sizes[k:to]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(a[edges[k:to]], n) + step] != data[np.repeat(b[edges[k:to]], n) + step]
        if differ.any():
            count = np.r_[0, np.cumsum(differ)]
            for r in range(k, to):
                lo = int(ends[r] - sizes[r] - (ends[k] - sizes[k]))
                i = lo + np.arange(edges[r + 1] - edges[r])
                out[edges[r] : edges[r + 1]] = count[i + width] == count[i]
        k = to
    return out


def first_of_hash(hashed: np.ndarray, at_once: int = 1 << 22) -> np.ndarray:
    """Where each hash stands for the first time; ranges of hashes are sorted one after the other."""
    n = len(hashed)
    out = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    bits = max(n // at_once, 0).bit_length()
    for part in range(1 << bits):
        if bits:
            own = np.concatenate([np.flatnonzero(hashed[s : s + at_once] >> U(64 - bits) == U(part)) + s for s in range(0, n, at_once)])
        else:
            own = np.arange(n)
        if not len(own):
            continue
        order = np.argsort(hashed[own])
        ranked, own = hashed[own[order]], own[order]
        edges = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        out[own] = np.repeat(np.minimum.reduceat(own, edges), np.diff(np.r_[edges, len(own)]))
    return out


def unseen(data: np.ndarray, hashed: np.ndarray, byte: np.ndarray, at_once: int = 1 << 21) -> np.ndarray:
    """False for passages with the bytes of the first one that has their hash; byte: where they start in data.

    A passage whose bytes differ from those of the first one with its hash counts as a new one.
    """
    out = np.ones(len(hashed), bool)
    first = first_of_hash(hashed)
    for s in range(0, len(hashed), at_once):
        own = first[s : s + at_once]
        later = np.flatnonzero(own != np.arange(s, s + len(own)))
        out[later + s] = ~equal_windows(data, byte[later + s], byte[own[later]])
    return out


def text_hash(text: Column, seed: int = 0) -> Column:
    """One of the hashes that name a text; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(F.lit(seed), text) if seed else F.xxhash64(text)


def removed_spans(marks: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes from (first start, last start) pairs of one document."""
    marks = marks[np.argsort(marks[:, 0], kind="stable")]
    out: list[list[int]] = []
    for lo, hi in zip(marks[:, 0].tolist(), (marks[:, 1] + LENGTH).tolist(), strict=True):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, z) for a, z in out]


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside of spans, which are in order."""
    left, at = [], 0
    for a, z in spans:
        left.append(raw[at:a])
        at = z
    left.append(raw[at:])
    return b"".join(left)


def without_spans(text: Column, spans: Column) -> Column:
    """text without the spans that dedup names; null where spans is. Cut characters are left out, as in kept_text."""

    def run(texts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([None if e is None else cut_out(t.as_buffer().to_pybytes(), list(zip(e[::2], e[1::2], strict=True))).decode("utf-8", "ignore") for t, e in zip(texts, ends.to_pylist(), strict=True)], pa.string())

    # else a condition on the result would be worked out by a second run
    return F.arrow_udf(run, "string").asNondeterministic()(text, spans)


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, with_spans: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 (and with_text: kept_text; with_spans: spans; with either: text_hash, text_hash_2).

    A byte goes if some LENGTH-byte string over it also starts earlier: in a
    document with a smaller id or earlier in the same one. Null texts are empty.
    Rows with a null id take no part and keep everything. Rows that repeat an id
    and its text are one document and all keep what it keeps; of an id with
    several texts the one of least hash takes part, the others keep everything.
    Copies of a text are not sorted: all but those of the smallest id lose
    everything (if LENGTH bytes or more). Very long texts are cut into segments
    that overlap, and lose the same. Other columns are ignored, whatever their
    names; an empty table gives an empty one. kept_text is the text of the remaining bytes, cut characters left out;
    spans has the first byte of each removed run and the one after its last, one after the other, for without_spans.

    Hashes only choose what is compared: a removal rests on equal bytes, but for
    whole copies, which are texts of one 128-bit hash.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumns({"h": text_hash(F.col("text")), "g": text_hash(F.col("text"), 2)})
    known = narrow.withColumn("block", block_of("doc_id", n)).select("block", "doc_id", "text", "h", "g")
    ids = narrow.where("doc_id is not null").groupBy("h", "g").agg(F.min("doc_id").alias("node"))
    chosen = ids.groupBy("node").agg(F.min(F.struct("h", "g")).alias("t"), F.collect_list(F.struct("h", "g")).alias("all"))  # the texts of one id
    firsts = cut(chosen.select(block_of("node", n).alias("block"), "node", F.col("t.h").alias("h"), F.col("t.g").alias("g"), F.filter("all", lambda x: x != F.col("t")).alias("others")), "firsts")
    texts = lambda: known.groupBy("block")

    def named(told: pa.Table) -> tuple[dict[int, tuple[int, int]], set[tuple[int, int, int]]]:
        """The text of each id that takes part, and those that keep everything."""
        own, others = {}, set()
        told = told.filter(told["node"].is_valid())
        for node, h, g, more in zip(told["node"].to_pylist(), told["h"].to_pylist(), told["g"].to_pylist(), told["others"].to_pylist(), strict=True):
            own[node] = h, g
            others.update((node, x["h"], x["g"]) for x in more or ())
        return own, others

    def of_firsts(rows: pa.Table, told: pa.Table) -> pa.Table:
        """The block's texts without copies, in order of id."""
        own, _ = named(told)
        seen: set[int] = set()
        keep = []
        for doc, h, g in zip(rows["doc_id"].to_pylist(), rows["h"].to_pylist(), rows["g"].to_pylist(), strict=True):
            keep.append(own.get(doc) == (h, g) and doc not in seen)
            if keep[-1]:
                seen.add(doc)
        return rows.filter(pa.array(keep, pa.bool_())).sort_by("doc_id")

    def ask(rows: pa.Table, told: pa.Table) -> pa.Table:
        kept = of_firsts(rows, told)
        found = [anchors(data, offsets)[4] for _, _, data, offsets in segments(kept["text"])]
        hashes = np.concatenate([*found, np.zeros(0, U)])
        block = rows["block"][0].as_py() if len(rows) else 0
        return pa.Table.from_batches([packed(hashes, block, n)])

    def runs(rows: pa.Table, told: pa.Table) -> pa.Table:
        kept = of_firsts(rows, told)
        held = Known(told.filter(told["bucket"].is_valid()), n)
        ids = kept["doc_id"].to_numpy()
        parts, hashes, read = [], [], []
        at = 0
        for first_row, base, data, offsets in segments(kept["text"]):
            text, place, first, last, gram = anchors(data, offsets)
            level = held.level(gram)
            use = level > 0
            text, place, first, last, gram, level = text[use], place[use], first[use], last[use], gram[use], level[use]
            if not len(text):
                continue
            count = last - first + 1
            hashes.append(window_hashes(data, LENGTH)[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())])
            read.append(data)
            # places in the bytes read, and what turns them into places in the text
            parts.append((ids[first_row + text], place + at, first + at, count, base - offsets[text] - at, gram, level >= FREQUENT))
            at += len(data)
        block = rows["block"][0].as_py() if len(rows) else 0
        if not parts:
            return _sorted_runs({k: np.zeros(0, np.int64) for k in ("bucket", "doc", "place", "least", "most")}, [], [], block, np.zeros((0, 3), np.int64), np.zeros(0, np.int64), n)
        doc, place, first, count, shift, gram, frequent = (np.concatenate([p[k] for p in parts]) for k in range(7))
        hashed, data = np.concatenate(hashes), np.concatenate(read)
        del hashes, read, parts
        # a row for each passage: kept narrow
        kind = np.int32 if max(len(data), len(hashed)) < 1 << 31 else np.int64
        byte = np.repeat((first - np.cumsum(count) + count).astype(kind), count) + np.arange(len(hashed), dtype=kind)
        here = unseen(data, hashed, byte)
        del hashed
        of = np.repeat(np.arange(len(first), dtype=kind), count)
        # the block's own repeats are marked at once; only passages new to the block travel
        far = np.iinfo(np.int64).max
        lo, hi = np.full(len(first), far), np.full(len(first), -1)
        np.minimum.at(lo, of[here], byte[here])
        np.maximum.at(hi, of[here], byte[here])
        a, z = np.full(len(first), far), np.full(len(first), -1)
        np.minimum.at(a, of[~here], byte[~here])
        np.maximum.at(z, of[~here], byte[~here])
        del of, byte, here
        again = z >= 0
        # marks only pass through a bucket on their way back; those at frequent anchors take any
        back = np.where(frequent, doc % n, (gram % U(n)).astype(np.int64))
        go = np.flatnonzero(hi >= 0)
        row, least, most, bucket = dealt(frequent[go], gram[go], place[go], (place - hi)[go], (place - lo)[go], data, n)
        row = go[row]
        raw = memoryview(data)
        right = [bytes(raw[p : p + LENGTH - k]) for p, k in zip(place[row].tolist(), least.tolist(), strict=True)]
        left = [bytes(raw[p - k : p]) for p, k in zip(place[row].tolist(), most.tolist(), strict=True)]
        table = {"bucket": bucket, "doc": doc[row].astype(np.int64), "place": (place + shift)[row].astype(np.int64), "least": least.astype(np.uint8), "most": most.astype(np.uint8)}
        return _sorted_runs(table, right, left, block, np.c_[doc[again], (a + shift)[again], (z + shift)[again]].astype(np.int64), back[again], n)

    mine = firsts
    asked = texts().cogroup(mine.groupBy("block")).applyInArrow(ask, ASKED)
    told = repeated(asked).unionByName(mine, allowMissingColumns=True)
    sent = texts().cogroup(told.groupBy("block")).applyInArrow(runs, RUNS)
    marks = sent.groupBy("bucket").applyInArrow(_merge, MARKS)
    marked = marks.unionByName(mine, allowMissingColumns=True)
    names = [id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text, *["spans"] * with_spans, *["text_hash", "text_hash_2"] * (with_text or with_spans)]
    kinds = {"kept_sha256": pa.string(), "kept_text": pa.string(), "spans": pa.list_(pa.int64())}

    def keep(rows: pa.Table, told: pa.Table) -> pa.Table:
        own, others = named(told)
        all_marks = np.frombuffer(b"".join(m for m in told["marks"].to_pylist() if m), np.int64).reshape(-1, 3)
        all_marks = all_marks[np.argsort(all_marks[:, 0], kind="stable")]
        out = {k: [] for k in names[1:]}
        for doc, h, g, text in zip(rows["doc_id"].to_pylist(), rows["h"].to_pylist(), rows["g"].to_pylist(), rows["text"], strict=True):
            raw = text.as_buffer().to_pybytes()
            if doc is None or (doc, h, g) in others:
                spans = []
            elif own.get(doc) != (h, g):
                spans = [(0, len(raw))] if len(raw) >= LENGTH else []
            else:
                a, z = np.searchsorted(all_marks[:, 0], [doc, doc + 1])
                spans = removed_spans(all_marks[a:z, 1:]) if z > a else []
            whole = cut_out(raw, spans)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(whole))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(whole).hexdigest())
            if with_text:
                out["kept_text"].append(whole.decode("utf-8", "ignore"))
            if with_spans:
                out["spans"].append([x for span in spans for x in span])
            if with_text or with_spans:
                out["text_hash"].append(h)
                out["text_hash_2"].append(g)
        return pa.table([rows["doc_id"], *(pa.array(out[k], kinds.get(k, pa.int64())) for k in names[1:])], names=names)

    kind = f"{id_column} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + ", spans array<long>" * with_spans + ", text_hash long, text_hash_2 long" * (with_text or with_spans)
    return texts().cogroup(marked.groupBy("block")).applyInArrow(keep, kind)
