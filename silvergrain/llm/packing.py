"""Packing by minimum bin slack.

Documents longer than a sequence are cut into whole sequences and one remainder.
The remainders' lengths form a multiset of at most capacity - 1 different
lengths, however many documents there are. On that multiset (never on rows) a
subset-sum over a bitset, with the counts traced back, picks the lengths that
fill a sequence closest to its capacity; that pattern is repeated as often as
the counts allow, and the search goes on with the rest.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvergrain.llm.common import cut, with_ranks

#: Distinct word segments that a Python worker keeps between batches.
KEEP = 600_000
END_OF_TEXT = "<|endoftext|>"


class WordIds:
    """Ids of a byte-level BPE vocabulary as four-byte strings, kept per word.

    The vocabulary's pattern never joins a space to what stands before it, so a
    text may be cut before each space that follows a non-space.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        held = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(back[c] for c in word): k for word, k in held["model"]["vocab"].items() if word not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.kept: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        ids = self.coder.encode(text, allowed_special="all") if END_OF_TEXT in text else self.coder.encode_ordinary(text)
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian four-byte ids. The first KEEP different words are kept, the rare rest is encoded each time."""
        if not text:
            return b""
        if "  " in text or "\0" in text:
            return self.encode(text)
        parts = text.replace(" ", "\0 ").split("\0")
        kept, out = self.kept, []
        for p in parts:
            x = kept.get(p)
            if x is None:
                x = self.encode(p)
                if len(kept) < KEEP:
                    kept[p] = x
            out.append(x)
        return b"".join(out)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_coders: dict[str, WordIds] = {}


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per piece of at most capacity ids: id, start, length, ids_crc32, doc_tokens."""
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _coders:
            _coders[vocabulary] = WordIds(vocabulary)
        coder = _coders[vocabulary]
        for batch in batches:
            which, starts, lengths, crcs, totals = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = coder.ids(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    which.append(k)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))], names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def slack_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: how many}) so that all lengths are used and each pattern leaves the least slack.

    Every step uses up at least one length, or leaves less of it than one
    pattern needs, so there are at most a few times capacity patterns.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        largest = max(left)
        room = capacity - largest
        # the largest length stands; which sums can the others reach in the room that it leaves?
        mask = (1 << (room + 1)) - 1
        reached, steps = 1, []
        for n in sorted(left, reverse=True):
            have = left[n] - (n == largest)
            if n > room or have <= 0:
                continue
            many = min(have, room // n)
            power = 1
            while many > 0:  # a bounded number of equal lengths as binary parts
                part = min(power, many)
                steps.append((n, part, reached))
                reached |= (reached << (n * part)) & mask
                many -= part
                power *= 2
            if reached >> room & 1:
                break
        at = reached.bit_length() - 1
        pattern = {largest: 1}
        for n, part, before in reversed(steps):
            if not before >> at & 1:
                pattern[n] = pattern.get(n, 0) + part
                at -= n * part
        times = min(left[n] // c for n, c in pattern.items())
        out.append((times, pattern))
        for n, c in pattern.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return out


def pack(pieces: DataFrame, capacity: int = 1024, id_column: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to the pieces (columns as from cut_documents).

    Whole pieces fill sequences of their own; the rest follow the patterns. The
    histogram of lengths, at most capacity rows, is all that reaches the
    driver. Pieces alike in id and start (repeated rows) are packed as often as
    they come. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = counts.pop(capacity, 0)
    spans, first, used = [(capacity, 0, whole, 0, 1, 0)], whole, dict.fromkeys(counts, 0)
    for times, pattern in slack_patterns(counts, capacity):
        offset = 0
        for n, c in sorted(pattern.items(), reverse=True):
            spans.append((n, used[n], used[n] + times * c, first, c, offset))
            used[n] += times * c
            offset += n * c
        first += times
    ranked = with_ranks(pieces, ["length"], [id_column, "start", "ids_crc32"], "__rank")
    plan = spark.createDataFrame(spans, "length long, lo long, hi long, first long, each long, base long")
    # a length's spans as one sorted array per length: a row finds its span without a join by range
    per = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "each", "base"))).alias("__spans"))
    span = F.filter("__spans", lambda s: (s["lo"] <= F.col("__rank")) & (F.col("__rank") < s["hi"]))[0]
    rank = F.col("__rank") - F.col("__at.lo")
    return (
        ranked.join(F.broadcast(per), "length")  # at most capacity rows with a few times capacity spans between them
        .withColumn("__at", span)
        .select(
            *[F.col(c) for c in pieces.columns],
            (F.col("__at.first") + F.floor(rank / F.col("__at.each"))).cast("long").alias("sequence_id"),
            (F.col("__at.base") + (rank % F.col("__at.each")) * F.col("length")).cast("long").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024) -> DataFrame:
    """Cut and pack whole documents; null and empty texts are a piece with the end id alone.

    Very long texts are cut into as many pieces as they need. Repeated rows and
    ids are packed as often as they come, a null id is passed on. Other columns
    are ignored, whatever their names; an empty table gives an empty one.
    """
    return pack(cut(cut_documents(docs, vocabulary, capacity), "pieces"), capacity)
