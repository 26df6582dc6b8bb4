"""Lines that other documents hold as well, found by range-partitioned hashes.

Every line is named by 128 bits of its key. The names, with document and
position, are dealt by ranges and sorted inside each range by name, document and
position, so that one pass over a range meets the first holder of each name
before all others and keeps only that holder in memory. A name may fill many
ranges: rows at the start of a range wait for the first holder that the ranges
before it report, two names for each range. Texts never travel with the names;
what comes back is a compressed bitmap of kept lines for each document that
loses some.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from silvergrain.llm.common import cut, partitions

#: Code points that a key has at least to count.
LEAST = 10
_BLANK = " \t\n\x0b\x0c\r"
ORDER = ["h1", "h2", "doc", "row", "at"]


def line_keys(lines: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.utf8_trim(lines, _BLANK))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc, row (a hash of the text, which tells rows of one id apart), text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def named_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """h1, h2, doc, row, at (position from 0) of every line whose key has least code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = pc.split_pattern(b.column(2), "\n")
            text, lengths = np.repeat(np.arange(len(b)), pc.list_value_length(lines)), pc.list_value_length(lines).to_numpy()
            at = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keys = line_keys(lines.flatten())
            counts = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False))
            names = np.frombuffer(b"".join(map(xxh3_128_digest, keys.take(pa.array(counts)).cast(pa.binary()).to_pylist())), "<i8").reshape(-1, 2)
            text = pa.array(text[counts])
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), b.column(0).take(text), b.column(1).take(text), pa.array(at[counts].astype(np.int32))], names=ORDER)

    return _rows(docs, id_column, text_column).where("doc is not null").mapInArrow(run, "h1 long, h2 long, doc long, row long, at int")


def later_holders(lines: DataFrame) -> DataFrame:
    """doc, row, at of the lines whose name a smaller doc holds; lines as from named_lines."""
    ranged = lines.repartitionByRange(partitions(lines.sparkSession), *ORDER).sortWithinPartitions(*ORDER)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each line that has to go, for each of the range's first name (waits, with the name), and for its last name."""
        last: tuple[int, int, int] | None = None  # name and first holder of the group that the next batch may go on with
        head: tuple[int, int] | None = None  # the range's first name
        for b in batches:
            if not len(b):
                continue
            h1, h2, doc, row, at = (b.column(k).to_numpy() for k in range(5))
            new = np.ones(len(b), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.flatnonzero(new)
            first = doc[starts]
            if last and (h1[0], h2[0]) == last[:2]:
                first[0] = last[2]
            head = head or (h1[0], h2[0])
            first = np.repeat(first, np.diff(np.append(starts, len(b))))
            waits = (h1 == head[0]) & (h2 == head[1])
            keep = np.flatnonzero(waits | (doc != first))
            last = (h1[-1], h2[-1], first[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (doc, row, at, h1, h2, first)] + [pa.array(waits[keep].astype(np.int8))], names=names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, *last, 2), types, strict=True)], names=names)

    names, types = ["doc", "row", "at", "h1", "h2", "first", "waits"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int8()]
    found = cut(ranged.mapInArrow(stream, "doc long, row long, at int, h1 long, h2 long, first long, waits byte"), "holders")
    edges = found.where("waits > 0").groupBy("h1", "h2").agg(F.min("first").alias("least"))
    waiting = found.where("waits = 1").select("doc", "row", "at", "h1", "h2").join(F.broadcast(edges), ["h1", "h2"]).where("doc <> least")  # two rows for each range at most
    return found.where("waits = 0").select("doc", "row", "at").unionByName(waiting.select("doc", "row", "at"))


def keep_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """doc, row, n_dropped, bitmap of the documents that lose lines.

    bitmap: zlib of bits, the least one first; bit k is set where line k stays.
    Lines beyond it stay.
    """
    gone = later_holders(cut(named_lines(docs, id_column, text_column, least), "lines"))  # ranges are drawn from a first pass over the names
    order = ["doc", "row", "at"]

    def pack(key: tuple, places: list[np.ndarray]) -> tuple:
        at = np.unique(np.concatenate(places))
        bits = np.ones(at[-1] // 8 * 8 + 8, bool)  # whole bytes
        bits[at] = False
        return *key, len(at), zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        places: list[np.ndarray] = []
        for b in batches:
            if not len(b):
                continue
            doc, row, at = (b.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
            done = []
            for a, z in zip(starts, [*starts[1:], len(b)], strict=True):
                own = (int(doc[a]), int(row[a]))
                if own != key:
                    if key is not None:
                        done.append(pack(key, places))
                    key, places = own, []
                places.append(at[a:z])
            yield packed(done)
        if key is not None:
            yield packed([pack(key, places)])

    def packed(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc", "row", "n_dropped", "bitmap"])

    dealt = gone.repartition(partitions(docs.sparkSession), "doc", "row").sortWithinPartitions(*order).select(*order)
    return dealt.mapInArrow(stream, "doc long, row long, n_dropped long, bitmap binary")


def kept_lines(text: str, bitmap: bytes) -> str:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k >= len(bits) or bits[k])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, n_lines, n_dropped, kept_text of every row of docs; bitmaps as from keep_bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            kept = [t if m is None else kept_lines(t, m) for t, m in zip(texts, b.column(3).to_pylist(), strict=True)]
            lines = pa.array([t.count("\n") + 1 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), lines, b.column(2), pa.array(kept, pa.string())], names=["doc", "n_lines", "n_dropped", "kept_text"])

    both = _rows(docs, id_column, text_column).join(bitmaps, ["doc", "row"], "left").select("doc", "text", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "bitmap")
    return both.mapInArrow(run, "doc long, n_lines long, n_dropped long, kept_text string").withColumnRenamed("doc", id_column)


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """id_column, n_lines, n_dropped, kept_text: each document without the lines that a document of smaller id holds.

    Lines stand between line feeds; a line's key is the line without blanks at
    its ends, A-Z in lower case, and only keys of least code points or more
    count. A line goes where a document of smaller id has its key, wherever
    in the text; the smallest id keeps all its lines of that key. A null or empty text is one
    empty line. Rows that repeat an id are one document: none of them takes
    lines from another; rows alike in id and text lose the same. Rows with a
    null id lose and take nothing. Very long texts are split whole, in their
    row. Other columns are ignored, whatever their names; empty tables give no
    rows.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, id_column, text_column, least), id_column, text_column)
