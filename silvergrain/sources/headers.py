"""Picture dimensions from file headers, without decoding.

Of files, tasks read a few pages each, at the places that a header's walk asks
for (probed). Of contents that are a column, PNG, GIF, BMP and PSD have theirs at
fixed places and are read by expressions; JPEG, WebP, TIFF and ICO need a walk.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.sources.files import Ranged


def unsigned(content: Column, start: int, size: int, little: bool = False) -> Column:
    """An unsigned integer of size bytes from place start (from 1)."""
    digits = F.hex(F.substring(content, start, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("long")


def fixed_dimensions(content: Column) -> Column:
    """struct(width, height), null for other formats."""
    head = F.hex(F.substring(content, 1, 8))
    pair = lambda w, h: F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
    top_down = lambda h: F.when(h >= 1 << 31, F.lit(1 << 32) - h).otherwise(h)  # noqa: E731  a negative height says that rows go down
    return (
        F.when((head == "89504E470D0A1A0A") & (F.substring(content, 13, 4) == F.lit(b"IHDR")), pair(unsigned(content, 17, 4), unsigned(content, 21, 4)))
        .when(head.startswith("47494638"), pair(unsigned(content, 7, 2, True), unsigned(content, 9, 2, True)))
        .when(head.startswith("424D") & (unsigned(content, 15, 4, True) == 12), pair(unsigned(content, 19, 2, True), unsigned(content, 21, 2, True)))
        .when(head.startswith("424D"), pair(unsigned(content, 19, 4, True), top_down(unsigned(content, 23, 4, True))))
        .when(head.startswith("38425053"), pair(unsigned(content, 19, 4), unsigned(content, 15, 4)))
    )


def _jpeg(b: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
        else:
            at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return None


def _webp(b: bytes) -> tuple[int, int] | None:
    kind = b[12:16]
    if kind == b"VP8X" and len(b) >= 30:
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    if kind == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
        return int.from_bytes(b[26:28], "little") & 0x3FFF, int.from_bytes(b[28:30], "little") & 0x3FFF
    return None


def _tiff(b: bytes) -> tuple[int, int] | None:
    order = "<" if b[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", b[4:8])
    if at + 2 > len(b):
        return None
    (n,) = struct.unpack(order + "H", b[at : at + 2])
    found = {}
    for k in range(n):
        entry = b[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind = struct.unpack(order + "HH", entry[:4])
        if tag in (256, 257) and kind in (3, 4):
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return (found[256], found[257]) if len(found) == 2 else None


def _png(b) -> tuple[int, int] | None:
    return struct.unpack(">II", b[16:24]) if b[:8] == b"\x89PNG\r\n\x1a\n" and b[12:16] == b"IHDR" else None


def _gif(b) -> tuple[int, int] | None:
    return struct.unpack("<HH", b[6:10]) if b[:4] == b"GIF8" else None


def _bmp(b) -> tuple[int, int] | None:
    if b[:2] != b"BM":
        return None
    if struct.unpack("<I", b[14:18])[0] == 12:
        return struct.unpack("<HH", b[18:22])
    w, h = struct.unpack("<ii", b[18:26])
    return abs(w), abs(h)


def _psd(b) -> tuple[int, int] | None:
    return struct.unpack(">II", b[14:22])[::-1] if b[:4] == b"8BPS" else None


def _ico(b) -> tuple[int, int] | None:
    """The largest picture of an icon; a side of 0 means 256."""
    if b[:4] != b"\0\0\1\0":
        return None
    (n,) = struct.unpack("<H", b[4:6])
    sides = [(w or 256, h or 256) for w, h in (struct.unpack("<BB", b[6 + 16 * k : 8 + 16 * k]) for k in range(n))]
    return max(sides, key=lambda s: (s[0] * s[1], s)) if sides else None


def _checked_jpeg(b) -> tuple[int, int] | None:
    return _jpeg(b) if b[:2] == b"\xff\xd8" else None


def _checked_webp(b) -> tuple[int, int] | None:
    return _webp(b) if b[:4] == b"RIFF" and b[8:12] == b"WEBP" else None


def _checked_tiff(b) -> tuple[int, int] | None:
    return _tiff(b) if b[:4] in (b"II*\0", b"MM\0*") else None


PARSERS = {"jpg": _checked_jpeg, "jpeg": _checked_jpeg, "png": _png, "gif": _gif, "bmp": _bmp, "webp": _checked_webp, "tif": _checked_tiff, "tiff": _checked_tiff, "psd": _psd, "ico": _ico}


def _walked(b, extension: str = "") -> tuple[int, int] | None:
    """Dimensions of a sequence of bytes by the parser of its extension, else by what its first bytes are; those of no size count as unknown."""
    if not b:
        return None
    own = PARSERS.get(extension.lower())
    for parse in [*([own] if own else []), *dict.fromkeys(PARSERS.values())]:
        try:
            found = parse(b)
        except (struct.error, IndexError):
            found = None
        if found and found[0] > 0 and found[1] > 0:
            return found
    return None


def probed(files: DataFrame, path: str = "full_path") -> DataFrame:
    """(path, width, height, bytes_read, error) of the files, by ranged reads in the tasks.

    A file costs the pages of 1 KiB that its header's walk asks for: one for the
    formats of fixed places, one for each stretch of segments, never its
    contents. width and height are null where the header says nothing; error
    says why a file could not be opened, and ends nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if len(b)):
            rows = []
            for name in batch.column(0).to_pylist():
                found, taken, error = None, 0, None
                try:
                    with Ranged(name) as b:
                        found = _walked(b, name.rpartition(".")[2])
                        taken = b.taken
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((name, *(found or (None, None)), taken, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[path, "width", "height", "bytes_read", "error"])

    return files.select(path).mapInArrow(run, f"{path} string, width long, height long, bytes_read long, error string")


def dimensions(files: DataFrame, key: str = "full_path", content: str = "content") -> DataFrame:
    """(key, width, height); null where the header says nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_walked(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f and f[0] for f in found], pa.int64()), pa.array([f and f[1] for f in found], pa.int64())], names=["key", "width", "height"])

    probed = files.select(F.col(key).alias("key"), F.col(content).alias("content"), fixed_dimensions(F.col(content)).alias("d"))
    fixed = probed.where("d is not null").select("key", F.col("d.width").alias("width"), F.col("d.height").alias("height"))
    walked = probed.where("d is null").select("key", "content").mapInArrow(run, "key string, width long, height long")
    return fixed.unionByName(walked).withColumnRenamed("key", key)


def difference_hash(samples: Column) -> Column:
    """64 bits from 72 grey samples (8 rows of 9): bit i is set where a sample is brighter than its right neighbour, least bit first."""
    bit = lambda i: F.when(F.get(samples, F.lit(i // 8 * 9 + i % 8)) > F.get(samples, F.lit(i // 8 * 9 + i % 8 + 1)), F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0).cast("long"))
    out = bit(0)
    for i in range(1, 64):
        out = out.bitwiseOR(bit(i))
    return out
