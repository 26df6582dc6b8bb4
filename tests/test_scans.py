"""Walks, progressive scans and ranged reads of files against plain loops."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from silvergrain.operators import duplicates
from silvergrain.sources import headers, walk
from silvergrain.streaming import scan

NAMES = ("a.jpg", "B.PNG", ".hidden.gif", "_under.webp", "notes.txt", "c.tar.jpeg", "none")


@pytest.fixture
def tree(tmp_path):
    """Folders three deep with hidden names, a link to a file, a link to a folder above (a loop) and an unreadable folder."""
    rng = random.Random(5)
    top = tmp_path / "pictures"
    for d in ("", "x", "x/y", "x/y/z", ".dot", "_line", "empty"):
        (top / d).mkdir(parents=True, exist_ok=True)
        for name in NAMES if d != "empty" else ():
            (top / d / name).write_bytes(b"z" * rng.randrange(50))
    os.symlink(top, top / "x" / "loop")
    os.symlink(top / "a.jpg", top / "x" / "linked.jpg")
    os.symlink(top / "gone.jpg", top / "x" / "dangling.jpg")
    return top


def plain_walk(top):
    found, queue = [], [str(top)]
    while queue:
        folder = queue.pop(0)
        for name in sorted(os.listdir(folder)):
            path = f"{folder}/{name}"
            if os.path.isdir(path):
                if not os.path.islink(path):
                    queue.append(path)
            elif os.path.isfile(path) and os.path.splitext(name)[1].lower() in (".jpg", ".png", ".gif", ".webp", ".jpeg"):
                found.append((path, os.path.getsize(path)))
    return found


def test_walk_equals_a_plain_one(spark, tree):
    w = walk.walk(spark, [str(tree), f" {tree}/ ", f"{tree}/x", "", None, f"{tree}/missing"], recursive=True)
    want = plain_walk(tree)
    assert sorted((r["full_path"], r["size_bytes"]) for r in w.files.collect()) == sorted(want)
    assert {r["full_path"]: r["error"] for r in w.errors.collect()} == {f"{tree}/missing": "missing", f"{tree}/x/dangling.jpg": "not readable"}
    alone = walk.walk(spark, [str(tree)], recursive=True)
    assert [r["full_path"] for r in walk.in_walk_order(alone).orderBy("index").collect()] == [p for p, _ in want]
    flat = walk.walk(spark, [str(tree), f"{tree}/x/a.jpg"])
    assert {r["full_path"] for r in flat.files.collect()} == {p for p, _ in want if os.path.dirname(p) == str(tree)} | {f"{tree}/x/a.jpg"}
    assert walk.walk(spark, [" "]).files.count() == 0


def test_a_folder_that_fails_ends_nothing_else(spark, tree, monkeypatch):
    """A folder that vanishes between its listing and its turn is an error of its own."""
    import shutil

    cut, rounds = walk.cut, []

    def then_remove(df, label):
        out = cut(df, label)
        if label == "frontier":
            rounds.append(label)
            if len(rounds) == 2:
                shutil.rmtree(tree / "_line")
        return out

    monkeypatch.setattr(walk, "cut", then_remove)
    w = walk.walk(spark, [str(tree)], recursive=True)
    assert {r["full_path"] for r in w.files.collect()} == {p for p, _ in plain_walk(tree)}
    assert f"{tree}/_line" in {r["full_path"] for r in w.errors.collect()}


def plain_ends(folders, size):
    """The rule as a loop over entries and folder ends."""
    ends, held, total = [], 0, 0

    def early(boundary=False, root=False):
        nonlocal held
        if not held or total > 200:
            return
        goal = min(size, 24) if total <= min(size, 24) else min(size, 48)
        if held >= goal or (root and held) or (boundary and held >= min(size, 48, 12)):
            ends.append(total)
            held = 0

    for k, (folder, is_root) in enumerate(folders):
        total += 1
        held += 1
        if held >= size:
            ends.append(total)
            held = 0
        else:
            early()
        if k + 1 == len(folders) or folders[k + 1][0] != folder:
            early(True, is_root)
    return ends + [total] * bool(held)


@pytest.mark.parametrize("size", [160, 30, 7])
def test_batches_end_as_in_a_plain_loop(spark, size):
    rng = random.Random(size)
    for _ in range(4):
        folders = [(f"f{k}", k == 0) for k in range(rng.choice([1, 5, 40])) for _ in range(rng.choice([3, 11, 13, 90]))]
        rows = spark.createDataFrame([(k, f, r) for k, (f, r) in enumerate(folders)], "index long, folder string, is_root boolean")
        got = [r["n"] for r in scan.scan_batches(rows, size).groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
        ends = plain_ends(folders, size)
        assert got == [b - a for a, b in zip([0, *ends], ends, strict=False)]


def test_a_scan_goes_on_after_a_failed_batch(spark, tmp_path):
    folders = [(f"/in/f{k:02}", k == 0) for k in range(20) for _ in range((k * 7) % 30)]
    rows = [(k, f"{f}/p{k:04}.jpg", f"p{k:04}.jpg", k % 9, f, r) for k, (f, r) in enumerate(folders)]
    entries = spark.createDataFrame(rows, "index long, full_path string, file_name string, size_bytes long, folder string, is_root boolean")
    states = spark.createDataFrame([(rows[3][1], 4, "Keep")], "full_path string, rating int, status string")
    path, target, checkpoint = (str(tmp_path / n) for n in ("batches", "loaded", "checkpoint"))
    ends = plain_ends(folders, 160)
    assert scan.publish(scan.scan_batches(entries), path) == len(ends)
    failed = []

    def fail_once(batch, number):
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("machine lost")

    q = scan.load_scan(spark, path, states, target, checkpoint, fail_once)
    with pytest.raises(Exception):
        q.processAllAvailable()
    q.stop()
    q = scan.load_scan(spark, path, states, target, checkpoint, fail_once)
    q.processAllAvailable()
    q.stop()
    q = scan.load_scan(spark, path, states, target, checkpoint, fail_once)  # nothing is left
    q.processAllAvailable()
    q.stop()
    loaded = spark.read.parquet(target)
    per = [r["n"] for r in loaded.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    assert failed and per == [b - a for a, b in zip([0, *ends], ends, strict=False)]
    done = scan.finish_load(spark, target, "size", str(tmp_path / "final")).orderBy("index").collect()
    assert [r["full_path"] for r in done] == [r[1] for r in sorted(rows, key=lambda r: (-r[3], r[2].lower(), r[2], r[1]))]
    assert [r["rating"] for r in done if r["status"] == "Keep"] == [4]


def test_triggers_grow_with_the_logarithm_of_the_batches(spark, tmp_path):
    rows = [(k, f"/in/p{k:04}.jpg", f"p{k:04}.jpg", k % 9, "/in", True) for k in range(401)]
    entries = spark.createDataFrame(rows, "index long, full_path string, file_name string, size_bytes long, folder string, is_root boolean")
    states = spark.createDataFrame([], "full_path string, rating int, status string")
    path, target = str(tmp_path / "batches"), str(tmp_path / "loaded")
    assert scan.publish(scan.scan_batches(entries, 2), path) == 201
    q = scan.load_scan(spark, path, states, target, str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    loaded = spark.read.parquet(target).select("batch", "index").collect()
    assert sorted((r["batch"], r["index"]) for r in loaded) == [(k // 2, k) for k in range(401)]
    triggers = len([n for n in os.listdir(target) if "=" in n])
    assert 8 <= triggers <= 26 and len(os.listdir(path)) <= 201 // 32 + 4


# ---- ranged reads


def pictures():
    """name, bytes, dimensions; the long ones hold megabytes after or between their headers."""
    import struct

    pad = b"\0" * 3_000_000
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 640, 480) + b"\x08\2\0\0\0")
    segment = lambda k, n: b"\xff" + bytes([k]) + struct.pack(">H", n + 2) + b"\1" * n
    jpeg = b"\xff\xd8" + b"".join(segment(0xE1, 60_000) for _ in range(8)) + b"\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 33, 44) + b"\3" * 6
    tiff = b"MM\0*" + struct.pack(">I", 2_000_000) + b"\0" * 1_999_992 + struct.pack(">H", 2) + struct.pack(">HHIHH", 256, 3, 1, 70, 0) + struct.pack(">HHII", 257, 4, 1, 80)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\x0a\0\0\0" + b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    return [
        ("a.png", png + pad, (640, 480)),
        ("is-a-png.jpg", png + pad, (640, 480)),
        ("no-header.png", b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", b"12345678"), None),
        ("b.gif", b"GIF89a" + struct.pack("<HH", 7, 9) + pad, (7, 9)),
        ("old.bmp", b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 21, 22) + pad, (21, 22)),
        ("new.bmp", b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 31, -32) + pad, (31, 32)),
        ("c.psd", b"8BPS\0\1" + b"\0" * 6 + b"\0\3" + struct.pack(">II", 12, 34) + pad, (34, 12)),
        ("d.JPG", jpeg + pad, (44, 33)),
        ("e.tiff", tiff + pad, (70, 80)),
        ("f.webp", webp + pad, (100, 50)),
        ("g.ico", b"\0\0\1\0\2\0" + bytes([16, 16]) + b"\0" * 14 + bytes([0, 0]) + b"\0" * 14 + pad, (256, 256)),
        ("cut.jpg", b"\xff\xd8\xff\xe1\xff\xff", None),
        ("empty.png", b"", None),
        ("text.gif", b"no picture at all", None),
    ]


def test_headers_are_read_by_pages(spark, tmp_path):
    known = pictures()
    for name, content, _ in known:
        (tmp_path / name).write_bytes(content)
    paths = spark.createDataFrame([(f"{tmp_path}/{name}",) for name, _, _ in known] + [(f"{tmp_path}/gone.png",)], "full_path string")
    got = {os.path.basename(r["full_path"]): r for r in headers.probed(paths).collect()}
    for name, content, size in known:
        assert (got[name]["width"], got[name]["height"]) == (size or (None, None)), name
        assert got[name]["error"] is None and got[name]["bytes_read"] <= 16 * 1024
        if name not in ("d.JPG", "e.tiff"):
            assert got[name]["bytes_read"] <= 1024
    assert got["gone.png"]["error"] and got["gone.png"]["width"] is None
    contents = spark.createDataFrame([(n, bytearray(c)) for n, c, _ in known], "full_path string, content binary")
    assert {r["full_path"]: (r["width"], r["height"]) for r in headers.dimensions(contents).collect()} == {n: s or (None, None) for n, _, s in known}


def test_exact_groups_of_files_read_by_stages(spark, tmp_path):
    import hashlib

    kib = 1024
    big = bytearray(os.urandom(600 * kib))
    other = bytearray(big)
    other[200 * kib] ^= 1  # between the samples
    ahead = bytearray(big)
    ahead[0] ^= 1
    held = {"a.jpg": b"same", "b.jpg": b"same", "c.jpg": b"diff", "d.jpg": b"longer", "z1.jpg": b"", "z2.jpg": b"", "big1.jpg": bytes(big), "big2.jpg": bytes(big), "big3.jpg": bytes(other), "big4.jpg": bytes(ahead), "alone.jpg": b"x" * 900 * kib}
    for name, content in held.items():
        (tmp_path / name).write_bytes(content)
    rows = [(f"{tmp_path}/{n}", n, len(c), k) for k, (n, c) in enumerate(held.items())] + [(f"{tmp_path}/gone.jpg", "gone.jpg", 4, 99)]
    records = spark.createDataFrame(rows, "full_path string, file_name string, size_bytes long, rank long").withColumn("modified_at", F.timestamp_seconds(F.lit(0)))
    groups, report, failures = duplicates.exact_file_groups(records)
    got = {(os.path.basename(r["key"]), r["group_first"], r["member"]) for r in groups.collect()}
    assert got == {("a.jpg", 0, 1), ("b.jpg", 0, 2), ("z1.jpg", 4, 1), ("z2.jpg", 4, 2), ("big1.jpg", 6, 1), ("big2.jpg", 6, 2)}
    assert {r["hash"] for r in groups.where("size_bytes > 1000").collect()} == {hashlib.sha256(bytes(big)).hexdigest().upper()}
    assert {r["stage"]: (r["files"], r["bytes_read"]) for r in report.collect()} == {"sizes": (12, 0), "samples": (10, 12 + 4 * 384 * kib), "contents": (3, 3 * 600 * kib)}
    assert [os.path.basename(r["full_path"]) for r in failures.collect()] == ["gone.jpg"]
