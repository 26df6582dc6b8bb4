"""Literal cases and edges of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from silvergrain.functions import naming, photo_tags
from silvergrain.operators import duplicates, lookups, ordering, predicates, state
from silvergrain.operators.components import components
from silvergrain.plans import export
from silvergrain.sources import catalog, headers, sinks
from silvergrain.streaming import progressive


def column(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


def test_sequence_names(spark):
    one = spark.range(1)
    name = lambda *a: one.select(naming.sequence_name(*a).alias("n")).first()["n"]
    assert name("trip", "_", 7, 4, F.lit(2), F.lit(5)) == "trip_0009"
    assert name("trip", "", 12, 2, F.lit(0), F.lit(3)) == "trip12"
    assert name("trip", "_", 7, 4, F.lit(0), F.lit(1)) == "trip"
    with pytest.raises(Exception):
        name("trip", "_", 2147483647, 2, F.lit(1), F.lit(2))


def test_size_buckets_are_half_open(spark):
    mib = 1 << 20
    sizes = [2 * mib - 1, 2 * mib, 8 * mib - 1, 8 * mib, 20 * mib - 1, 20 * mib]
    got = [column(spark, s, naming.size_bucket, "long") for s in sizes]
    assert got == ["small", "medium", "medium", "large", "large", "huge"]


def test_names(spark):
    assert column(spark, "/a/b.tar.gz", naming.extension) == ".gz"
    assert column(spark, "/a/b.tar.gz", naming.base_name) == "b.tar"
    assert column(spark, "/a/b", naming.format_label) == "unknown"
    assert column(spark, "/a/b.CR3", naming.is_picture) is True
    assert column(spark, 1536, naming.human_size, "long") == "1.5 KB"
    assert column(spark, 3, naming.stars, "int") == "★★★☆☆"


def test_photo_tags(spark):
    assert column(spark, 0.008, photo_tags.exposure, "double") == "1/125 s"
    assert column(spark, 2.8, photo_tags.aperture, "double") == "f/2.8"
    assert column(spark, "2024:05:06 07:08:09", photo_tags.taken_at) == "2024-05-06 07:08:09"
    assert column(spark, "soon\0", photo_tags.taken_at) == "soon"
    assert column(spark, "2024:12:31 23:59:00", lambda c: photo_tags.shifted(c, 2)) == "2025:01:01 00:01:00"
    assert column(spark, [31.0, 13.0, 19.2], lambda c: photo_tags.coordinate(c, F.lit("N")), "array<double>") == "N 31° 13′ 19.2″"
    assert column(spark, b"ASCII\0\0\0hello", photo_tags.user_comment, "binary") == "hello"
    assert column(spark, "Nikon Z8", lambda c: photo_tags.camera(F.lit("NIKON"), c)) == "Nikon Z8"


def test_unknown_labels_raise():
    with pytest.raises(ValueError):
        predicates.rated("six")
    with pytest.raises(ValueError):
        predicates.in_size("tiny")
    assert predicates.text_search("  ") is None and not predicates.any_active(None, " ")


def test_visible(spark):
    c = spark.createDataFrame([("/root/a.jpg",), ("/root/sub/b.jpg",), ("/root-elsewhere/c.jpg",)], "full_path string")
    roots = spark.createDataFrame([("/root",)], "root string")
    assert {r[0] for r in predicates.visible(c, roots).collect()} == {"/root/a.jpg", "/root/sub/b.jpg"}
    assert {r[0] for r in predicates.visible(c, roots, recursive=False).collect()} == {"/root/a.jpg"}


def test_neighbours(spark):
    ix = spark.range(8).withColumnRenamed("id", "index")
    at = lambda n, sel, k, **o: [r["index"] for r in ordering.neighbours(ix.where(f"index < {n}"), sel, k, **o).orderBy("place").collect()]
    assert at(8, 4, 6) == [4, 5, 3, 6, 2, 7]
    assert at(6, -1, 4) == [0, 1, 2, 3]
    assert at(8, 4, 3, centre=False) == [5, 3, 6]


def test_sort_orders(spark):
    c = spark.createDataFrame([("p", "/a/" + n, n, s) for n, s in (("alpha", 20), ("beta", 20), ("gamma", 10), ("Cat.jpg", 1), ("cat.jpg", 1))], "p string, full_path string, file_name string, size_bytes long")
    names = [r["file_name"] for r in ordering.ranked(c, "size", "p").orderBy("rank").collect()]
    assert names == ["alpha", "beta", "gamma", "Cat.jpg", "cat.jpg"]
    assert [r["file_name"] for r in ordering.sorted_entries(c, "name").collect()] == ["alpha", "beta", "Cat.jpg", "cat.jpg", "gamma"]


def test_batches(spark):
    sizes = lambda n, **o: [r["count"] for r in ordering.batches(spark.range(n).withColumnRenamed("id", "index"), **o).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes(5, size=2, early=(2, 2), early_until=0) == [2, 2, 1]
    assert sizes(30)[0] == 24
    assert sizes(400) == [24, 48, 48, 48, 160, 72]


def test_exact_groups_tell_samples_apart(spark):
    big = bytes(range(256)) * 2048
    other = big[:150_000] + b"!" + big[150_001:]
    rows = [(1, len(big), big), (2, len(big), big), (3, len(big), other), (4, 7, b"x" * 7), (5, 7, None)]
    e = spark.createDataFrame(rows, "key long, size_bytes long, content binary").withColumns({"modified_at": F.lit(0), "file_name": F.col("key").cast("string"), "rank": F.col("key")})
    got = duplicates.exact_groups(e).orderBy("member").collect()
    assert [(r["group_first"], r["member"], r["key"]) for r in got] == [(1, 1, 1), (1, 2, 2)]
    assert duplicates.exact_summary(duplicates.exact_groups(e)).first().asDict() == {"groups": 1, "members": 2, "redundant": 1, "largest": 2}


def test_saturated_sum(spark):
    r = spark.createDataFrame([(2**62,), (2**62,), (2**62,), (-5,), (None,)], "v long").agg(duplicates.saturated_sum(F.col("v")).alias("s")).first()
    assert r["s"] == 2**63 - 1


def test_banded_pairs_find_all(spark):
    import random

    random.seed(4)
    hashes = []
    for _ in range(40):
        h = random.getrandbits(64)
        hashes.append(h)
        for flips in range(1, 14):
            x = h
            for b in random.sample(range(64), flips):
                x ^= 1 << b
            hashes.append(x)
    signed = sorted({h - (1 << 64) if h >> 63 else h for h in hashes})
    f = spark.createDataFrame([(k, h) for k, h in enumerate(signed)], "key long, fingerprint long")
    for most in (0, 4, 8, 12):
        got = {(r["left"], r["right"]) for r in duplicates.pairs_of_entries(f, most).collect()}
        want = {(i, j) for i in range(len(signed)) for j in range(i + 1, len(signed)) if bin((signed[i] ^ signed[j]) & (1 << 64) - 1).count("1") <= most}
        assert got == want


def test_components_follow_chains(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (102, 101)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {got[k] for k in range(1, 61)} == {1} and {got[k] for k in (100, 101, 102)} == {100}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_available_targets_match_trial(spark):
    names = ["/in/a.jpg", "/in2/a.jpg", "/in3/a.jpg", "/in/b.png", "/out/c.jpg", "/in/a.png"]
    taken = ["/out/a.jpg", "/out/a_x02.jpg", "/out/c.jpg"]

    def one(source, reserved):
        base, ext = source.rsplit("/", 1)[1].rsplit(".", 1)
        for n in range(1000):
            p = f"/out/{base}{f'_x{n:02d}' if n else ''}.{ext}"
            if p != source and p not in taken and p not in reserved:
                reserved.add(p)
                return p

    reserved: set = set()
    want = {s: one(s, reserved) for s in names}
    s = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "rank int, full_path string")
    got = {r["full_path"]: r["target_path"] for r in export.available_targets(s, spark.createDataFrame([(t,) for t in taken], "path string"), "/out", "x").collect()}
    assert got == want


def test_rename_problems(spark):
    s = spark.createDataFrame([(0, "/a/x.jpg"), (1, "/a/y.jpg")], "index int, full_path string")
    there = spark.createDataFrame([("/a/n_1.jpg",)], "path string")
    plan = {r["index"]: r["problem"] for r in export.rename_plan(s, there, "n", "_", 1, 1, F.lit(2)).collect()}
    assert plan == {0: "exists", 1: None}


@pytest.mark.parametrize(("load", "level"), [(320, "Low"), (610, "Moderate"), (735, "High"), (840, "Critical")])
def test_memory_pressure(spark, load, level):
    c = [F.lit(x).cast("long") for x in (1024, 900, load, 280, 280)]
    assert spark.range(1).select(export.memory_pressure(*c).alias("p")).first()["p"] == level


def test_budget_equals_stepwise_eviction(spark):
    import random

    random.seed(9)
    size = {k: random.randint(1, 40) for k in range(30)}
    trace = [random.randrange(30) for _ in range(400)]
    held: list = []
    for k in trace:
        if k in held:
            held.remove(k)
        held.append(k)
        while sum(size[x] for x in held) > 120:
            held.pop(0)
    last = {k: i for i, k in enumerate(trace)}
    df = spark.createDataFrame([(1, k, i, size[k]) for k, i in last.items()], "bucket int, key int, accessed int, bytes int")
    assert {r["key"] for r in state.within_budget(df, 120).collect()} == set(held)


def test_stale_and_upsert(spark):
    s = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 1, 2), ("b", 1, 1, 1)], "full_path string, size_bytes long, stamp long, written_at long")
    assert {(r["full_path"], r["size_bytes"]) for r in state.without_stale(s).collect()} == {("a", 2), ("b", 1)}
    old = spark.createDataFrame([("a", 3, "Keep"), ("b", 1, "None")], "full_path string, rating int, status string")
    new = spark.createDataFrame([("a", 0, "None", 1), ("c", 9, "Keep", 1), ("c", 8, "Reject", 2)], "full_path string, rating int, status string, changed_at int")
    assert {tuple(r) for r in state.upsert_review(old, new).collect()} == {("b", 1, "None"), ("c", 5, "Reject")}


def test_sessions(spark):
    s = spark.createDataFrame([("a", "x", 1, True), ("b", "y", 2, False)], "label string, inputs string, opened_at int, pinned boolean")
    n = spark.createDataFrame([("c", "x", 3, False)], "label string, inputs string, opened_at int, pinned boolean")
    assert [(r["label"], r["pinned"]) for r in ordering.register_session(s, n).collect()] == [("c", True), ("b", False)]


def test_remap_keeps_first(spark):
    c = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "doc_id int, full_path string")
    m = spark.createDataFrame([("/b", "/c")], "old_path string, new_path string")
    assert {tuple(r) for r in lookups.remapped(c, m, "doc_id").collect()} == {(1, "/a"), (2, "/c")}


def test_scan_and_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 30, 40) + b"\3"
    (tmp_path / "sub").mkdir()
    for name, data in {"a.PNG": png, "sub/b.jpg": jpeg, "c.txt": b"x", "g.gif": b"GIF89a" + struct.pack("<HH", 9, 7), "t.tif": b"II*\0\x08\0\0\0\2\0" + struct.pack("<HHII", 256, 4, 1, 77) + struct.pack("<HHII", 257, 3, 1, 55), "bad.jpg": b"\xff\xd8"}.items():
        (tmp_path / name).write_bytes(data)
    top = catalog.scan(spark, [str(tmp_path), " "])
    assert {r["file_name"] for r in top.collect()} == {"a.PNG", "g.gif", "t.tif", "bad.jpg"}
    assert catalog.scan(spark, [str(tmp_path), str(tmp_path / "sub")], recursive=True).count() == 5
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select(F.regexp_extract("path", "([^/]*)$", 1).alias("full_path"), "content")
    got = {r["full_path"]: (r["width"], r["height"]) for r in headers.dimensions(files).collect()}
    assert got == {"a.PNG": (640, 480), "b.jpg": (40, 30), "g.gif": (9, 7), "t.tif": (77, 55), "c.txt": (None, None), "bad.jpg": (None, None)}
    assert catalog.load_state(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert catalog.focus("first", [("dir", False), ("note.txt", True)]) == "note.txt"


def test_difference_hash_uses_all_bits(spark):
    falling = [9 - c for _ in range(8) for c in range(9)]
    assert column(spark, falling, headers.difference_hash, "array<int>") == -1
    assert column(spark, falling[::-1], headers.difference_hash, "array<int>") == 0


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    h = sinks.write_snapshot(s, str(tmp_path / "s"), "k")
    assert [r["k"] for r in spark.read.json(str(tmp_path / "s")).collect()] == ["a", "b"]
    assert sinks.write_snapshot(s.orderBy("k"), str(tmp_path / "t"), "k", unless=h) == h and not (tmp_path / "t").exists()
    done = sinks.run_each(s, lambda r: 1 // (r["v"] - 1), "long", "k")
    assert sinks.batch_report(done).first().asDict() == {"total": 2, "succeeded": 1, "failed": 1}
    e = spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 1 as x union all select timestamp'2024-01-02 10:00:00', 2")
    sinks.append_events(e, str(tmp_path / "log"))
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.is_dir()) == ["day=2024-01-01", "day=2024-01-02"]


def test_progressive_stream_equals_batch(spark, tmp_path):
    rows = [(f"/p/{k}", k) for k in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "full_path string, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    states = spark.createDataFrame([("/p/3", 4, "Keep")], "full_path string, rating int, status string")
    q = progressive.load_progressively(progressive.stream_records(spark, str(tmp_path / "in"), "full_path string, n int"), states, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 30 and out.where("rating = 4 and status = 'Keep'").count() == 1 and out.select("batch").distinct().count() == 3


def test_quality_and_phases(spark):
    p = spark.createDataFrame([("a", q, q * 10) for q in range(1, 101)] + [("b", 1, 900), ("b", 2, 950)], "key string, quality int, bytes int")
    assert {tuple(r) for r in export.best_quality(p, F.lit(505)).collect()} == {("a", 50, True), ("b", 1, False)}
    c = spark.createDataFrame([("/a/x.jpg", 10), ("/a/y.png", 10)], "full_path string, size_bytes long")
    assert {r["mode"] for r in export.plan_export(c, export.ExportRequest()).collect()} == {"CopySource"}
    assert export.phases(export.plan_export(c, export.ExportRequest(watermark=True, format="Png"))).first()["phase"] == "Watermark"


def test_exact_hashes_of_large_contents(spark):
    """Beyond three samples the full hash tells contents apart; its value is the plain one."""
    import hashlib

    big = bytes(range(251)) * 2000
    other = big[:100_000] + b"?" + big[100_001:]
    small = b"a few bytes"
    rows = [(k, len(x), x) for k, x in enumerate([big, big, other, small, small])]
    e = spark.createDataFrame(rows, "key long, size_bytes long, content binary").withColumns({"modified_at": F.lit(0), "file_name": F.col("key").cast("string"), "rank": F.col("key")})
    got = {r["key"]: r["hash"] for r in duplicates.exact_groups(e).collect()}
    assert got == {0: hashlib.sha256(big).hexdigest().upper(), 1: hashlib.sha256(big).hexdigest().upper(), **{k: hashlib.sha256(len(small).to_bytes(8, "little") + small).hexdigest().upper() for k in (3, 4)}}


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_blocks_of_bits_find_all_pairs(spark, agree):
    import random

    random.seed(agree)
    base = [random.getrandbits(64) for _ in range(10)]
    values = {b ^ sum(1 << k for k in random.sample(range(64), n)) for b in base for n in range(9)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {(r["a"], r["b"], r["distance"]) for r in duplicates.banded_pairs(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), 6, agree).collect()}
    far = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    assert found == {(x, y, far(x, y)) for x in signed for y in signed if x < y and far(x, y) <= 6}


def test_numbers_are_gapless_with_nulls_and_hot_groups(spark):
    rows = [(None if k % 5 == 0 else "hot" if k % 5 < 4 else "few", (k * 37) % 200) for k in range(200)]
    got = ordering.numbered(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.col("v")], "n").collect()
    for g in (None, "hot", "few"):
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["v"])] == list(range(sum(x == g for x, _ in rows)))


def test_shared_results_and_failures(spark):
    e = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "key long, text string")
    run = lambda rows: rows.where("key <> 1").select("key", F.length("text").alias("n"))
    got = {r["key"]: r["n"] for r in duplicates.computed_once(e, "key", F.col("text"), run).collect()}
    assert got == {2: 1, 3: 1, 4: None, 5: None}


def test_contents_are_written_nowhere_and_computed_once(spark, monkeypatch):
    """Of copies the first is computed; what is written between jobs holds no content."""
    written, seen, real = [], [], duplicates.cut
    monkeypatch.setattr(duplicates, "cut", lambda df, label: written.append(real(df, label)) or written[-1])
    rows = [(k, "long content " * 20 + str(k // 3 if k < 9 else k)) for k in range(20)] + [(20, None), (21, None)]
    e = spark.createDataFrame(rows, "key long, content string").select("key", F.octet_length("content").cast("long").alias("size_bytes"), "content", F.timestamp_seconds("key").alias("modified_at"), F.lit("p").alias("file_name"), F.col("key").alias("rank"))
    compute = lambda rows: seen.append(rows) or duplicates.text_fingerprints(rows, "key", "content")
    got = duplicates.similar_entries(e, 0, compute).select("group_first", "key").collect()
    assert {(r["group_first"], r["key"]) for r in got} == {(k // 3 * 3, k) for k in range(9)}
    assert len(seen) == 1 and {r["key"] for r in seen[0].select("key").collect()} == {0, 3, 6, *range(9, 22)}
    assert not any("long content" in str(v) for df in written for row in df.collect() for v in row)


def test_fingerprints_of_odd_texts(spark):
    """Words end at a text's end and at five characters; runs of more than 255 words add up right."""
    random.seed(3)
    some = lambda n: "".join(random.choice("ab\u00e9 \t\n\x0b\f\r\u00a0") for _ in range(n))
    texts = [None, "", " ", "a", "a", " a", "a ", "a\x0bb", "a\u00a0b", "\n\n", *[some(k) for k in range(60)], *[" ".join(f"w{random.randrange(9000)}" for _ in range(n)) for n in (254, 255, 256, 509, 510, 511, 3000)], "x" * 70_000]

    def plain(text):
        words = {w for w in re.split("[\t\n\f\r ]+", text or "") if w}
        values = [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in words]
        value = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))
        return (value - (1 << 64) if value >> 63 else value) if words else None

    for parts in (1, 7):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
        assert {r["key"]: r["fingerprint"] for r in duplicates.text_fingerprints(df).collect()} == {k: plain(t) for k, t in enumerate(texts)}


def test_missing_folders_and_reports(spark, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"1")
    assert catalog.scan(spark, [str(tmp_path / "gone"), str(tmp_path)]).count() == 1
    assert catalog.scan(spark, [str(tmp_path / "gone")]).count() == 0
    sinks.write_reports(spark.createDataFrame([("scan", 3)], "scenario string, items int"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r" / "markdown")).count() == 3


def test_many_roots_equal_few(spark, monkeypatch):
    c = spark.createDataFrame([("/root/a.jpg",), ("/root/sub/b.jpg",), ("/root-elsewhere/c.jpg",)], "full_path string")
    roots = spark.createDataFrame([("/root",), ("/none",)], "root string")
    few = {r[0] for r in predicates.visible(c, roots).collect()}
    monkeypatch.setattr(predicates, "FEW_ROOTS", 1)
    assert {r[0] for r in predicates.visible(c, roots).collect()} == few == {"/root/a.jpg", "/root/sub/b.jpg"}


def test_group_helpers(spark):
    g = spark.createDataFrame([(1, 1, 1), (1, 2, 5), (1, 3, 7)], "group_first long, member int, key long")
    assert {r["key"] for r in duplicates.suggested(g).collect()} == {5, 7}
    assert duplicates.suggested(g, similar=True).count() == 3
    kept = spark.createDataFrame([(1, 5), (2, 9)], "group_first long, kept long")
    assert {tuple(r) for r in duplicates.others_if_kept(g, kept).collect()} == {(1, 5, 1), (1, 5, 7)}
    assert sinks.path_list(spark.createDataFrame([("b", 2), ("a", 3), ("b", 1)], "full_path string, rank int")).first()["paths"] == "b\na"
    assert duplicates.prefilter_pays(spark.createDataFrame([(1,), (1,)], "size_bytes long")).first()["pays"] is False
    assert duplicates.prefilter_pays(spark.createDataFrame([(1,), (1,), (2,)], "size_bytes long")).first()["pays"] is True


def test_running_sums_over_a_hot_group(spark):
    rows = [(None if k % 5 == 0 else "hot" if k % 5 < 4 else "few", (k * 37) % 200, None if k % 11 == 0 else k % 7) for k in range(200)]
    got = {(r["g"], r["v"]): r["s"] for r in ordering.running_sums(spark.createDataFrame(rows, "g string, v int, n int"), ["g"], [F.col("v").desc()], "n", "s").collect()}
    assert got == {(g, v): sum(n or 0 for h, w, n in rows if h == g and w >= v) for g, v, _ in rows}


def test_pairs_of_classes_and_their_members(spark):
    f = spark.createDataFrame([(5, 0), (3, 0), (9, 0), (4, 7), (8, 7), (1, -1)], "key long, fingerprint long")
    assert {tuple(r) for r in duplicates.pairs_of_entries(f, 3).collect()} == {(3, 5, 0), (3, 9, 0), (4, 8, 0), (3, 4, 3)}


def test_signature_with_more_levels(spark, monkeypatch):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(f"/a/{k}", k, 7 * k) for k in range(600)]
    e = spark.createDataFrame(rows, "full_path string, size_bytes long, stamp long")
    monkeypatch.setattr(duplicates, "SIGNED", 1)
    blocks: dict = {}
    for p, size, stamp in rows:
        blocks.setdefault(hashlib.md5(p.encode()).hexdigest()[:4], []).append(f"{p}\n{size}\n{stamp}\n")
    above: dict = {}
    for b in sorted(blocks):
        above.setdefault(b[:2], []).append(sha("".join(sorted(blocks[b]))))
    want = sha("".join(sha("".join(above[b])) for b in sorted(above))).upper()
    assert duplicates.collection_signature(e).first()["signature"] == want
    assert duplicates.collection_signature(e.orderBy(F.desc("stamp")).repartition(7)).first()["signature"] == want


def test_texts_without_words_have_no_fingerprint(spark):
    texts = [(1, ""), (2, None), (3, " \n"), (4, "a b a"), (5, "b\ta"), (6, "a b c")]
    found = duplicates.text_fingerprints(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r["key"]: r["fingerprint"] for r in found.collect()}
    assert got[1] is got[2] is got[3] is None and got[4] == got[5] is not None
    assert {(r["group_first"], r["key"]) for r in duplicates.similar_groups(found, 2).collect()} == {(4, 4), (4, 5)}
    assert duplicates.pairs_of_entries(found, 64 // 8).where("left < 4").count() == 0


@pytest.mark.parametrize("most,blocks", [(12, 3), (12, 4), (8, 3), (8, 2), (5, 2), (3, 4), (0, 1)])
def test_pairs_over_balls_of_blocks(spark, most, blocks):
    """Every distance in every block, the topmost bit alone included, is found once."""
    import random

    random.seed(most)
    base = [random.getrandbits(64), 0, (1 << 63) - 1]
    values = {b ^ sum(1 << k for k in random.sample(range(64), n)) for b in base for n in range(14) for _ in range(4)} | {1 << 63, (1 << 63) | 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = sorted(tuple(r) for r in duplicates.banded_pairs(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), most, blocks).collect())
    far = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    assert found == sorted((x, y, far(x, y)) for x in signed for y in signed if x < y and far(x, y) <= most)


@pytest.mark.parametrize("most", [4, 8, 12])
def test_cells_cost_less_than_the_square_of_the_fingerprints(most):
    """Radii cover most; tiles, meetings and bytes of 2.8 million fingerprints stay far from all pairs."""
    tiles, keys = {}, {}
    for n in (47_000, 470_000, 2_800_000):
        cells = duplicates.cells_of(n, most)
        assert sum(r + 1 for _, _, r in cells) == most + 1
        assert all(a + bits <= z for (a, bits, _), z in zip(cells, [c[0] for c in cells[1:]] + [64], strict=True))
        tiles[n] = n * n / 2 * sum(duplicates.ball(bits, r) / 2**bits for _, bits, r in cells)
        keys[n] = sum(duplicates.ball(bits, r) for _, bits, r in cells)
    assert tiles[2_800_000] < 2.5e11 and tiles[2_800_000] / tiles[470_000] < 6**1.8 and keys[2_800_000] <= 330


def test_near_copies_leave_a_forest_of_links(spark):
    """1,100 fingerprints around one, more than two pieces, and the same groups with far ones and stored ones."""
    import random

    rng = random.Random(5)
    base = rng.getrandbits(64)
    near = sorted({base ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for _ in range(1200)} | {base})
    far = sorted({rng.getrandbits(64) for _ in range(40)})
    signed = [v - (1 << 64) if v >> 63 else v for v in near + far]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    pairs = {(r["a"], r["b"]) for r in duplicates.banded_pairs(prints, 8).collect()}
    away = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    assert pairs == {(x, y) for x in signed for y in signed if x < y and away(x, y) <= 8}
    links = [tuple(r) for r in duplicates.banded_links(prints, 8).collect()]
    assert len(links) < 8 * len(near) < len(pairs) // 8
    assert components_of(links) == components_of(pairs)
    # old ones meet new ones only
    old, new = set(signed[::3]), set(signed) - set(signed[::3])
    rows = lambda vs: spark.createDataFrame([(v,) for v in vs], "fingerprint long")
    grown = {(r["a"], r["b"]) for r in duplicates.banded_pairs(rows(new), 8, known=rows(old)).collect()}
    assert grown == {(x, y) for x, y in pairs if x in new or y in new}


def test_texts_are_signed_by_bytes_as_well_as_number(spark):
    import numpy as np

    mb = 1 << 20
    assert list(duplicates.signed_at_a_time(np.array([mb, mb, 1, 5 * mb, 0, 7]))) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert [n for _, n in duplicates.signed_at_a_time(np.zeros(1100, np.int32))] == [512, 512, 76] and not list(duplicates.signed_at_a_time(np.array([], np.int32)))
    long = " ".join(f"w{k}" for k in range(400_000))
    rows = [(k, long + f" x{k % 2}") for k in range(4)] + [(9, None)]
    got = {r["key"]: r["fingerprint"] for r in duplicates.text_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[0] == got[2] is not None and got[1] == got[3] and got[9] is None


def components_of(edges):
    """The components of links, by a plain walk."""
    beside = {}
    for x, y in edges:
        beside.setdefault(x, set()).add(y)
        beside.setdefault(y, set()).add(x)
    found, seen = set(), set()
    for start in beside:
        if start not in seen:
            todo, own = [start], set()
            while todo:
                x = todo.pop()
                if x not in own:
                    own.add(x)
                    todo += beside[x] - own
            seen |= own
            found.add(frozenset(own))
    return found


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_groups_that_grow_equal_one_run(spark, parts):
    import random

    rng = random.Random(parts)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(5)] + base[:4] * 2
    rows = [(k, h - (1 << 64) if h >> 63 else h) for k, h in enumerate(prints)] + [(900, None)]
    rng.shuffle(rows)
    whole = {r["key"]: r["group_first"] for r in duplicates.similar_groups(spark.createDataFrame(rows, "key long, fingerprint long"), 5).collect()}
    held = spark.createDataFrame([], "key long, fingerprint long, comp long")
    for p in range(parts):
        new = rows[p * len(rows) // parts : (p + 1) * len(rows) // parts] + rows[:3]  # some come again
        held = duplicates.grown_groups(held, spark.createDataFrame(new, "key long, fingerprint long"), 5)
    assert {r["key"]: r["comp"] for r in held.collect()} == {k: whole.get(k, k) for k, _ in rows}


def test_next_rows_over_a_hot_group(spark):
    rows = [(None if k % 7 == 0 else "hot" if k % 7 < 6 else "few", (k * 37) % 211) for k in range(200)]
    got = ordering.with_next(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.col("v")], "v", "n").collect()
    for g in (None, "hot", "few"):
        own = sorted(v for x, v in rows if x == g)
        assert sorted(((r["v"], r["n"]) for r in got if r["g"] == g), key=lambda x: x[0]) == list(zip(own, [*own[1:], None], strict=True))


def test_lists_of_any_length_and_refusals(spark, tmp_path):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "full_path string")
    assert ordering.added_to_compare(paths("a", "b"), paths("b", "c", "d")).count() == 4
    assert ordering.added_to_compare(paths("a", "b"), paths("c", "d", "e")).count() == 2
    c = paths("a", "b", "c")
    assert [predicates.resolve_targets(*a, c).count() for a in ((True, None, None), (False, paths("a", "x", "a"), "b"), (False, paths(), "b"), (False, None, None))] == [3, 1, 1, 0]
    results = spark.createDataFrame([("copy", 1, None), ("copy", 0, "gone"), ("move", 2, None)], "operation string, index int, error string")
    sinks.write_operation_reports(results, str(tmp_path))
    assert spark.read.text(f"{tmp_path}/reports/operation=copy").first()[0] == '{"total":2,"succeeded":1,"failed":1}'
    assert [r["error"] for r in spark.read.json(f"{tmp_path}/failures").collect()] == ["gone"]
    tags = spark.createDataFrame([(0, 6), (3, 6), (None, 8)], "orientation int, orientation_fallback int")
    assert [r["orientation_text"] for r in photo_tags.described(tags).collect()] == ["rotated 90", "rotated 180", "rotated 270"]


def test_a_run_removes_its_tables_and_no_others(spark, tmp_path):
    import os

    from silvergrain.sources.staging import cut, shared_dir, staged

    root = shared_dir(spark).removeprefix("file:")
    outside = cut(spark.range(5), "outside")
    prints = spark.createDataFrame([(k, k // 2) for k in range(20)], "key long, fingerprint long")
    with staged(spark) as folder:
        groups = duplicates.similar_groups(prints, 0)
        with staged(spark) as inner:
            cut(spark.range(3), "inner")
            assert inner.startswith(folder) and os.listdir(inner.removeprefix("file:"))
        assert not os.path.exists(inner.removeprefix("file:")) and os.listdir(folder.removeprefix("file:"))
        before = set(os.listdir(root))
        groups.write.parquet(str(tmp_path / "groups"))
        assert set(os.listdir(root)) == before  # all of the run's tables are in its folder
    assert not os.path.exists(folder.removeprefix("file:")) and shared_dir(spark).removeprefix("file:") == root
    assert spark.read.parquet(str(tmp_path / "groups")).count() == 20 and outside.count() == 5
    with pytest.raises(ZeroDivisionError), staged(spark) as folder:
        cut(spark.range(3), "lost")
        raise ZeroDivisionError
    assert not os.path.exists(folder.removeprefix("file:"))
    with staged(spark):  # nothing was written
        pass
