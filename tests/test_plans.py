"""Targets, quality searches, versioned states and progress reports against plain loops."""

from __future__ import annotations

import glob
import os
import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from silvergrain.operators import state
from silvergrain.plans import export
from silvergrain.sources import versions
from silvergrain.streaming import progressive


def plain_targets(sources, taken):
    held, out = set(taken) | {p for _, p in sources}, {}
    for k, p in sorted(sources):
        base, dot, ext = p.rsplit("/", 1)[1].rpartition(".")
        for n in range(10_000):
            c = f"/out/{base}{f'_x{n:02d}' if n else ''}{dot}{ext}"
            if c not in held:
                held.add(c)
                out[k] = c
                break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_trying_one_after_another(spark, seed):
    """Names that are themselves candidates, several levels deep, in any order, with gaps and odd digits among what is there."""
    rng = random.Random(seed)
    names = ["a.jpg"] * 5 + ["a_x01.jpg"] * 3 + ["a_x02.jpg", "a_x03.jpg", "a_x04.jpg", "a_x01_x01.jpg", "a_x01_x02.jpg", "a_x1.jpg", "a_x001.jpg", "b.png", "b_x100.png", "a.png"]
    picked = [rng.choice(names) for _ in range(40)]
    sources = [(k, f"/{'out' if rng.random() < 0.05 else f'in{k}'}/{n}") for k, n in enumerate(picked)]
    taken = rng.sample(["/out/a.jpg", "/out/a_x02.jpg", "/out/a_x05.jpg", "/out/a_x001.jpg", "/out/a_x01_x01.jpg", "/out/b.png", "/elsewhere/a_x03.jpg"], 4)
    df = spark.createDataFrame(sources, "rank int, full_path string")
    got = export.available_targets(df, spark.createDataFrame([(t,) for t in taken], "path string"), "/out", "x").collect()
    assert {r["rank"]: r["target_path"] for r in got} == plain_targets(sources, taken)


def plain_search(target, least, most, size):
    """The highest quality by bracketed interpolation, five inner probes at most."""
    probed = []

    def probe(q):
        probed.append(q)
        return size(q)

    high = probe(most)
    if high <= target:
        return most, True, probed
    if least == most:
        return least, False, probed
    low = probe(least)
    if low > target:
        return least, False, probed
    lo, hi, best = least, most, least
    for _ in range(5):
        if hi - lo <= 1:
            break
        q = lo + (hi - lo) // 2 if high <= low else lo + int((hi - lo) * ((max(low, min(target, high)) - low) / (high - low)) + 0.5)
        q = max(lo + 1, min(hi - 1, q))
        n = probe(q)
        if n <= target:
            best, lo, low = q, q, n
            if n == target:
                break
        else:
            hi, high = q, n
    return best, True, probed


@pytest.mark.parametrize("least,most", [(1, 100), (30, 90), (50, 50), (60, 61)])
def test_quality_search_equals_a_scalar_one(spark, least, most):
    rng = random.Random(least)
    items = [(k, rng.randrange(1, 20_000), rng.choice([3, 11, 40])) for k in range(60)] + [(900, 11 * 70**2 // 7, 11)]
    size = lambda q, s: s * q * q // 7 + (q % 3) * 5
    df = spark.createDataFrame(items, "key int, target long, s long")
    slow = F.col("s") * F.col("quality") * F.col("quality")
    rounds = []

    def probe(rows):
        rounds.append(1)
        return rows.join(df, "key").select("key", "quality", (F.floor(slow / 7) + (F.col("quality") % 3) * 5).alias("bytes"))

    got = {r["key"]: (r["quality"], r["within"], r["probed"]) for r in export.search_quality(df, probe, least, most).collect()}
    assert got == {k: plain_search(t, least, most, lambda q, s=s: size(q, s)) for k, t, s in items}
    assert len(rounds) <= 7


def test_an_item_without_a_size_ends_its_search(spark):
    df = spark.createDataFrame([(1, 10), (2, 10)], "key int, target long")
    got = export.search_quality(df, lambda rows: rows.where("key = 1").withColumn("bytes", F.col("quality").cast("long")), 1, 100).collect()
    assert {r["key"]: (r["quality"], r["within"]) for r in got} == {1: (10, True), 2: (1, None)}


# ---- versions


def reviews(spark, rows, changed=False):
    return spark.createDataFrame([(*r, 1) if changed else r for r in rows], "full_path string, rating int, status string" + (", changed_at int" if changed else ""))


def test_versions_keep_what_is_not_touched(spark, tmp_path):
    root = str(tmp_path / "reviews")
    rows = [(f"/p{k}", k % 6, "Keep") for k in range(200)]
    assert versions.create(reviews(spark, rows), root, ["full_path"], 16) == 1
    merge = lambda old, new: state.upsert_review(old, new)
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{root}/data/*/__bucket=*/*.parquet")}
    before = files()
    changes = reviews(spark, [("/p3", 5, "Reject"), ("/p4", 0, "None"), ("/new", 2, "None")], True)
    assert versions.upsert(changes, root, merge) == 2
    touched = {r[0] for r in changes.select(versions.bucket_of(["full_path"], 16)).collect()}
    after = files()
    assert before.items() <= after.items()
    assert {int(f.split("__bucket=")[1].split("/")[0]) for f in after.keys() - before.keys()} <= touched
    want = {p: (r, s) for p, r, s in rows if p != "/p4"} | {"/p3": (5, "Reject"), "/new": (2, "None")}
    read = lambda v=None: {r["full_path"]: (r["rating"], r["status"]) for r in versions.read(spark, root, v).collect()}
    assert read() == want and read(1) == {p: (r, s) for p, r, s in rows}
    assert versions.forget(root, 1) == len(touched) and read() == want
    with pytest.raises(versions.Conflict):
        versions.create(reviews(spark, rows), root, ["full_path"])


def test_a_writer_that_fails_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "reviews")
    versions.create(reviews(spark, [("/a", 1, "Keep"), ("/b", 2, "Keep")]), root, ["full_path"], 4)
    changes = reviews(spark, [("/a", 4, "Keep")], True)

    def lost(*_):
        raise RuntimeError("machine lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", lost)  # data is written, the version isn't
        with pytest.raises(RuntimeError):
            versions.upsert(changes, root, state.upsert_review)
    assert {(r["full_path"], r["rating"]) for r in versions.read(spark, root).collect()} == {("/a", 1), ("/b", 2)} and versions.latest(root) == 1

    def slower(old, new):
        versions.upsert(reviews(spark, [("/b", 5, "Keep")], True), root, state.upsert_review)
        return state.upsert_review(old, new)

    with pytest.raises(versions.Conflict):
        versions.upsert(changes, root, slower)
    assert {(r["full_path"], r["rating"]) for r in versions.read(spark, root).collect()} == {("/a", 1), ("/b", 5)}
    with pytest.raises(ValueError):
        versions.upsert(changes, root, lambda old, new: spark.createDataFrame([(f"/{k}", 1, "Keep") for k in range(50)], old.schema))
    empty = str(tmp_path / "empty")
    versions.create(reviews(spark, []), empty, ["full_path"], 4)
    assert versions.read(spark, empty).count() == 0


# ---- progress


def test_reports_by_stride_and_interval_and_the_last():
    now, told = [0.0], []
    listener = progressive.ProgressReports(lambda *a: told.append(a[1:]), stride=4, interval=10, clock=lambda: now[0])
    event, progress = namedtuple("E", "id progress"), namedtuple("P", "id batchId numInputRows")
    listener.onQueryStarted(event("q", None))
    for k in range(7):
        now[0] += 12 if k == 5 else 1
        listener.onQueryProgress(event("q", progress("q", k, 10)))
    listener.onQueryTerminated(event("q", None))
    assert told == [(3, 40, False), (5, 60, False), (6, 70, True)]


def test_reports_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    told = []
    listener = progressive.ProgressReports(lambda *a: told.append(a), stride=100, interval=1000)
    spark.streams.addListener(listener)
    try:
        s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        s.writeStream.foreachBatch(lambda b, n: b.count()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        import time

        for _ in range(100):
            if told:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [t[2:] for t in told] == [(15, True)]
