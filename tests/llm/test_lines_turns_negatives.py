"""The operators on lines, turns and hard negatives against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from functools import cache

import numpy as np
import pytest
from helpers import LOWER, no_documents, odd_documents
from pyspark.sql import functions as F

from silvergrain.llm import conversation_repair, hard_negatives, line_dedup

BLANK = " \t\n\x0b\x0c\r"


def nulls_first(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def plain_lines(rows, least=10):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    first: dict[str, int] = {}
    for d, t in rows:
        for line in (t or "").split("\n") if d is not None else []:
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), d), d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or first.get(key(x), d) >= d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_of_odd_documents(spark):
    df = odd_documents(spark, clashing=True).unionByName(spark.createDataFrame([(None, "a line that repeats\nx", None, None, None), (3, "a line that repeats\nanother text", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = nulls_first(tuple(r) for r in line_dedup.dedup(df).collect())
    assert got == nulls_first(plain_lines([(r["doc_id"], r["text"]) for r in df.collect()]))
    assert line_dedup.dedup(no_documents(spark)).count() == 0


@pytest.mark.parametrize("tasks", ["1", "7", "60"])
def test_one_line_in_a_third_of_all_documents(spark, tasks):
    """A name that fills several ranges, also with names that meet at their edges."""
    rng = random.Random(3)
    rows = [(k, "\n".join(["a very common line"] * (k % 3 == 0) + [f"line number {rng.randrange(60)}" for _ in range(rng.randrange(6))] + ["A VERY common line \t"] * (k % 5 == 0))) for k in range(400)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got)) == sorted(plain_lines(rows))


def test_bitmaps_round_trip():
    text = "\n".join(f"line {k}" for k in range(1000))
    for gone in ([0], [999], [7, 8, 15, 16, 640]):
        bits = np.ones(gone[-1] // 8 * 8 + 8, bool)
        bits[gone] = False
        bitmap = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
        assert line_dedup.kept_lines(text, bitmap).split("\n") == [f"line {k}" for k in range(1000) if k not in gone]


# ---- conversations

LEADS = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """Every edit tried at every place, by cost and then by the edits' initials."""
    talks: dict = {}
    for c, t, r, x in rows:
        own = talks.setdefault(c, [])
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if what == 1 else "".join(k for k in x if k not in ".!?") if what == 2 else x
        own += [(t, "user" if what == 4 else r, x)] * (0 if what == 0 else 2 if what == 3 else 1)
    out = []
    for c, own in talks.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        seen: set = set()
        faults = []
        for _, r, x in own:
            b = x.strip(BLANK)
            faults.append("blank" if not b else "again" if (r, x) in seen else "cut" if b[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]

        @cache
        def best(i, last, added, own=own, faults=faults):
            ways = [(0, "", ())] if i == len(own) and last in ("", "a") else []
            edits = [(2, "I", r, "", i) for r in ("user", "assistant") if added < 3]
            if i < len(own):
                _, r, x = own[i]
                k, a, lines = best(i + 1, last, 0)
                ways.append((k + 3, "D" + a, lines))
                if faults[i] not in ("blank", "again"):
                    more = faults[i] == "cut"
                    edits += [(more, "K", r, x, i + 1)] + [(2 + more, "R", role, x, i + 1) for role in ("user", "assistant")]
            for cost, name, r, x, to in edits:
                if r[:1] and r[:1] in LEADS[last]:
                    k, a, lines = best(to, r[:1], added + 1 if to == i else 0)
                    ways.append((k + cost, name + a, (f"{r}:{x}", *lines)))
            return min(ways) if ways else (10**9, "~", ())

        cost, audit, lines = best(0, "", 0)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "again", "cut")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, task int, slot int, conv string, at string, kind string"


def odd_turns():
    rng = random.Random(1)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"]
    texts = ["Hi.", "What?", "no end", "", None, " \n", "Yes! ", "a.b", "é…"]
    rows = [(c, rng.choice([k, k, k, k, rng.randrange(12), None]), rng.choice(roles), rng.choice(texts)) for c in [*range(120), None] for k in range(rng.randrange(9))]
    return [*rows, (1000, 0, "user", "only"), (1001, 5, "user", "word " * 100_000)]


def repaired(spark, rows, tasks="4"):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        df = spark.createDataFrame([(*r, 1, 2, "x", "y", "z") for r in rows], TURNS)
        return nulls_first(tuple(r) for r in conversation_repair.repair_damaged(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("tasks", ["1", "5", "60"])
def test_repair_of_odd_turns(spark, tasks):
    rows = odd_turns()
    assert repaired(spark, rows, tasks) == nulls_first(plain_repair(rows))


def test_repair_of_conversations_longer_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "PIECE", 64)
    rng = random.Random(2)
    rows = [(c, k // 2, rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), rng.choice([f"t {k % 60}.", "Same.", "cut", ""])) for c, n in ((1, 300), (2, 3), (3, 250), (None, 120)) for k in range(n)]
    assert repaired(spark, rows, "11") == nulls_first(plain_repair(rows))


def test_repair_of_nothing(spark):
    assert conversation_repair.repair_damaged(spark.createDataFrame([], TURNS)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ---- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, bucket string, norm string, w string"
HELD = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))


def plain_negatives(rows):
    fine = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {i for i, _, _ in fine if i % 100 == 0}:
        _, own, va = min((r for r in fine if r[0] == a), key=lambda r: (r[1], r[2]))
        scored = [(-HELD(sum(x * y for x, y in zip(va, v, strict=False))), i, label == own) for i, label, v in fine if i != a]
        for p, i in sorted((s, i) for s, i, same in scored if same)[:5]:
            inside = sorted((s, j) for s, j, same in scored if not same and 30 * -p <= 100 * -s <= 90 * -p)[:10]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, df.where("vec_id % 100 = 0")).collect())


def odd_vectors():
    rng = np.random.default_rng(1)
    rows = [(k * 10, rng.normal(size=8).tolist(), int(rng.integers(4))) for k in range(200)]
    rows += [(7, [0.5] * 8, 1), (8, [0.5] * 8, 1), (9, [0.5] * 8, 2), (11, None, 1), (12, [None] * 8, 1), (13, [float("nan")] * 8, 1), (14, [float("inf")] + [0.0] * 7, 1)]
    return [*rows, (15, [1.0, 2.0], 0), (None, [1.0] * 8, 1), (500, [0.0] * 8, 1), (20, [0.1] * 8, None), (600, rng.normal(size=8).tolist(), 3), (7, [0.5] * 8, 1)]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_of_odd_vectors(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 40), ("ANCHORS", 7), ("GROWTH", 3)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = odd_vectors()
    assert mined(spark, rows) == plain_negatives(rows)


def test_lengths_far_apart_and_one_vector_for_a_third(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 60)
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=6) * 10 ** rng.uniform(0, 3)).tolist(), k % 3) for k in range(500)] + [(5000 + k, [0.25] * 6, k % 2) for k in range(240)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_scores_beyond_floats(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=6) * 10 ** rng.uniform(3, 8)).tolist(), k % 3) for k in range(201)] + [(1000 + k, [3e16, 1e3, 0.0, 0.0, 0.0, 0.0], k % 2) for k in range(101)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_no_vectors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, None, 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (101, [1.0], 2)]) == []


def test_buckets_that_are_too_short_are_not_asked(spark, monkeypatch):
    """Of twenty buckets of falling length the anchors ask those that may reach their windows."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    asked = []
    cut = hard_negatives.cut

    def counted(df, label):
        out = cut(df, label)
        if label == "asks":
            asked.append(out.agg(F.max("bucket")).first()[0])
        return out

    monkeypatch.setattr(hard_negatives, "cut", counted)
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=4) * 2.0 ** (12 - k // 50)).tolist(), int(rng.integers(3))) for k in range(1000)]
    rows = [(k, v if k % 100 else [4096.0, 1.0, 1.0, 1.0], label) for k, v, label in rows]
    assert mined(spark, rows) == plain_negatives(rows)
    assert max(a for a in asked if a is not None) < 15
