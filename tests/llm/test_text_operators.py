from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from helpers import fold, near_duplicates, no_documents, odd_documents, odd_texts, repeated_passages, statistics, unigrams, words
from pyspark.sql import functions as F

from silvergrain.llm import jaccard_join, lm_scoring, mixing, packing, quality, sharding, suffix_dedup, token_counts
from silvergrain.llm.queries import vocabulary


@pytest.fixture(params=[False, True], ids=["plain", "clashing"])
def docs(request, spark):
    return odd_documents(spark, request.param)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def varied(spark, n=60):
    """Texts with near copies of every degree and shared passages."""
    random.seed(5)
    vocabulary_ = [f"w{k}" for k in range(400)]
    bases = [[random.choice(vocabulary_) for _ in range(random.randint(20, 160))] for _ in range(6)]
    rows = []
    for k in range(n):
        w = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5])):
            w[random.randrange(len(w))] = random.choice(["edited", "changed", random.choice(vocabulary_)])
        if random.random() < 0.3:
            w += random.choice(bases)[:40]
        rows.append((k * 3 + 1, " ".join(w), "en", f"s{k % 3}", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates(docs):
    want = near_duplicates(pairs(docs))
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)


@pytest.mark.parametrize(("small", "frequent"), [(12, 7), (2, 7), (2, 2), (3, 3)])
def test_near_duplicates_by_pivots_and_combinations(spark, monkeypatch, small, frequent):
    """Small limits send every entry through pivots and most tokens into combinations."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    df = varied(spark)
    want = near_duplicates(pairs(df))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()} == want


def test_near_duplicates_of_a_doubled_table(spark):
    """Every row twice, and one id with two texts: each of many pairs of near copies keeps its link."""
    random.seed(8)
    rows = []
    for k in range(12):
        w = [f"p{k}w{random.randrange(1000)}" for _ in range(60)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join([*w[:-1], "changed"]))]
    rows.append((50, rows[0][1] + " tail"))
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = jaccard_join.near_duplicates(df).collect()
    assert len(got) == len(rows) * 2
    comp = {}
    for r in got:
        comp.setdefault(r["doc_id"], set()).add(r["component_id"])
    want = {d: {0 if d // 10 in (0, 5) else d // 10 * 10} for d, _ in rows}
    assert comp == want


def test_suffix_dedup(docs):
    want = repeated_passages(pairs(docs))
    got = suffix_dedup.dedup(docs).collect()
    assert len(got) == docs.count()
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)


def test_suffix_dedup_of_varied_texts(spark):
    df = varied(spark)
    want = repeated_passages(pairs(df))
    got = suffix_dedup.dedup(df, with_text=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert all(len(r["kept_text"].encode()) == r["n_bytes"] - r["n_removed"] for r in got)


def test_long_texts_are_cut_into_overlapping_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    import silvergrain.llm.text_arrays as arrays

    monkeypatch.setattr(arrays, "SLICE", 500)
    random.seed(1)
    a = "".join(random.choices("abc ", k=2500))
    import pyarrow as pa

    whole = suffix_dedup.anchors(__import__("numpy").frombuffer(a.encode(), "u1"), __import__("numpy").array([0, len(a)]))
    found = {}
    for _, base, data, offsets in suffix_dedup.segments(pa.chunked_array([pa.array([a])])):
        for _, place, first, last, _ in zip(*suffix_dedup.anchors(data, offsets), strict=True):
            for s in range(first, last + 1):
                found[s + base] = place + base
    assert found == {s: p for _, p, first, last, _ in zip(*whole, strict=True) for s in range(first, last + 1)}


def test_suffix_dedup_with_hashes_that_meet(spark, monkeypatch):
    """Window hashes of a few values only: bytes decide."""
    real = suffix_dedup.window_hashes
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda data, width: real(data, width) % 7 if width == suffix_dedup.LENGTH else real(data, width))
    df = varied(spark, 30)
    data = pairs(df)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(df).collect()}
    assert got == repeated_passages(data)


def test_frequent_anchors_are_dealt_in_pieces(spark, monkeypatch):
    """Every repeated anchor counts as frequent: the same bytes go, and a shared passage's surroundings spread over buckets."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 1)
    random.seed(31)
    letters = lambda k: "".join(random.choices("abcdefgh ", k=k))
    shared = [letters(52), letters(97), letters(140), letters(400)]
    rows = [(k, letters(60) + random.choice(shared) + letters(60)) for k in range(80)]
    rows += [(100 + k, rows[k][1][random.randrange(50) :]) for k in range(20)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), varied(spark, 30)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(df).collect()}
        assert got == repeated_passages(pairs(df))


def test_pieces_of_a_frequent_anchor():
    import numpy as np

    random.seed(32)
    some = lambda k: bytes(random.choices(range(97, 105), k=k))
    anchor, m = some(52), 500
    around = [(some(48), some(48)) for _ in range(m)]
    around[1] = around[0]
    data = np.frombuffer(b"".join(x + anchor + y for x, y in around), np.uint8)
    place, zero, all_ = 148 * np.arange(m) + 48, np.zeros(m, np.int64), np.full(m, 48)
    row, lo, hi, bucket = suffix_dedup.dealt(np.ones(m, bool), np.zeros(m, np.uint64), place, zero, all_, data, 16)
    covered = Counter((int(r), o) for r, a, z in zip(row, lo, hi, strict=True) for o in range(a, z + 1))
    assert covered == {(r, o): 1 for r in range(m) for o in range(49)}
    assert (bucket[row == 0] == bucket[row == 1]).all() and np.bincount(bucket, minlength=16).max() < 2 * len(bucket) / 16
    assert (suffix_dedup.dealt(~np.ones(m, bool), np.zeros(m, np.uint64), place, zero, all_, data, 16)[0] == np.arange(m)).all()


def test_first_of_hash_by_ranges():
    import numpy as np

    random.seed(34)
    hashed = np.array([random.choice([random.getrandbits(64), 5, 2**63, 2**64 - 1]) for _ in range(1000)], np.uint64)
    want = {}
    for k, h in enumerate(hashed.tolist()):
        want.setdefault(h, k)
    for at_once in (1 << 22, 300, 7):
        assert suffix_dedup.first_of_hash(hashed, at_once).tolist() == [want[h] for h in hashed.tolist()]
    assert len(suffix_dedup.first_of_hash(hashed[:0])) == 0


def test_counts_of_repeated_keys():
    """Levels follow the whole count, however it is spread over blocks and inside them."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute

    from silvergrain.llm import blocks

    random.seed(33)
    own = [np.array([random.choice([1, 2, 3, 2**40 + 7, random.getrandbits(64)]) for _ in range(50)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(4)]
    asked = pa.Table.from_batches([blocks.packed(h, k, 3) for k, h in enumerate(own)])
    answers = pa.concat_tables([blocks._answer(asked.filter(pa.compute.equal(asked["bucket"], b))) for b in range(3)])
    total = Counter(x for h in own for x in h.tolist())
    for k, h in enumerate(own):
        held = blocks.Known(answers.filter(pa.compute.equal(answers["block"], k)), 3)
        assert held.level(h).tolist() == [0 if total[x] == 1 else 1 + int(np.log2(total[x])) for x in h.tolist()]


def test_equal_windows():
    import numpy as np

    random.seed(21)
    data = np.array(random.choices([1, 2], [9, 1], k=3000), np.uint8)
    a = np.array(sorted(random.sample(range(2900), 1500)))
    b = a + np.array([random.choice([-1, 0, 5]) for _ in a]).clip(-a.min(), 2900 - a.max())
    want = [bool((data[x : x + 10] == data[y : y + 10]).all()) for x, y in zip(a, b, strict=True)]
    assert suffix_dedup.equal_windows(data, a, b, 10, 64).tolist() == want


def test_loser_tree_sorts_and_knows_prefixes():
    random.seed(8)
    for runs in (0, 1, 2, 3, 7, 16):
        strings = [sorted(bytes(random.choices(b"ab", k=random.randint(1, 12))) for _ in range(random.randint(0, 30))) for _ in range(runs)]
        coded = [(s, [suffix_dedup.shared_prefix(b"" if i == 0 else s[i - 1], x, 0)[0] for i, x in enumerate(s)]) for s in strings]
        at, out, shares = [0] * runs, [], []
        for who, share in suffix_dedup.merged(coded):
            out.append(strings[who][at[who]])
            at[who] += 1
            shares.append(share)
        assert out == sorted(x for s in strings for x in s)
        assert shares == [suffix_dedup.shared_prefix(b"" if i == 0 else out[i - 1], x, 0)[0] for i, x in enumerate(out)]


def test_quality(docs):
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == docs.count()
    want = {d: statistics(t) for d, t in pairs(docs)}
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == w
        failed = w[0] < 50 or 100 * w[4] > 50 * w[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_rejects_outliers_only(spark):
    random.seed(2)
    word = lambda: "".join(random.choices("etaoinshr", k=random.randint(2, 8)))
    rows = [(k, " ".join(word() for _ in range(random.randint(60, 300))), "en", "s") for k in range(150)]
    rows += [(1000 + k, " ".join(word() * 12 + "###$$$" for _ in range(120)), "en", "s") for k in range(15)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(150)) and not any(got[1000 + k] for k in range(15))


def test_quality_rejects_texts_littered_with_symbols(spark):
    """A tenth of symbols is far from texts without any, and a few repeated words are not."""
    random.seed(4)
    word = lambda: "".join(random.choices("etaoinshr", k=random.randint(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    rows = [(k, " ".join(text(random.randint(60, 300))), "en", "s") for k in range(150)]
    for k in range(15):
        w = text(200)
        rows.append((1000 + k, " ".join(x + "#" if random.random() < 0.6 else x for x in w), "en", "s"))
    w = text(200)
    rows.append((2000, " ".join([*w, *w[:3]]), "en", "s"))
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + k] for k in range(15))
    assert all(got[k] for k in range(150)) and got[2000]


def test_windows_of_equal_hash_are_compared_by_words(spark, monkeypatch):
    monkeypatch.setattr(quality, "WINDOW_HASH", "length({0}) * 1048576L")
    random.seed(15)
    rows = [(k, " ".join(random.choice(["aa", "bb", "cc", "d", "e"]) for _ in range(random.randint(1, 60)))) for k in range(60)]
    got = quality.text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_repeat_words"] == statistics(rows[r["doc_id"]][1])[4] for r in got)


def normal(spark, groups):
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    return spark.createDataFrame(rows, "grp string, " + ", ".join(f"{s} double" for s in quality.STATS))


def test_determinant_equals_the_least_of_all_subsets(spark):
    """Small groups: of all cores of three quarters the one of least determinant is found."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    groups = {f"g{k}": np.vstack([rng.normal(size=(11, 5)), rng.normal(9, 1, size=(3, 5))]) for k in range(4)}
    got = {r["grp"]: r for r in quality.minimum_covariance_determinant(normal(spark, groups)).collect()}
    for g, x in groups.items():
        best = min(itertools.combinations(range(14), 11), key=lambda c: np.linalg.det(np.cov(x[list(c)].T, bias=True)))
        core = x[list(best)]
        assert math.isclose(got[g]["log_det"], math.log(np.linalg.det(np.cov(core.T, bias=True))), rel_tol=1e-6)
        assert np.allclose([got[g][f"m{i}"] for i in range(5)], core.mean(0)) and got[g]["n"] == 11


def test_distances_of_normal_rows_follow_chi_square(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    mixing_ = rng.normal(size=(5, 5))
    clean = rng.normal(size=(6000, 5)) @ mixing_.T
    x = np.vstack([clean, rng.normal(40, 1, size=(60, 5))])
    df = normal(spark, {"g": x, "few": clean[:3] + 1})
    fit = quality.shrunk(quality.minimum_covariance_determinant(df))
    d = np.sort([r["d"] for r in df.where("grp = 'g'").join(fit, "grp").select(quality._distance().alias("d")).collect()])
    # quantiles of chi-square with five degrees; a hundredth of the rows are outliers beyond all of them
    for q, want in ((0.25, 2.675), (0.5, 4.351), (0.75, 6.626), (0.95, 11.07)):
        assert math.isclose(d[int(q * 6000)], want, rel_tol=0.08)
    assert (d[6000:] > quality.CUTOFF).all() and (d[:6000] > quality.CUTOFF).mean() < 0.004


def test_scores(docs):
    rows = pairs(docs)
    c, total, kinds = unigrams(rows)
    want = {d: [*words(t, True), "\0end"] for d, t in rows}
    got = lm_scoring.score_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"]) == 2, len(w), sum(c[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] <= 0


def plain_scores(rows):
    """{id: score} by counting dictionaries: three orders over a floor, weights by expectation-maximisation, nothing binned."""

    tokens = [(d, [*words(t, True), "\0end"]) for d, t in rows]
    counts = [Counter() for _ in range(3)]
    starts = 0
    for d, w in tokens:
        if fold(d) != 2:
            starts += 1
            for i, x in enumerate(w):
                u, v = (["\0start", "\0start", *w][i : i + 2])
                counts[0][x] += 1
                counts[1][v, x] += 1
                counts[2][u, v, x] += 1
    total, kinds = sum(counts[0].values()), len(counts[0])
    level = lambda c: min(int(math.log2(max(c, 1))), 47)

    def single(x, less):
        n = max(total - less, 0)
        floor = kinds / max(n + kinds, 1) if kinds else 1.0
        return (1 - floor) * max(counts[0][x] - less, 0) / max(n, 1) + floor / (kinds + 1)

    def seen(w, i):
        u, v, x = ["\0start", "\0start", *w][i : i + 3]
        return counts[1][v, x], (counts[0][v] if i else starts), counts[2][u, v, x], (counts[1][u, v] if i else starts)

    def fit(facts):
        weight = [0.5] * 48
        for _ in range(60):
            up, all_ = Counter(), Counter()
            for k, long, short in facts:
                up[k] += weight[k] * long / (weight[k] * long + (1 - weight[k]) * short)
                all_[k] += 1
            weight = [min(max(up[k] / all_[k], 1e-6), 1 - 1e-6) if all_[k] else 0.5 for k in range(48)]
        return weight

    mix2 = lambda w2, c, n, below: (w2[level(n)] if n > 0 else 0) * c / max(n, 1) + (1 - (w2[level(n)] if n > 0 else 0)) * below
    held = [(w, i, x) for d, w in tokens if fold(d) == 6 for i, x in enumerate(w)]
    facts = [(level(seen(w, i)[1] - 1), (seen(w, i)[0] - 1) / max(seen(w, i)[1] - 1, 1), single(x, 1)) for w, i, x in held]
    w2 = fit(facts)
    below = lambda w, i, x: mix2(w2, max(seen(w, i)[0] - 1, 0), seen(w, i)[1] - 1, single(x, 1))
    w3 = fit([(level(seen(w, i)[3] - 1), (seen(w, i)[2] - 1) / max(seen(w, i)[3] - 1, 1), below(w, i, x)) for w, i, x in held])
    out = {}
    for d, w in tokens:
        s = 0.0
        for i, x in enumerate(w):
            c2, n2, c3, n3 = seen(w, i)
            s += math.log10(mix2(w3, c3, n3, mix2(w2, c2, n2, single(x, 0))))
        out[d] = s
    return out


def test_scores_equal_a_plain_model(spark):
    """Bins of the estimates' ratio cost a little; everything else is the same model."""
    random.seed(17)
    chain = {k: random.sample(range(40), 3) for k in range(40)}
    rows = []
    for k in range(220):
        w, text = random.randrange(40), []
        for _ in range(random.randint(0, 60)):
            text.append(f"w{w}")
            w = random.choice(chain[w]) if random.random() < 0.8 else random.randrange(40)
        rows.append((k, " ".join(text)))
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_scores(rows)
    assert all(math.isclose(got[d], want[d], rel_tol=2e-3, abs_tol=1e-3) for d in want)
    assert sum(want[d] for d in want if fold(d) == 2) > 1.1 * sum(math.log10(1 / 40) * (len(t.split()) + 1) for d, t in rows if fold(d) == 2)


def test_scores_where_most_pairs_occur_once(spark):
    """Triples that are known to occur once aren't asked of; texts that aren't learned from still find those they share."""
    random.seed(29)
    passage = lambda: [f"w{random.randrange(150)}" for _ in range(random.randint(1, 30))]
    texts = [passage() for _ in range(150)]
    for k in range(150):
        if fold(k) == 2 or k % 5 == 0:  # shares a stretch with one other text
            other = texts[random.randrange(150)]
            a = random.randrange(len(other))
            texts[k] += other[a : a + random.randint(2, 12)] + passage()[:2]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_scores(rows)
    assert all(math.isclose(got[d], want[d], rel_tol=2e-3, abs_tol=1e-3) for d in want)


def test_weights_by_expectation_maximisation():
    """Held-out counts drawn from a known mixture give its weight back."""
    import numpy as np

    rng = np.random.default_rng(3)
    true = 0.3
    # the longer estimate gives an event 10 times the shorter one's share with probability 0.09 under it, else 10/11 of it
    hit = np.where(rng.random(200_000) < true, rng.random(200_000) < 0.5, rng.random(200_000) < 0.05)
    bins = np.where(hit, round(64 * math.log(10)), round(64 * math.log(0.5 / 0.95))).astype(np.int64)
    w = lm_scoring.expectation_maximisation(np.zeros(len(bins), np.int64), bins, np.ones(len(bins)), 300)
    assert abs(w[0] - true) < 0.02


def test_ranked_keys_of_a_block():
    """Distinct keys, sums and places, also where keys differ only in the bits that give way to the places; buckets are equal stretches."""
    import numpy as np

    rng = np.random.default_rng(9)
    spread = rng.integers(0, 2**64, 300, np.uint64, endpoint=False)
    close = spread[:40, None] + np.arange(7, dtype=np.uint64) * np.uint64(3)
    for keys in (spread[:0], spread[:1], np.repeat(spread[:1], 5), rng.choice(spread, 4000), rng.choice(np.r_[close.ravel(), spread], 6000)):
        distinct, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        r = lm_scoring.Ranked(keys)
        own = rng.integers(0, 9, len(keys))
        assert (r.keys == distinct).all() and (keys[r.first] == distinct).all()
        assert (r.sums(own) == np.bincount(inverse, own, len(distinct))).all() and (r.sums(np.ones(len(keys), bool)) == times).all()
        assert (r.spread(np.arange(len(distinct))) == inverse).all()
        for n in (1, 7, 51, 211):
            assert [b for b, a, z in lm_scoring.asked_of(r.keys, n) for _ in range(a, z)] == [int(k) * n >> 64 for k in r.keys]


def test_token_counts(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = {d: (len((t or "").encode()), len(model.encode(t or ""))) for d, t in pairs(docs)}
    got = token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).collect()
    assert len(got) == docs.count()
    assert all((r["n_bytes"], r["n_tokens"]) == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def test_pre_tokens_equal_the_library():
    import sentencepiece

    random.seed(6)
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    ranks = token_counts.PairRanks(vocabulary("piece_bpe_32k.model"))
    parts = ["a", " ", "  ", "\n", "é", "梦", "▁", "the", "in", "9", "\t", "aaaa", "    ", "😀", "ﬁ", "\0"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 50))) for _ in range(2000)]
    for t in texts:
        assert int(ranks.counts(token_counts.pre_tokens(t)).sum() if t else 0) == len(model.encode(t)), repr(t)


def test_packing(docs):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 64).collect()
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in pairs(docs)}
    copies = {d: sum(x == d for x, _ in pairs(docs)) for d in ids}
    seen: dict = {}
    places: dict = {}
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {d: len(x) * copies[d] for d, x in ids.items()}
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 64
    assert sorted(places) == list(range(len(places)))


def test_patterns_use_every_length_and_leave_least_slack():
    random.seed(7)
    for _ in range(50):
        counts = {random.randint(1, 31): random.randint(1, 9) for _ in range(8)}
        used: dict = {}
        first = True
        for times, pattern in packing.slack_patterns(counts, 32):
            total = sum(n * c for n, c in pattern.items())
            assert total <= 32 and times > 0
            if first:  # with the largest length, no other choice fills it better
                items = [n for n, c in counts.items() for _ in range(c)]
                items.remove(max(items))
                sums = {max(counts)}
                for n in items:
                    sums |= {s + n for s in sums if s + n <= 32}
                assert total == max(sums)
                first = False
            for n, c in pattern.items():
                used[n] = used.get(n, 0) + times * c
        assert used == counts


def test_words_equal_the_tokenizer():
    import numpy as np
    from tokenizers import Tokenizer

    random.seed(9)
    tokenizer, own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), packing.WordIds(vocabulary("byte_bpe_50k.json"))
    parts = ["a", "b", " ", "  ", "\n", "é", "梦", " \n", "\t", "the", "'s", "9", "<|endoftext|>", "\r\n", "!!", "　", "\xa0", "²", "\0"]
    for t in [x or "" for x in odd_texts()] + ["".join(random.choices(parts, k=random.randint(0, 50))) for _ in range(3000)]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    texts = dict(pairs(docs))
    by_source: dict = {}
    for r in got:
        assert r["size"] == len(words(texts[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
        by_source.setdefault(r["target"], []).append(r)
    for target, rows in by_source.items():
        assert abs(sum(r["taken"] for r in rows) - target) < 1
    assert sorted(tuple(r) for r in mixing.mix(docs).collect()) == sorted(tuple(r) for r in got)


def test_targets_fill_up_like_water(spark):
    def plain(sizes, weights=(5, 2, 1), most=3):
        names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
        w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
        left, open_, out = float(sum(sizes.values())), set(names), {}
        while open_:
            total = sum(w[s] for s in open_)
            over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
            if not over:
                return out | {s: left * w[s] / total for s in open_}
            for s in over:
                out[s] = float(most * sizes[s])
                left -= out[s]
            open_ -= over
        return out

    for sizes in ({"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 500, "c": 20, None: 7}, {"z": 5}, {"a": 0, "b": 9}, {"é": 3, "f": 3000, "😀": 40, "￿": 1}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        assert got == pytest.approx(plain(sizes))


def quantile(everything, kind, drawn, u):
    """The hypergeometric quantile from whole binomials."""
    from fractions import Fraction

    sum_, least = Fraction(0), max(0, drawn - (everything - kind))
    for k in range(least, min(kind, drawn) + 1):
        sum_ += Fraction(math.comb(kind, k) * math.comb(everything - kind, drawn - k), math.comb(everything, drawn))
        if sum_ >= Fraction(u):
            break
    return k


def test_hypergeometric_draws_equal_whole_binomials(spark):
    from pyspark.sql import functions as F

    cases = [(1, 1, 1), (10, 3, 5), (100, 40, 50), (1000, 999, 500), (50, 0, 20), (50, 50, 20), (37, 20, 30), (0, 0, 0), (5000, 1700, 2500)]
    rows = [(*c, u) for c in cases for u in (0.001, 0.1, 0.3, 0.5, 0.77, 0.999)]
    df = spark.createDataFrame(rows, "everything long, kind long, drawn long, u double")
    got = df.withColumn("k", mixing.hypergeometric(F.col("everything"), F.col("kind"), F.col("drawn"), F.col("u"))).collect()
    assert all(r["k"] == quantile(*r[:4]) for r in got)


def plain_tree(spark, quotas, shards, seed):
    """{shard: quotas}, node by node."""
    from pyspark.sql import functions as F

    nodes, out = [(0, shards, quotas)], {}
    while nodes:
        lo, hi, q = nodes.pop()
        if hi - lo < 2:
            out[lo] = q
            continue
        mid = lo + (hi - lo) // 2
        us = spark.range(len(q)).select("id", ((F.pmod(F.xxhash64(F.lit(seed), F.lit(lo), F.lit(hi), F.col("id").cast("int")), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).collect()
        us = {r["id"]: r["u"] for r in us}
        need, rest, left = math.floor(sum(q) * (mid - lo) / (hi - lo) + 0.5), sum(q), []
        for i, k in enumerate(q):
            left.append(quantile(rest, k, need, us[i]))
            need, rest = need - left[-1], rest - k
        nodes += [(lo, mid, left), (mid, hi, [a - b for a, b in zip(q, left, strict=True)])]
    return out


@pytest.mark.parametrize(("quotas", "shards"), [([40, 0, 7, 100], 8), ([3, 1], 5), ([12], 1)])
def test_splitting_tree(spark, quotas, shards):
    got = {r["shard"]: r["quotas"] for r in mixing.splitting_tree(spark.createDataFrame([(quotas,)], "quotas array<long>"), shards, 3).collect()}
    assert got == plain_tree(spark, quotas, shards, 3)
    assert [sum(q[i] for q in got.values()) for i in range(len(quotas))] == quotas
    sizes = [sum(q) for q in got.values()]
    assert max(sizes) - min(sizes) <= 3


def test_mix_takes_what_the_leaves_hold(spark, monkeypatch):
    """Blocks, quotas, tree and draws by plain Python, from the rows' hashes."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 6)
    monkeypatch.setattr(mixing, "PIECE_ROWS", 4)
    random.seed(13)
    rows = [(k, " ".join(["w"] * random.choice([0, 3, 20, 90])), random.choice(["a", "a", "a", "b", None])) for k in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df, shards=4).collect()}
    hashes = {r["doc_id"]: r["h"] % (1 << 64) for r in df.select("doc_id", F.xxhash64("doc_id", "text", F.lit(17)).alias("h")).collect()}
    size = {d: len(words(t)) for d, t, _ in rows}
    whole = sum(size.values())
    block = max(1, -(-whole // (4 * 6)))
    facts, order = {}, {}
    for s in {s for *_, s in rows}:
        order[s] = sorted((d for d, _, x in rows if x == s), key=hashes.get)
        total, target = sum(size[d] for d in order[s]), got[order[s][0]]["target"]
        rounds = min(3, int(target // total))
        more = max(0, math.floor(target - rounds * total)) if rounds < 3 else 0
        facts[s] = (rounds, -(-total // block), more)
    names = sorted(facts, key=lambda s: "" if s is None else "=" + s)
    quotas = [facts[s][0] * facts[s][1] + -(-facts[s][2] // block) for s in names]
    leaves = plain_tree(spark, quotas, 4, 17)
    for i, s in enumerate(names):
        rounds, blocks, more = facts[s]
        owner = [shard for shard in sorted(leaves) for _ in range(leaves[shard][i])]
        before = 0
        for d in order[s]:
            at = min(before // block, blocks - 1)
            last = max(0, min(more - before, size[d]))
            draws = [r * blocks + at for r in range(rounds + (last > 0))]
            assert got[d]["shards"] == [owner[p] for p in draws]
            assert got[d]["taken"] == rounds * size[d] + last
            before += size[d]
    per = [0] * 4
    for r in got.values():
        for x in r["shards"]:
            per[x] += r["size"]
    assert max(per) < 2 * min(per)


def test_sharding(docs):
    import zlib

    got = sharding.shards(docs).collect()
    assert len(got) == docs.count()
    texts = dict(pairs(docs))
    slots: dict = {}
    for r in got:
        b = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(b) + 1 and r["text_crc32"] == zlib.crc32(b)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_keep_texts_together(spark):
    random.seed(3)
    rows = [(k, " ".join(random.choices("abcdefgh", k=random.randint(5, 400))), random.choice(["en", "de"]), f"s{k % 5}") for k in range(3000)]
    rows += [(10_000 + k, "copied text " * 20, "en", "s1") for k in range(150)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    size, where = [0] * 16, {}
    for r in got:
        size[r["shard"]] += r["size"]
        where.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert max(size) < 1.03 * min(size) and all(len(s) == 1 for s in where.values())


def plain_k_d_tree(points, shards):
    """{h: shard} of points (h, bytes, (d0, d1, d2)): each node sorted along its widest dimension and cut at the weighted median."""
    bits = sharding.BITS
    nodes, out = [(0, shards, points)], {}
    while nodes:
        lo, hi, rows = nodes.pop()
        if hi - lo == 1 or not rows:
            out |= {h: lo for h, _, _ in rows}
            continue
        spread = [max(p[2][d] for p in rows) - min(p[2][d] for p in rows) for d in range(3)]
        widest = spread.index(max(spread))
        code = lambda p, d=widest: min(int(p[2][d] * (1 << bits)), (1 << bits) - 1) << 2 * bits | p[0] % (1 << 2 * bits)
        middle = (lo + hi) // 2
        left = sum(p[1] for p in rows) * (middle - lo) / (hi - lo)
        low, high = [], []
        for p in sorted(rows, key=code):
            left -= p[1]
            (low if left >= 0 and not high else high).append(p)
        nodes += [(lo, middle, low), (middle, hi, high)]
    return out


@pytest.mark.parametrize("count", [16, 6, 1])
def test_shards_equal_a_plain_k_d_tree(spark, count):
    """No text here is heavy, so the tree alone decides; some texts have copies."""
    rng = random.Random(count)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(5, 40))) + f" {k}", rng.choice(["en", "de", "fr"]), f"s{rng.randrange(6)}") for k in range(6000)]
    rows += [(10_000 + k, *rows[k][1:]) for k in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["shard"] for r in sharding.shards(df, shards=count).collect()}
    place = lambda c: (F.pmod(F.xxhash64(c), F.lit(1 << 20)) / float(1 << 20)).alias(c)
    coded = df.select("doc_id", F.xxhash64("text").alias("h"), (F.octet_length("text") + 1).alias("each"), (F.log1p((F.octet_length("text") + 1).cast("double")) / 16).alias("d0"), place("lang"), place("source")).collect()
    texts = {}
    for r in coded:
        _, n, _ = texts.get(r["h"], (0, 0, 0))
        texts[r["h"]] = (r["h"], n + r["each"], (r["d0"], r["lang"], r["source"]))
    want = plain_k_d_tree(list(texts.values()), count)
    assert max(n for _, n, _ in texts.values()) <= sum(n for _, n, _ in texts.values()) / count * sharding.HEAVY
    assert got == {r["doc_id"]: want[r["h"]] for r in coded}


def test_a_text_larger_than_a_shard_is_split(spark):
    rows = [(k, "the same words again and again", "en", "s") for k in range(600)] + [(1000 + k, f"own {k}", "en", "s") for k in range(100)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    size = [0] * 16
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == 700 and max(size) < 1.4 * min(size)


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: jaccard_join.near_duplicates(d),
        lambda d: packing.pack_documents(d, vocabulary("byte_bpe_50k.json")),
        lambda d: quality.quality_verdicts(d),
        lambda d: suffix_dedup.dedup(d),
        lambda d: lm_scoring.score_documents(d),
        lambda d: mixing.mix(d),
        lambda d: sharding.shards(d),
        lambda d: token_counts.count_tokens(d, vocabulary("piece_bpe_32k.model")),
    ],
    ids=["jaccard", "packing", "quality", "suffix", "scores", "mixing", "sharding", "counts"],
)
def test_empty_and_null_tables(spark, operator):
    assert operator(no_documents(spark)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert operator(nulls).count() == 2


def test_long_texts_without_spaces_are_counted_in_short_rows():
    import string
    import time

    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model, ranks = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PairRanks(path)
    rng = random.Random(1)
    for letters, n in ((string.ascii_lowercase, 300_000), (string.ascii_letters + string.digits + "+/", 100_000), ("".join(map(chr, range(0xE01, 0xE30))), 50_000), ("etaoin", 4000), ("x", 5000)):
        text = "".join(rng.choice(letters) for _ in range(n))
        began = time.perf_counter()
        assert int(ranks.counts(token_counts.pre_tokens(text)).sum()) == len(model.encode(text))
        assert time.perf_counter() - began < 20
