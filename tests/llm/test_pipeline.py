from __future__ import annotations

import os
import random
from collections import Counter

import pytest
from helpers import SCHEMA, near_duplicates, no_documents, odd_documents, repeated_passages
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from silvergrain.llm import mixing, quality
from silvergrain.llm.queries import vocabulary
from silvergrain.sources import staging


def corpus(spark):
    random.seed(11)
    word = lambda: "".join(random.choices("etaoinshrdlu", k=random.randint(2, 9)))
    rows = []
    for k in range(120):
        rows.append((k, " ".join(word() for _ in range(random.randint(60, 200))), "en", f"s{k % 4}", 1))
    shared = " ".join(word() for _ in range(60))
    rows += [(200 + k, rows[k][1] + " added", "en", "s1", 1) for k in range(10)]
    rows += [(300 + k, rows[20 + k][1] + " " + shared, "en", "s2", 1) for k in range(2)]
    rows += [(400 + k, " ".join(word() for _ in range(80)) + " " + shared, "de", "s3", 1) for k in range(5)]
    rows += [(500 + k, "too short", "en", "s0", 1) for k in range(5)]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_against_plain_versions(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs).collect()}
    assert {d for d, _ in pairs(kept)} == {d for d, v in verdict.items() if v} and not any(verdict[500 + k] for k in range(5))
    single = corpus_pipeline.near_duplicates(spark, kept, "")
    groups = near_duplicates(pairs(kept))
    assert {d for d, _ in pairs(single)} == {d for d, (_, c) in groups.items() if c == d}
    cut = corpus_pipeline.repeated_passages(spark, single, "")
    want = repeated_passages(pairs(single))
    lengths = {d: n - gone for d, (n, gone, _, _) in want.items()}
    assert {d: len(t.encode()) for d, t in pairs(cut)} == {d: n for d, n in lengths.items() if n}
    mixed = corpus_pipeline.target_mix(spark, cut, "")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(cut).collect()}
    used = Counter(d for d, _ in pairs(mixed))
    assert mixed.columns == docs.columns and used == {d: n for d, n in copies.items() if n} and dict(pairs(mixed)).items() <= dict(pairs(cut)).items()
    packed = corpus_pipeline.packed_sequences(spark, mixed, "")
    coder = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokens = {d: len(coder.encode(t, add_special_tokens=False).ids) + 1 for d, t in pairs(mixed)}
    rows = packed.collect()
    seen = Counter()
    places: dict = {}
    for r in rows:
        assert r["doc_tokens"] == tokens[r["doc_id"]]
        seen[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {d: n * tokens[d] for d, n in used.items()}
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 1024
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(tuple(r) for r in whole.select(*key).collect()) == Counter(tuple(r) for r in packed.select(*key).collect())


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def words_of(n, seed):
    random.seed(seed)
    return " ".join("".join(random.choices("etaoinshrdlu", k=random.randint(2, 9))) for _ in range(n))


@pytest.fixture
def odd(spark):
    """Null and repeated ids, copies, columns that clash; no n_chars."""
    a, b, c = words_of(80, 1), words_of(90, 2), words_of(100, 3)
    rows = [(None, "short", "en", "s", "x"), (None, a, "en", "s", "x"), (None, a, "en", "s", "y"), (1, b, "en", "s", "x"), (1, b, "en", "s", "x"), (1, "short", "en", "s", "x"), (2, b, "en", "s", "z"), (3, c, None, None, "x"), (4, None, "en", "s", "x"), (5, "", "en", "s", "x"), (6, c[:300] + " " + words_of(60, 4), "en", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string")
    for name in ("h", "n", "node", "shards", "place", "copies", "row", "__id", "__text", "kept"):
        df = df.withColumn(name, F.lit(7))
    return df, (a, b, c)


def test_odd_rows_have_defined_results(spark, odd):
    df, (a, b, c) = odd
    kept = corpus_pipeline.quality_rules(spark, df, "")
    assert kept.columns == df.columns
    # short texts go whatever their id, and take no twin with them
    assert rows_of(kept) == rows_of(df.where("text is not null and text not in ('', 'short')"))
    single = corpus_pipeline.near_duplicates(spark, kept, "")
    assert single.columns == df.columns
    assert sorted(((d, t) for d, t in pairs(single)), key=str) == sorted([(None, a), (1, b), (3, c), (6, df.where("doc_id = 6").first()["text"])], key=str)
    assert rows_of(single) == rows_of(corpus_pipeline.near_duplicates(spark, kept.repartition(3, "size"), ""))
    shorter = corpus_pipeline.repeated_passages(spark, single, "")
    texts = dict(pairs(shorter))
    assert shorter.columns == df.columns and (texts[None], texts[1], texts[3]) == (a, b, c) and texts[6] == single.where("doc_id = 6").first()["text"][300:]
    mixed = corpus_pipeline.target_mix(spark, shorter.unionByName(shorter.where("doc_id = 3")), "")
    copies = mixing.mix(shorter.unionByName(shorter.where("doc_id = 3"))).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()
    assert mixed.columns == df.columns and Counter(d for d, _ in pairs(mixed)) == {r["doc_id"]: r["n"] for r in copies if r["n"]}
    assert corpus_pipeline.packed_sequences(spark, mixed, "").select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_repeated_ids_with_several_texts(spark):
    """Of an id with several texts one takes part; the others keep all, whatever the order of rows."""
    a, b = words_of(50, 5), words_of(50, 6)
    rows = [(3, a), (3, b), (9, a), (9, b), (5, a + " tail " + b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.repeated_passages(spark, df, "")
    assert got.where("doc_id = 3").count() == 2 and got.where("doc_id = 9").count() == 0 and {t for d, t in pairs(got) if d == 3} == {a, b}
    assert rows_of(got) == rows_of(corpus_pipeline.repeated_passages(spark, df.orderBy(F.desc("text")), ""))


def test_empty_tables(spark):
    docs = no_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_maps_arrays_and_structs_pass_through_every_stage(spark):
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(None, "no id here", "en", "s1", 10)] * 2, SCHEMA))
    more = docs.withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id"), F.lit("n"), F.lit(None).cast("long")), "a": F.array("doc_id"), "s": F.struct(F.create_map(F.lit(1), F.col("text")).alias("in"), F.col("lang"))})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, rich = stage(spark, docs, ""), stage(spark, more, "")
        assert rich.columns == more.columns, name
        assert sorted(map(str, rich.select(*docs.columns).collect())) == sorted(map(str, plain.collect())), name
        assert rich.where("doc_id is not null and m['k'] <> doc_id or s.lang <> lang").count() == 0
    assert corpus_pipeline.packed_sequences(spark, more, "").count() > 0


def test_stages_write_no_texts_between_jobs(spark, monkeypatch):
    """What two stages write for later jobs holds ids, hashes and spans; of the bytes a span leaves, cut characters go."""
    written, real = [], corpus_pipeline.cut
    monkeypatch.setattr(corpus_pipeline, "cut", lambda df, label: written.append(real(df, label)) or written[-1])
    docs = corpus(spark)
    shared = words_of(40, 7)
    # a repeated passage that starts within a character: the last bytes of both are alike
    more = spark.createDataFrame([(600, words_of(60, 8) + " é" + shared, "en", "s1", 1), (601, words_of(60, 9) + " ©" + shared, "en", "s1", 1)], SCHEMA)
    single = corpus_pipeline.near_duplicates(spark, docs.unionByName(more), "").localCheckpoint()
    cut = corpus_pipeline.repeated_passages(spark, single, "")
    want = {r["doc_id"]: r["kept_text"] for r in corpus_pipeline.suffix_dedup.dedup(single, with_text=True).collect()}
    got = dict(pairs(cut))
    assert got == {d: t for d, t in want.items() if t.strip(" ")} and got[601].endswith(" ") and got[601] + "©" + shared == dict(pairs(single))[601]
    assert len(written) == 3 and all(len(str(v)) < 200 for df in written for row in df.collect() for v in row)


def test_stages_leave_neither_shuffles_nor_tables_behind(spark, tmp_path, monkeypatch):
    """When a stage returns, of its jobs only the tables that its result reads are left."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines()
    shuffles = lambda: {f for f in files() if "/shuffle_" in f and f.endswith(".data")}
    left = {"quality rules": ["estimates"], "n-gram Jaccard join": ["copies", "repeated"], "suffix-array dedup": ["spans"], "mixing to target weights": ["drawn"]}
    docs = corpus(spark).localCheckpoint()
    setting = spark.conf.get(staging.CLEANUP)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        folder = tmp_path / name
        monkeypatch.setattr(staging, "shared_dir", lambda spark, own=str(folder): staging._RUN.get() or own)
        before = shuffles()
        result = stage(spark, docs, "")
        assert sorted(p.name.split("-")[0] for p in folder.iterdir()) == left[name], name
        # counts of rows that are not written leave a few bytes
        assert sum(os.path.getsize(f) for f in shuffles() - before) < 20_000 and spark.conf.get(staging.CLEANUP) == setting, name
        docs = result.localCheckpoint()


def test_quality_stage_moves_no_rows(spark, odd):
    """Verdicts meet the rows where these are read, however many are rejected."""
    df, _ = odd
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.quality_rules(spark, df, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
