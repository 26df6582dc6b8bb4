"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of one, two and three words with a
uniform floor. From the floor up, each estimate is mixed with the mixture below
it; its weight depends on how often its context was seen (one weight per power
of two) and is learned by expectation-maximisation on held-out counts: the
tokens of one fold of the training documents, each with itself deleted from the
counts.

Texts are dealt to blocks by a hash of their id and travel compressed. A block
asks the buckets of its words' hashes for their counts, then those of its word
pairs' and word triples'. Only counts travel; a word in every text is one entry
per block. A triple of which a pair was never seen needs no asking, nor does one
of which a pair occurs in the training texts once, here, and in no other text:
it was seen once. Everything is one lazy plan in which the texts are shuffled
once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.blocks import block_of
from silvergrain.llm.common import partitions
from silvergrain.llm.text_arrays import PLACES, U, flat, mix, word_hashes

START, END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
#: Remainders of crc32(id) by FOLDS: texts of HELD_OUT aren't learned from; those of TUNING give the held-out counts.
FOLDS, HELD_OUT, TUNING = 7, 2, 6
#: Context frequencies fall into powers of two.
LEVELS = 48
#: Bins of the logarithm of two estimates' ratio, per unit.
FINE = 64
NEVER = np.iinfo(np.int32).min
#: Bytes of a key that travel beside its bucket: with five million keys in a bucket one bucket in 6,000 has two that meet by chance.
KEY_BYTES = 7
#: Bytes of text that are split into words at once: their arrays stay in a core's cache.
AT_ONCE = 1 << 18
TOLD = "block int, bucket int, totals binary, tokens long, kinds long, weights binary, order int"
ASKS = "bucket int, block int, keys binary, counts binary, tuned binary, times binary, base binary, level binary, never binary"


def _tokens(texts: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens with their ends, offsets) of slices of the texts."""
    for first, data, offsets in flat(texts, AT_ONCE):
        hashed, at = word_hashes(data, offsets)
        yield first, np.insert(hashed, at[1:], END), at + np.arange(len(at))


def _before(values: np.ndarray, at: np.ndarray, start) -> np.ndarray:
    """Each place's value one place earlier; start at the beginning of a text."""
    out = np.r_[values[:1], values[:-1]]
    out[at[:-1]] = start
    return out


def _pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * PLACES[0] + tokens * PLACES[1])


def _triples(pair_before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(pair_before * PLACES[2] + tokens * PLACES[3])


def _planes(values: np.ndarray, size: int, ordered: bool = False) -> bytes:
    """The lower size bytes of each number (of the steps between them, if they are ordered), byte by byte, compressed."""
    values = np.diff(values.astype(U), prepend=U(0)) if ordered else values
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unplaned(packed: bytes, size: int, ordered: bool = False) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], n, codec="zstd", asbytes=True) if n else b""
    out = np.zeros((n // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    whole = out.view("<u8").ravel().astype(U)
    return np.cumsum(whole, dtype=U) if ordered else whole


class Ranked:
    """The distinct keys of an array in ascending order, and the places of each.

    Numbers are sorted several times faster than an order of them is found, so a
    place takes the low bits of its key; what these bits would have told apart
    (one pair in millions of hashes) is set right afterwards.
    """

    def __init__(self, keys: np.ndarray):
        bits = max(len(keys) - 1, 1).bit_length()
        low = U((1 << bits) - 1)
        coded = np.sort(keys & ~low | np.arange(len(keys), dtype=U))
        self.order = (coded & low).astype(np.int64)
        ascending = keys[self.order]
        new = np.r_[True, ascending[1:] != ascending[:-1]] if len(keys) else np.zeros(0, bool)
        coded >>= U(bits)
        if (ascending[1:] < ascending[:-1]).any():
            run = np.cumsum(np.r_[True, coded[1:] != coded[:-1]])
            at = np.flatnonzero(np.isin(run, run[1:][ascending[1:] < ascending[:-1]]))
            self.order[at] = self.order[at][np.lexsort((ascending[at], run[at]))]
            ascending = keys[self.order]
            new[1:] = ascending[1:] != ascending[:-1]
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.r_[self.starts, len(keys)])
        self.keys, self.first, self.run = ascending[self.starts], self.order[self.starts], np.cumsum(new, dtype=np.int64) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values (whole numbers or booleans, place by place) of each key."""
        return np.add.reduceat(values[self.order], self.starts, dtype=np.int64) if len(self.keys) else np.zeros(0, np.int64)

    def spread(self, totals: np.ndarray) -> np.ndarray:
        """The keys' totals, place by place."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = totals[self.run]
        return out


def asked_of(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of ascending keys: a bucket is a stretch of the range of hashes, the n-th part of it."""
    cuts = np.r_[np.searchsorted(keys, np.array([-(-(b << 64) // n) for b in range(n)], U)), len(keys)].tolist()
    return [(b, a, z) for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < z]


def _answers(told: pa.Table) -> np.ndarray:
    """The totals of a block's keys, in the order in which they were asked."""
    rows = sorted((b, t) for b, t in zip(told["bucket"].to_pylist(), told["totals"].to_pylist(), strict=True) if b is not None and t is not None)
    return np.concatenate([np.zeros(0, np.int64), *(_unplaned(t, 5).astype(np.int64) for _, t in rows)])


def level_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), LEVELS - 1)


def expectation_maximisation(level: np.ndarray, bin_: np.ndarray, times: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weight of the longer estimate per level; bin_ is FINE * log(ratio of the two estimates), NEVER for a ratio of 0."""
    ratio = np.where(bin_ == NEVER, 0.0, np.exp(np.clip(bin_ / FINE, -60, 60)))
    weight = np.full(LEVELS, 0.5)
    total = np.bincount(level, times, LEVELS)
    for _ in range(rounds):
        w = weight[level]
        part = np.bincount(level, times * w * ratio / (w * ratio + 1 - w), LEVELS)
        weight = np.where(total > 0, np.clip(part / np.maximum(total, 1), 1e-6, 1 - 1e-6), 0.5)
    return weight


def mixture(weight: np.ndarray, count: np.ndarray, context: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The estimate count / context mixed with what is below; a context never seen leaves that alone."""
    w = np.where(context > 0, weight[level_of(context)], 0.0)
    return w * count / np.maximum(context, 1) + (1 - w) * below


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, lower-cased in A-Z, and one end per text. base_score
    is the add-one score of single words. Null texts count as empty (an end
    alone), null ids as the empty string. Repeated rows are learned from and
    returned as often as they come; texts of one id are dealt and folded alike.
    Very long texts are scored whole. Other columns are ignored, whatever their
    names. Without any training text every count is 0 and the floor alone is
    left. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    fold = (F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")
    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(block_of(id_column, n).alias("block"), F.col(id_column).alias("doc_id"), fold.alias("fold"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]
            small = [pa.compress(r, codec="zstd", asbytes=True) for r in raw]
            yield pa.RecordBatch.from_arrays([b["block"], b["doc_id"], b["fold"], pa.array(small, pa.binary()), pa.array([len(r) for r in raw], pa.int64())], names=["block", "doc_id", "fold", "text", "size"])

    known = plain.mapInArrow(compressed, f"block int, doc_id {kind}, fold int, text binary, size long")
    texts = lambda: known.groupBy("block")

    def slices(rows: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
        whole = [pa.decompress(t, size, codec="zstd", asbytes=True) if size else b"" for t, size in zip(rows["text"].to_pylist(), rows["size"].to_pylist(), strict=True)]
        return list(_tokens(pa.chunked_array([pa.array(whole, pa.large_binary())])))

    def ask_words(rows: pa.Table) -> pa.Table:
        fold = rows["fold"].to_numpy()
        keys, learned = [], []
        for first, tokens, at in slices(rows):
            train = fold[first : first + len(at) - 1] != HELD_OUT
            keys += [tokens, np.full(len(at) - 1, START)]
            learned += [np.repeat(train, np.diff(at)), train]
        c = Ranked(np.concatenate(keys))
        counts, spans = c.sums(np.concatenate(learned)), asked_of(c.keys, n)
        return pa.table({"bucket": pa.array([b for b, _, _ in spans], pa.int32()), "block": pa.array([rows["block"][0].as_py()] * len(spans), pa.int32()), "keys": pa.array([_planes(c.keys[a:z], 8, True) for _, a, z in spans], pa.binary()), "counts": pa.array([_planes(counts[a:z], 4) for _, a, z in spans], pa.binary())})

    def answered(rows: pa.Table, totals: np.ndarray, ends: np.ndarray, order: int, more: dict | None = None) -> pa.Table:
        """Rows of TOLD for what the blocks asked, and one row of sums."""
        parts = [_planes(totals[a:z], 5) for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        m, extra = len(parts), int(more is not None)
        column = lambda name: pa.concat_arrays([rows[name].combine_chunks(), pa.nulls(extra, pa.int32())])
        return pa.table({"block": column("block"), "bucket": column("bucket"), "totals": pa.array([*parts, *[None] * extra], pa.binary()), "tokens": pa.array([None] * m + [more["tokens"]] * extra if more else [None] * m, pa.int64()), "kinds": pa.array([None] * m + [more["kinds"]] * extra if more else [None] * m, pa.int64()), "weights": pa.nulls(m + extra, pa.binary()), "order": pa.array([order] * (m + extra), pa.int32())})

    def answer_words(rows: pa.Table) -> pa.Table:
        raw, counts = rows["keys"].to_pylist(), rows["counts"].to_pylist()
        parts = [_unplaned(x, 8, True) for x in raw]
        c = Ranked(np.concatenate(parts))
        totals = c.sums(np.concatenate([_unplaned(x, 4) for x in counts]))
        seen = totals[c.keys != START]
        return answered(rows, c.spread(totals), np.cumsum([len(x) for x in parts]), 1, {"tokens": int(seen.sum()), "kinds": int((seen > 0).sum())})

    by_word = texts().applyInArrow(ask_words, "bucket int, block int, keys binary, counts binary").groupBy("bucket").applyInArrow(answer_words, TOLD)
    sums = by_word.where("block is null").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"))
    every = spark.range(n).select(F.col("id").cast("int").alias("block"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    told_words = by_word.where("block is not null").unionByName(every.crossJoin(F.broadcast(sums)).select("block", none("int", "bucket"), none("binary", "totals"), "tokens", "kinds", none("binary", "weights"), F.lit(1).alias("order"))).repartition(n, "block")  # one row of sums for each block

    class Block:
        """A block's tokens with what has been told of them, place by place."""

        def __init__(self, rows: pa.Table, told: pa.Table, most: int):
            fold = rows["fold"].to_numpy()
            parts = slices(rows)
            self.firsts = np.concatenate([at[:-1] + a for (_, _, at), a in zip(parts, np.cumsum([0, *(len(t) for _, t, _ in parts)]), strict=False)])
            self.tokens = np.concatenate([t for _, t, _ in parts])
            self.at = np.r_[self.firsts, len(self.tokens)]
            length = np.diff(self.at)
            self.train, self.tuning = np.repeat(fold != HELD_OUT, length), np.repeat(fold == TUNING, length)
            own = lambda k: told.filter(pyarrow.compute.equal(told["order"], k))
            words = own(1)
            self.total = max((x for x in words["tokens"].to_pylist() if x is not None), default=0)
            self.kinds = max((x for x in words["kinds"].to_pylist() if x is not None), default=0)
            count = Ranked(np.r_[self.tokens, np.full(len(length), START)]).spread(_answers(words))
            self.seen = count[: len(self.tokens)]
            self.context = _before(self.seen, self.at, count[-1] if len(length) else 0)
            self.pairs = _pairs(_before(self.tokens, self.at, START), self.tokens)
            # what follows is known of pairs once they have been answered, and of triples after that
            if most >= 2:
                pairs = own(2)
                told_of_pair = Ranked(self.pairs).spread(_answers(pairs))
                self.pair_seen = told_of_pair >> 1
                # before a text's first word stands the start alone, as often as the start itself was seen
                self.pair_context = _before(self.pair_seen, self.at, self.context[self.firsts[0]] if len(length) else 0)
                self.triples = _triples(_before(self.pairs, self.at, START), self.tokens)
                # a triple is seen no more often than either of its pairs; only texts that aren't learned from hold pairs never seen
                never = np.minimum(self.pair_seen, self.pair_context) == 0
                # a pair that no text but this one holds, and this one once, has a triple that does so too
                alone = self.train & (told_of_pair == 1 << 1)
                self.once = alone | _before(alone, self.at, False)
                self.asked = ~(never | self.once)
                self.weights = np.frombuffer(next(w for w in pairs["weights"].to_pylist() if w is not None))
            if most >= 3:
                triples = own(3)
                self.triple_seen = self.once.astype(np.int64)
                self.triple_seen[self.asked] = Ranked(self.triples[self.asked]).spread(_answers(triples)) >> 1
                self.triple_weights = np.frombuffer(next(w for w in triples["weights"].to_pylist() if w is not None))

        def single(self, less: int = 0, at: np.ndarray | slice = slice(None)) -> np.ndarray:
            """One word's estimate over the floor at these places; less: how often the token itself is deleted.

            The floor weighs as much as one more token of each kind that occurs once on average: kinds / (total + kinds).
            """
            total = max(self.total - less, 0)
            floor = self.kinds / max(total + self.kinds, 1) if self.kinds else 1.0
            return (1 - floor) * np.maximum(self.seen[at] - less, 0) / max(total, 1) + floor / (self.kinds + 1)

    def asked(rows: pa.Table, keys: np.ndarray, learned: np.ndarray, tuning: np.ndarray, estimates: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], never: np.ndarray | None = None) -> pa.Table:
        """Rows of ASKS. Of a held-out token: the logarithm (in bins) of what its count, less itself, is to be divided by for the ratio.

        The lowest bit of counts tells whether a text that isn't learned from holds the key. estimates: the context's
        count, less the token, and the estimate below at places of keys; equal keys have equal ones. never: per level,
        held-out tokens that aren't asked of since their counts, less themselves, are 0; a row of its own has them.
        """
        names = [x.split()[0] for x in ASKS.split(", ")]
        c = Ranked(keys)
        counts, times = c.sums(learned), c.sums(tuning)
        counts = counts << 1 | (counts < c.sizes)
        held = np.flatnonzero(times)
        context, below = estimates(c.first[held])
        base, level = np.round(FINE * np.log(np.maximum(context, 1) * below)).astype(np.int64) + (1 << 15), level_of(context)
        with np.errstate(over="ignore"):
            high = c.keys * U(n) >> U(64 - 8 * KEY_BYTES)  # how far into its bucket's stretch a key lies
        out = {k: [] for k in names}
        for bucket, a, z in asked_of(c.keys, n):
            x, y = np.searchsorted(held, (a, z))
            use = held[x:y]
            row = (bucket, rows["block"][0].as_py(), _planes(high[a:z], KEY_BYTES, True), _planes(counts[a:z], 4), _planes(use - a, 4, True), _planes(times[use], 4), _planes(base[x:y], 2), _planes(level[x:y], 1), None)
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        if never is not None:
            block = rows["block"][0].as_py()
            for k, v in zip(names, (block, block, *[_planes(np.zeros(0, U), 1)] * 6, _planes(never, 5)), strict=True):
                out[k].append(v)
        return pa.table([pa.array(out[k], pa.int32() if k in ("bucket", "block") else pa.binary()) for k in names], names=names)

    def nothing_asked() -> pa.Table:
        names = [x.split()[0] for x in ASKS.split(", ")]
        return pa.table([pa.array([], pa.int32() if k in ("bucket", "block") else pa.binary()) for k in names], names=names)

    def ask_pairs(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not len(rows):
            return nothing_asked()
        b = Block(rows, told, 1)
        return asked(rows, b.pairs, b.train, b.tuning, lambda at: (b.context[at] - 1, b.single(1, at)))

    def ask_triples(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not len(rows):
            return nothing_asked()
        b = Block(rows, told, 2)
        use = np.flatnonzero(b.asked)

        def estimates(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = use[at]
            return b.pair_context[at] - 1, mixture(b.weights, np.maximum(b.pair_seen[at] - 1, 0), b.context[at] - 1, b.single(1, at))

        never = np.bincount(level_of(b.pair_context[b.once & b.tuning] - 1), minlength=LEVELS)
        return asked(rows, b.triples[use], b.train[use], b.tuning[use], estimates, never)

    def totals_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        raw = rows["keys"].to_pylist()
        parts = [_unplaned(x, KEY_BYTES, True) for x in raw]
        keys = np.concatenate([np.zeros(0, U), *parts])
        counts = np.concatenate([np.zeros(0, U), *(_unplaned(x, 4) for x in rows["counts"].to_pylist())])
        c = Ranked(keys << U(64 - 8 * KEY_BYTES))
        return c.spread(c.sums(counts >> U(1)) << 1 | (c.sums(counts & U(1)) > 0)), np.cumsum([len(x) for x in parts])

    def answer(order: int):
        def run(rows: pa.Table) -> pa.Table:
            return answered(rows, *totals_of(rows), order)

        return run

    def held_out_counts(rows: pa.Table) -> pa.Table:
        totals, ends = totals_of(rows)
        at = np.concatenate([np.zeros(0, np.int64), *(_unplaned(t, 4, True).astype(np.int64) + a for t, a in zip(rows["tuned"].to_pylist(), np.r_[0, ends[:-1]], strict=True))])
        times = np.concatenate([np.zeros(0, U), *(_unplaned(t, 4) for t in rows["times"].to_pylist())]).astype(float)
        base = np.concatenate([np.zeros(0, U), *(_unplaned(t, 2) for t in rows["base"].to_pylist())]).astype(np.int64) - (1 << 15)
        level = np.concatenate([np.zeros(0, U), *(_unplaned(t, 1) for t in rows["level"].to_pylist())]).astype(np.int64)
        less = (totals[at] >> 1) - 1
        bin_ = np.where(less > 0, np.round(FINE * np.log(np.maximum(less, 1))) - base, NEVER).astype(np.int64)
        for x in rows["never"].drop_null().to_pylist():
            level, bin_, times = np.r_[level, np.arange(LEVELS)], np.r_[bin_, np.full(LEVELS, NEVER)], np.r_[times, _unplaned(x, 5).astype(float)]
        use = times > 0
        level, bin_, times = level[use], bin_[use], times[use]
        pair, inverse = np.unique(level << 32 | bin_ - NEVER, return_inverse=True)
        return pa.table({"level": pa.array(pair >> 32, pa.int32()), "bin": pa.array((pair & 0xFFFFFFFF) + NEVER, pa.int32()), "times": pa.array(np.bincount(inverse, times, len(pair)).astype(np.int64))})

    def learn(rows: pa.Table) -> pa.Table:
        w = expectation_maximisation(rows["level"].to_numpy().astype(np.int64), rows["bin"].to_numpy().astype(np.int64), rows["times"].to_numpy().astype(float))
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary())})

    def told_of(asks: DataFrame, order: int) -> DataFrame:
        """What the blocks are told of their keys, with the weights learned from the held-out ones."""
        buckets = asks.groupBy("bucket")
        bins = "level int, bin int, times long"
        held = buckets.applyInArrow(held_out_counts, bins)
        # LEVELS times a few thousand bins, whatever the corpus: one group learns the weights; a row makes sure that there is a group
        histogram = held.groupBy("level", "bin").agg(F.sum("times").alias("times")).unionByName(spark.range(1).select(F.lit(0).alias("level"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("times")))
        weights = histogram.groupBy(F.lit(0).alias("one")).applyInArrow(learn, "weights binary")
        return buckets.applyInArrow(answer(order), TOLD).unionByName(every.crossJoin(F.broadcast(weights)).select("block", none("int", "bucket"), none("binary", "totals"), none("long", "tokens"), none("long", "kinds"), "weights", F.lit(order).alias("order"))).repartition(n, "block")  # one row of weights for each block

    told_pairs = told_words.unionByName(told_of(texts().cogroup(told_words.groupBy("block")).applyInArrow(ask_pairs, ASKS), 2))
    told = told_pairs.unionByName(told_of(texts().cogroup(told_pairs.groupBy("block")).applyInArrow(ask_triples, ASKS), 3))

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table([rows["doc_id"], *(pa.array([], t) for t in types)], names=names)
        b = Block(rows, told, 3)
        base = (b.seen + 1) / (b.total + b.kinds + 1)
        mixed = mixture(b.triple_weights, b.triple_seen, b.pair_context, mixture(b.weights, b.pair_seen, b.context, b.single()))
        per = lambda x: np.add.reduceat(x, b.firsts)
        out = [rows["doc_id"].combine_chunks(), pa.array(rows["fold"].to_numpy() == HELD_OUT), pa.array(np.diff(b.at)), pa.array(per((b.seen > 0).astype(np.int64))), pa.array(np.full(len(rows), b.total, np.int64)), pa.array(per(np.log10(base))), pa.array(per(np.log10(mixed)))]
        return pa.table(out, names=names)

    names = [id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return texts().cogroup(told.groupBy("block")).applyInArrow(score, f"{id_column} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
