"""Near-duplicate documents by an n-gram Jaccard join with token-combination prefixes.

Tokens are hashed shingles, ordered by how many texts hold them. If two sets
reach the threshold, each has at most n - t tokens (t = least overlap) that the
other lacks. A prefix in the common order is therefore extended until it holds
more than n - t tokens that would have to be missed: a rare token counts one and
is indexed alone; frequent tokens fall into classes, of which each is indexed by
its pairs of tokens (two of them always count one less than the class has).
Tokens that stand in a single text count but need no entry. Two sets that reach
the threshold share an entry; what shares an entry is verified.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.blocks import ASKED, Known, block_of, packed, repeated
from silvergrain.llm.common import cut, partitions
from silvergrain.llm.components import components, joined
from silvergrain.llm.text_arrays import U, flat, mix, shingles, word_hashes

#: A token in 2**(FREQUENT - 1) texts or more is indexed in combination.
FREQUENT = 7
#: Sets with fewer tokens than this share one class of frequent tokens; a set twice as long has twice the classes.
CLASS_BITS = 5
#: 64-bit words of a set's bitmap: the parity of its tokens in each of 64 * WORDS classes.
WORDS = 16
#: Entries with at most so many sets compare all of them, larger ones go by pivots first.
SMALL = 12
ROUNDS = 4
#: part: place of the text among the different texts of its node, nearly always 0
SIGNED = "node long, part int, n long, shared long, sigs array<long>, tokens binary, bits array<long>"


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    hashes, at = shingles(*word_hashes(data, offsets), k)
    parts = [np.unique(hashes[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
    return np.concatenate([*parts, np.zeros(0, U)]), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)


def signatures(tokens: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of a set. level: 0 for tokens of one text, else a class of frequency."""
    n = len(tokens)
    need = n - -(-percent * n // 100) + 1
    need -= int((level == 0).sum())
    if need <= 0:
        return np.zeros(0, np.int64)
    again = level > 0
    tokens, level = tokens[again], level[again]
    order = np.lexsort((tokens, level))
    tokens, level = tokens[order], level[order]
    frequent = level >= FREQUENT
    out = []
    # the classes follow the band of the set's size; a partner may be in the next one
    for band in sorted({(-(-percent * n // 100)).bit_length(), (n * 100 // percent).bit_length()}):
        classes = 1 << max(0, band - 1 - CLASS_BITS)
        kind = np.where(frequent, (tokens % U(classes)).astype(np.int64), -1)
        seen = np.zeros(len(tokens), bool)
        for c in np.unique(kind[frequent]):
            seen[np.flatnonzero(kind == c)[0]] = True
        weight = np.cumsum(~seen)
        end = int(np.searchsorted(weight, need)) + 1
        if end > len(tokens):  # one frequent token alone: only the same set can be its partner
            out.append(mix(np.array([tokens.sum(dtype=U) + U(n)], U)))
            end = len(tokens)
        out.append(tokens[:end][~frequent[:end]])
        for c in np.unique(kind[:end][frequent[:end]]):
            own = np.sort(tokens[:end][kind[:end] == c])
            i, j = np.triu_indices(len(own), 1)
            out.append(mix(own[i] + mix(own[j] + U(classes))))
    return np.unique(np.concatenate(out)).view(np.int64)


def links_of(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    side = lambda x: signed.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for ta, tb, na, nb in zip(b["ta"], b["tb"], b["na"].to_pylist(), b["nb"].to_pylist(), strict=True):
                x, y = np.frombuffer(ta.as_buffer(), U), np.frombuffer(tb.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))] == x).sum()) if len(x) else 0
                keep.append(100 * both >= percent * (na + nb - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(check, "a long, b long")


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether two sets can reach the threshold at all: no more is common to them than either shares with any text."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    most = F.least(f"{x}shared", f"{y}shared", n, m)
    return (100 + percent) * most >= percent * (n + m)


def _parities(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens % U(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_differ_little(x: str, y: str, percent: int) -> Column:
    """A bound that looks at tokens: classes of odd difference, and the tokens of one text only, all lie in just one of the sets."""
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.get(f"{x}bits", F.lit(k)).bitwiseXOR(F.get(f"{y}bits", F.lit(k)))) for k in range(WORDS)])
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    least = differ + n - F.col(f"{x}shared") + m - F.col(f"{y}shared")
    return (100 + percent) * least <= (100 - percent) * (n + m)


def linked_components(signed: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of the nodes with a link.

    Entries with the same sets count once. In a large entry (of each set its
    largest one first, then all that still hold more than one component), pivots (the set
    with the fewest tokens of its own first) are compared with the sets of other
    components, which joins copies of one text in linear work; rounds go on while
    they find links. What then still stands apart in an entry is compared in
    full by bitmaps, and what these can't tell apart by tokens: no link is lost.
    """
    spread = signed.where(F.size("sigs") > 0).select("node", "part", "n", "shared", F.explode("sigs").alias("sig"))
    entries = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node", "part")).alias("x"), F.bit_xor(F.xxhash64(F.lit(5), "node", "part")).alias("y")).where("c > 1")
    kept = cut(entries.groupBy("c", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "c"), "entries")
    members = cut(spread.drop("part").join(kept, "sig"), "members")
    held = cut(signed.where(F.size("sigs") > 0).select("node", "n", "tokens", "bits").join(members.select("node").distinct(), "node", "left_semi"), "tokens")
    a, b = members.where(F.col("c") <= SMALL).alias("l"), members.where(F.col("c") <= SMALL).alias("r")
    pairs = a.join(b, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.node") < F.col("r.node")) & _possible("l.", "r.", percent)).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    comps = components(cut(links_of(pairs, held, percent), "links"))
    large = members.where(F.col("c") > SMALL)
    if large.limit(1).count() == 0:
        return comps
    # at first each set looks only into its largest entry: copies of one text meet there, once instead of once for each token
    widest = cut(large.groupBy("node").agg(F.max_by(F.struct("sig", "n", "shared"), F.struct("c", "sig")).alias("e")).select("node", "e.*"), "widest")
    turn = -1
    while True:
        pool = widest if turn < 0 else large
        placed = pool.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        apart = cut(placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig"), "apart")
        if apart.limit(1).count() == 0:
            if turn >= 0:
                break
            turn = 0
            continue
        left = cut(placed.join(apart, "sig", "left_semi"), "left")
        if turn == ROUNDS:
            seen = left.join(held.select("node", "bits"), "node")
            l, r = seen.alias("l"), seen.alias("r")
            found = l.join(r, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.comp") != F.col("r.comp")) & _possible("l.", "r.", percent) & _may_differ_little("l.", "r.", percent)).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
        else:
            # the pivot stands for the component with most sets in the entry, so that only sets outside it ask
            alone = F.when(F.lit(turn <= 0), 1 - F.col("shared") / F.col("n")).otherwise(F.xxhash64(F.lit(turn), "node").cast("double"))
            held_by = left.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("sets"), F.min(F.struct(alone.alias("by"), "node", "n", "shared")).alias("p"))
            pivot = lambda df: df.groupBy("sig").agg(F.max_by(F.struct("comp", "p"), F.struct("sets", "comp")).alias("m")).select("sig", F.col("m.p.node").alias("p"), F.col("m.p.n").alias("pn"), F.col("m.p.shared").alias("pshared"), F.col("m.comp").alias("pc"))
            first = cut(pivot(held_by), "pivots")
            others = left.join(first, "sig").where("comp <> pc")
            rest = others.select(*left.columns)
            second = cut(pivot(held_by.join(first.select("sig", "pc"), "sig").where("comp <> pc").drop("pc")), "pivots")
            stars = others.unionByName(rest.join(second, "sig").where("comp <> pc"))
            found = stars.where(_possible("", "p", percent)).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))
        links = cut(links_of(found.distinct(), held, percent), "links")
        some = links.limit(1).count() > 0
        if some:
            comps = joined(comps, links)
        if turn == ROUNDS:
            break
        turn = turn + 1 if some or turn < 0 else ROUNDS
    return comps


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach).

    Words are lower-cased in A-Z. Null texts and texts without words have no
    shingles and are linked with nothing, not even each other; a text of fewer
    than k words is one shingle. Rows with a null id take no part: they return
    with a null component. Rows that repeat an id are one document; equal texts
    are one set, so copies cost one row each. Long texts are worked on whole.
    Other columns are ignored, whatever their names; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    known = narrow.where("doc_id is not null").withColumn("block", block_of("doc_id", n))
    ids = cut(narrow.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(3), "text").alias("g")), "ids")
    firsts = cut(ids.where("doc_id is not null").groupBy("h", "g").agg(F.min("doc_id").alias("node")), "firsts")

    def of_nodes(texts: pa.Table, told: pa.Table) -> pa.Table:
        """The block's texts without copies: a row for each node and text, however often it is repeated."""
        nodes = np.unique(np.array([x for x in told["node"].to_pylist() if x is not None], np.int64))
        texts = texts.filter(pa.array(np.isin(texts["doc_id"].to_numpy(), nodes)))
        ids = texts["doc_id"].to_numpy()
        if len(np.unique(ids)) == len(ids):
            return texts
        seen: set[tuple[int, bytes]] = set()
        keep = []
        for node, text in zip(ids.tolist(), texts["text"], strict=True):
            key = node, hashlib.blake2b(text.as_buffer(), digest_size=16).digest()
            keep.append(key not in seen)
            seen.add(key)
        return texts.filter(pa.array(keep, pa.bool_()))

    def ask(texts: pa.Table, told: pa.Table) -> pa.Table:
        found = [_sets(data, offsets, k)[0] for _, data, offsets in flat(of_nodes(texts, told)["text"])]
        hashes = np.concatenate([*found, np.zeros(0, U)])
        block = texts["block"][0].as_py() if len(texts) else 0
        return pa.Table.from_batches([packed(hashes, block, n)])

    # both passes over the texts share one shuffle; a block sends each bucket one row, however many files it comes from
    by_block = known.select("block", "doc_id", "text").groupBy("block")
    mine = firsts.select(block_of("node", n).alias("block"), "node")
    asked = by_block.cogroup(mine.groupBy("block")).applyInArrow(ask, ASKED)
    wanted = repeated(asked).unionByName(mine, allowMissingColumns=True)

    def sign(texts: pa.Table, told: pa.Table) -> pa.Table:
        texts = of_nodes(texts, told)
        held = Known(told.filter(told["bucket"].is_valid()), n)
        nodes = texts["doc_id"].to_pylist()
        times_seen = Counter()
        part = []
        for node in nodes:
            part.append(times_seen[node])
            times_seen[node] += 1
        out = {"node": nodes, "part": part, "n": [], "shared": [], "sigs": [], "tokens": [], "bits": []}
        for _, data, offsets in flat(texts["text"]):
            tokens, at = _sets(data, offsets, k)
            level = held.level(tokens)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                own, times = tokens[lo:hi], level[lo:hi]
                sigs = signatures(own, times, percent) if hi > lo else np.zeros(0, np.int64)
                out["n"].append(hi - lo)
                out["shared"].append(int((times > 0).sum()))
                out["sigs"].append(sigs)
                out["tokens"].append(own[times > 0].tobytes() if len(sigs) else None)
                out["bits"].append(_parities(own[times > 0]) if len(sigs) else None)
        return pa.table([pa.array(out["node"], pa.int64()), pa.array(out["part"], pa.int32()), pa.array(out["n"], pa.int64()), pa.array(out["shared"], pa.int64()), pa.array(out["sigs"], pa.list_(pa.int64())), pa.array(out["tokens"], pa.binary()), pa.array(out["bits"], pa.list_(pa.int64()))], names=list(out))

    signed = cut(by_block.cogroup(wanted.groupBy("block")).applyInArrow(sign, SIGNED), "signed")
    comps = linked_components(signed, percent)
    sizes = signed.groupBy("node").agg(F.max("n").alias("n"))
    classes = cut(firsts.join(sizes, "node").join(comps, "node", "left").select("h", "g", "n", F.coalesce("comp", "node").alias("comp")), "classes")
    placed = ids.join(classes, ["h", "g"], "left")
    alone = F.coalesce(F.col("n"), F.lit(0)) == 0
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(alone, F.col("doc_id")).otherwise(F.col("comp"))
    return placed.select(F.col("doc_id").alias(id_column), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), component.cast("long").alias("component_id"))
