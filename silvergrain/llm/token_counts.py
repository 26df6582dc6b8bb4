"""Token counts by rank-synchronous array merging.

A text is cut where a space follows another character (no piece of the model
holds a space after a non-space), each distinct pre-token of a batch is held as
one row of a ragged numpy array, and every round merges, in all rows at once,
each row's pair of best rank. What is left of a row are its tokens. A pre-token
is cut once more between two characters that stand side by side in no piece:
no merge can span them, so that a long text without spaces is many short rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Distinct pre-tokens that a Python worker keeps between batches.
KEEP = 400_000
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PairRanks:
    """The pairs of symbols that the model merges, as sorted arrays."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.ids = {p: k for k, p in enumerate(pieces)}
        self.known = len(self.ids)
        for p in pieces:
            for c in p:
                self.ids.setdefault(c, len(self.ids))
        # equal scores are taken from left to right, as one rank
        rank = {s: k for k, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        rows = sorted((self.ids[p[:k]] << 32 | self.ids[p[k:]], rank[score], self.ids[p]) for p, score in pieces.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.keys = np.array([r[0] for r in rows], np.int64)
        self.ranks = np.array([r[1] for r in rows], np.int64)
        self.made = np.array([r[2] for r in rows], np.int64)
        self.none = len(rank)
        self.single = {c: k for c, k in self.ids.items() if len(c) == 1}
        #: Characters that stand side by side in some piece.
        self.beside = np.unique(np.array([ord(a) << 32 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)], np.int64))

    def symbols(self, text: str) -> np.ndarray:
        """A symbol per character; characters outside the model get own negative numbers: -1 - their bytes."""
        get = self.single.get
        return np.fromiter((get(c, -1) if ord(c) < 128 else get(c, -len(c.encode("utf-8", "replace"))) for c in text), np.int64, len(text))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], self.none), np.where(hit, self.made[at], -1)

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        text = "".join(tokens)
        owner = np.repeat(np.arange(len(tokens)), n)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pairs = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.beside, pairs), max(len(self.beside) - 1, 0))
        starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (self.beside[at] != pairs)]) if len(text) else np.array([], np.int64)
        ends = np.r_[starts[1:], len(text)].astype(np.int64)
        return np.bincount(owner[starts], self._merged(self.symbols(text), np.repeat(np.arange(len(starts)), ends - starts), len(starts)), len(tokens)).astype(np.int64)

    def _merged(self, sym: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Symbols left of each row once no pair of its own merges."""
        total = np.zeros(rows, np.int64)
        # a character that pieces hold but that is no piece itself falls back to its bytes when it stays alone
        lone = {k: len(c.encode()) for c, k in self.single.items() if k >= self.known}
        while len(row):
            same = np.flatnonzero(row[1:] == row[:-1])
            rank, made = self.look_up(sym[same], sym[same + 1])
            best = np.full(rows, self.none, np.int64)
            np.minimum.at(best, row[same], rank)
            take = (rank < self.none) & (rank == best[row[same]])
            at, new = same[take], made[take]
            done = best[row] == self.none
            if done.any():
                weight = np.where(sym < 0, -sym, 1)
                if lone:
                    high = done & (sym >= self.known)
                    weight[high] = [lone[k] for k in sym[high].tolist()]
                total += np.bincount(row[done], weight[done], rows).astype(np.int64)
            if len(at) > 1:
                # overlapping pairs: of each chain of neighbours every second one is taken, from the left
                first = np.r_[True, at[1:] != at[:-1] + 1]
                start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                even = (np.arange(len(at)) - start) % 2 == 0
                at, new = at[even], new[even]
            sym[at] = new
            keep = ~done
            keep[at + 1] = False
            sym, row = sym[keep], row[keep]
        return total


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text in order, each with its leading marks."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " ":
        return RUNS.findall(MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", " " + MARK)).split(" ")


def count_tokens(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and whether the tokens exceed limit.

    The counts equal those of the library for the model, without begin or end.
    Null texts and empty ones have no bytes and no tokens; repeated rows are
    returned as often as they come; a null id is passed on; other columns are
    not read. Texts may be of any length: memory follows the longest text and
    the batch. An empty table gives an empty one.
    """
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, kept = _ranks(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            split = [pre_tokens(t) for t in texts]
            if len(kept) > KEEP:
                kept.clear()
            new = list({w for s in split for w in s if w not in kept})
            for k in range(0, len(new), 200_000):
                part = new[k : k + 200_000]
                kept.update(zip(part, pairs.counts(part).tolist(), strict=True))
            n = np.array([sum(map(kept.__getitem__, s)) for s in split], np.int64)
            size = np.array([len(t.encode("utf-8", "replace")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


_held: dict[str, tuple[PairRanks, dict[str, int]]] = {}


def _ranks(model_path: str) -> tuple[PairRanks, dict[str, int]]:
    """Read once in each Python worker."""
    if model_path not in _held:
        _held[model_path] = PairRanks(model_path), {}
    return _held[model_path]
