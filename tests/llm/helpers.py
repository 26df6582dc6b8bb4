"""Plain versions of the operators, and tables with odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {k: k + 32 for k in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASHING = ("h", "node", "size", "block", "shard", "n", "comp", "words", "__w", "rank")


def odd_texts() -> list[str | None]:
    passage = "the quick brown fox jumps over the lazy dog while seven wizards mix boxes of jade and quartz under a pale moon tonight "
    base = passage * 2 + "and the story ends with a long walk home through fields of barley and rye where nobody speaks a word"
    other = "Ünïcode wörds — ménage 日本語 テキスト 😀 and some ASCII to go with it, " * 3
    return [
        base,
        base,
        base.upper(),
        base.replace("barley", "wheat"),
        None,
        "",
        " \n\t ",
        "one",
        "one two",
        "ONE TWO",
        "one two three four five",
        other,
        other + "tail",
        "x" * 400,
        "x" * 250 + "y",
        "\n".join(["a line that repeats", "another line", "a line that repeats", "", "  "] * 6),
        "# * $ % & | < > " * 30,
        ("long " + " ".join(f"word{k % 977}" for k in range(30_000))),
        "a b c " * 200,
        "<|endoftext|> a  b   c\r\n\x00 ▁mark </s> é",
        passage,
    ]


def odd_documents(spark, clashing: bool = False):
    rows = [(k, t, ("en", "de", None)[k % 3], ("s1", None, "s2", "s2")[k % 4], None if t is None else len(t)) for k, t in enumerate(odd_texts())]
    rows += [(3, odd_texts()[3], "en", "s2", 1), (3, odd_texts()[3], "en", "s2", 1)]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        for c in CLASHING:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("other"))
    return df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None, lower: bool = False) -> list[str]:
    t = text or ""
    return WORD.findall(t.translate(LOWER) if lower else t)


def shingles(text: str | None, k: int = 5) -> set:
    w = words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeated_passages(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for d, t in sorted(dict(rows).items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text)
    places: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(3)}
    lines, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def fold(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def unigrams(rows) -> tuple[Counter, int, int]:
    c = Counter(w for d, t in rows if fold(d) != 2 for w in [*words(t, True), "\0end"])
    return c, sum(c.values()), len(c)
