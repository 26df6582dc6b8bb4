"""Repair of conversation structure with the fewest costs.

Turns are sorted by ranges, so that every task holds a stretch of the whole
order. A backward pass gives the cost to go from each place of a conversation in each state of
the role grammar; a forward walk then takes, among the edits on which that cost
is tight, the one of least initial. Conversations inside one stretch are
done there. Those that stretches cut through, two for each stretch at most, are
put together from summaries: the least cost from each state before a stretch to
each state after it, then the walk from each state, so that no task holds a long
conversation. Only the hash of a repaired conversation is one pass over all of
it, in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.common import broadcast_if_small, cut, partitions

_BLANK = " \t\n\x0b\x0c\r"
#: Costs of the edits, and what an undeleted truncated turn adds.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; what each initial leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state that a new or renamed turn leads to, and its role.
OWED = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
INFINITE = 1 << 40
#: Costs to go where the conversation ends.
END = (0, INFINITE, INFINITE, 0)
#: Faults.
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
#: Bytes of a piece of repaired text, about.
PIECE = 1 << 22


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(conv_id:turn) % 20 names; nulls of role and text are one space, those of the key too."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    what = F.crc32(named) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), what.alias("what")).where("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def with_inserts(v: tuple[int, ...] | list[int]) -> tuple[int, int, int, int]:
    """Costs to go, if turns may be inserted first."""
    two, three = min(v[2], v[3] + INSERT), min(v[3], v[2] + INSERT)
    return min(v[0], two + INSERT), min(v[1], two + INSERT), two, three


def cost_to_go(faults: list[int], initials: list[str], after: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """Costs to go from before each turn, and from the end, in each state; after: those beyond the end."""
    now = with_inserts(after)
    out = [now]
    for fault, initial in zip(reversed(faults), reversed(initials), strict=True):
        gone = [c + DELETE for c in now]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT_OFF else 0
            for s in range(4):
                gone[s] = min(gone[s], now[OWED[s]] + REROLE + more)
                to = NEXT[s].get(initial)
                if to is not None:
                    gone[s] = min(gone[s], now[to] + more)
        now = with_inserts(gone)
        out.append(now)
    out.reverse()
    return out


def walk(faults: list[int], initials: list[str], costs: list[tuple[int, int, int, int]], state: int, last: bool) -> tuple[str, int]:
    """Edits from state on, of those on which the costs are tight always that of least initial; and the state they end in.

    Turns between two stretches are inserted by the later one; last: there is none.
    """
    edits, i, n = [], 0, len(faults)
    while i < n or (last and state not in (0, 3)):
        left = costs[i][state]
        owed = OWED[state]
        if i < n and costs[i + 1][state] + DELETE == left:
            edits.append("D")
            i += 1
        elif costs[i][owed] + INSERT == left:
            edits.append("I")
            state = owed
        else:
            more = TRUNCATED if faults[i] == CUT_OFF else 0
            to = NEXT[state].get(initials[i])
            if to is not None and costs[i + 1][to] + more == left:
                edits.append("K")
            else:
                edits.append("R")
                to = owed
            state = to
            i += 1
    return "".join(edits), state


def rendered(edits: str, state: int, roles: list[str], texts: list[str]) -> Iterator[str]:
    """The lines role:text of the repaired turns."""
    i = 0
    for e in edits:
        if e == "I":
            state = OWED[state]
            yield f"{ROLE[state]}:"
            continue
        if e == "K":
            state = NEXT[state][roles[i][:1]]
            yield f"{roles[i]}:{texts[i]}"
        elif e == "R":
            state = OWED[state]
            yield f"{ROLE[state]}:{texts[i]}"
        i += 1


def counts(turns: list[int | None], faults: list[int], initials: list[str]) -> dict[str, Any]:
    """What a stretch adds to a conversation's figures, with its ends."""
    known = [t for t in turns if t is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    distinct = sum(k == 0 or known[k - 1] != t for k, t in enumerate(known))
    return {
        "low": known[0] if known else None,
        "high": known[-1] if known else None,
        "turns": distinct,
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(CUT_OFF),
        "illegal": illegal,
        "first": initials[0],
        "final": initials[-1],
    }


def summed(parts: list[dict[str, Any]]) -> dict[str, int]:
    """gaps, blank, duplicate, truncated and illegal of a conversation from its stretches in order."""
    known = [p for p in parts if p["low"] is not None]
    distinct = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
    out = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(a["final"] + b["first"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
    out["gaps"] = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
    return out


_FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_KEY = ["task", "slot"]


def _batch(rows: list[dict[str, Any]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _arrow(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _columns(t: pa.Table) -> tuple[list, list, list, list, list]:
    """turns, roles, texts, faults and initials of a stretch's rows, dup markers merged in."""
    t = t.sort_by([("at", "ascending"), ("kind", "ascending")])
    turns, roles, texts, faults, initials = [], [], [], [], []
    again = False
    for kind, turn, role, text, fault in zip(*(t[c].to_pylist() for c in ("kind", "turn", "role", "text", "fault")), strict=True):
        if kind == 0:
            again = True
            continue
        turns.append(turn)
        roles.append(role)
        texts.append(text)
        faults.append(DUPLICATE if again and fault != BLANK else fault)
        initials.append(role[:1])
        again = False
    return turns, roles, texts, faults, initials


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of turns (conv_id, turn, role, text).

    Turns are taken as they are (damaged() is a step of its own) in the order of turn, nulls first,
    then of role and text. A turn's first fault counts: blank, a role and
    text seen earlier, an end that isn't one of .!?. The edits are those of least cost that give roles of
    initials (s?(ua)+)?, of these the ones whose initials come first in ASCII.
    Rows with a null conv_id are one conversation. Null roles and texts are one
    space; other columns are ignored, whatever their names; rows alike are
    turns of their own, duplicates from the second on. Very long texts stay in their
    row. A conversation of any length is worked on in stretches. An empty table gives no rows.
    """
    spark = turns.sparkSession
    n = partitions(spark)
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    order = ["conv", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    end = F.rtrim(F.col("text"), F.lit(_BLANK))
    fault: Column = F.when(end == "", BLANK).when(F.substring(end, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT_OFF)
    named = [F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.col("role"), F.col("text")]
    placed = cut(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order, fault.alias("fault"), F.xxhash64(*named).alias("h1"), F.xxhash64(F.lit(12), *named).alias("h2"), F.monotonically_increasing_id().alias("at")),
        "turns",
    )
    leads = cut(placed.groupBy("h1", "h2").agg(F.min("at").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "leads")
    again = placed.select("h1", "h2", "at").join(broadcast_if_small(leads), ["h1", "h2"]).where("at <> lead").select("at")
    # a marker before each duplicate's row, in its place
    marked = lambda rows, *named: rows.select("at", F.lit(0).alias("kind"), *named).unionByName(placed.limit(0).select("at", "turn", "role", "text", "fault"), allowMissingColumns=True)
    held = placed.select("at", F.lit(1).alias("kind"), *order, "fault").unionByName(marked(again), allowMissingColumns=True)
    dealt = held.withColumn("task", F.shiftright("at", 33)).repartition(n, "task").sortWithinPartitions("at", "kind")

    figures = "conv long, " + ", ".join(f"{c} long" for c in [*_FIGURES, "cost"]) + ", audit string, repaired_sha256 string"
    first_schema = _arrow(figures + ", task long, slot int", spark)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stretch's conversations, those at its ends by name alone."""
        task = conv = None
        own: tuple[list, ...] = ([], [], [], [], [])
        number, again = 0, False
        done: list[dict[str, Any]] = []

        def finished(at_end: bool) -> None:
            nonlocal number
            if not own[0]:
                return
            if number == 0 or at_end:
                done.append({"conv": conv, "task": task, "slot": 0 if number == 0 else 1})
            else:
                turn, roles, texts, faults, initials = own
                costs = cost_to_go(faults, initials, END)
                edits, _ = walk(faults, initials, costs, 0, True)
                text = "\n".join(rendered(edits, 0, roles, texts))
                done.append({"conv": conv, **summed([counts(turn, faults, initials)]), "cost": costs[0][0], "audit": edits, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()})
            number += 1
            for c in own:
                c.clear()

        for b in batches:
            for at, kind, c, turn, role, text, fault in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if kind == 0:
                    again = True
                    continue
                if at >> 33 != task:
                    finished(True)
                    task, conv, number = at >> 33, c, 0
                elif c != conv:
                    finished(False)
                    conv = c
                if number or not own[0]:  # of the stretch's first conversation, which is left to those that stretches cut, one row is enough
                    for column, x in zip(own, (turn, role, text, DUPLICATE if again and fault != BLANK else fault, role[:1]), strict=True):
                        column.append(x)
                again = False
            if done:
                yield _batch(done, first_schema)
                done.clear()
        finished(True)
        yield _batch(done, first_schema)

    found = cut(dealt.select("at", "kind", *order, "fault").mapInArrow(whole, figures + ", task long, slot int"), "whole")
    inside = found.where("task is null").drop("task", "slot")
    cuts = found.where("task is not null").select(F.col("conv").alias("open"), *_KEY)  # two rows for each stretch at most
    texts = placed.select("at", F.lit(1).alias("kind"), *order, "fault", F.shiftright("at", 33).alias("task"))
    stretch = texts.join(F.broadcast(cuts.withColumnRenamed("task", "__task")), (F.col("task") == F.col("__task")) & F.col("conv").eqNullSafe(F.col("open"))).drop("__task", "open")
    places = marked(stretch.select("at", "conv", *_KEY).join(again, "at"), "conv", *_KEY)
    parts = cut(stretch.unionByName(places, allowMissingColumns=True), "stretches")

    summary = "conv long, task long, slot int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, final string, costs array<long>"
    summary_schema = _arrow(summary, spark)

    def summarised(t: pa.Table) -> pa.Table:
        turn, _, _, faults, initials = _columns(t)
        # least cost from each state before the stretch to each one after it
        costs = [cost_to_go(faults, initials, tuple(0 if s == e else INFINITE for s in range(4)))[0] for e in range(4)]
        flat = [min(costs[e][s], INFINITE) for s in range(4) for e in range(4)]
        row = {"conv": t["conv"][0].as_py(), "task": t["task"][0].as_py(), "slot": t["slot"][0].as_py(), **counts(turn, faults, initials), "costs": flat}
        return pa.Table.from_pylist([row], summary_schema)

    each = cut(parts.groupBy(*_KEY).applyInArrow(summarised, summary), "summaries")  # two rows for each stretch at most
    in_order = lambda df, *c: df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*_KEY, *c))).alias("parts"))  # noqa: E731  a stretch has one part of it at most
    linked = "conv long, " + ", ".join(f"{c} long" for c in [*_FIGURES, "cost"]) + ", ends array<struct<task:long,slot:int,after:array<long>,last:boolean>>"
    linked_schema = _arrow(linked, spark)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                now, ends = END, []
                for k, p in enumerate(reversed(row["parts"])):
                    ends.append({"task": p["task"], "slot": p["slot"], "after": list(now), "last": k == 0})
                    now = tuple(min(p["costs"][4 * s + e] + now[e] for e in range(4)) for s in range(4))
                out.append({"conv": row["conv"], **summed(row["parts"]), "cost": now[0], "ends": ends})
            yield _batch(out, linked_schema)

    backward = cut(in_order(each, *[c for c in each.columns if c not in ("conv", *_KEY)]).mapInArrow(link, linked), "linked")
    after = backward.select(F.explode("ends").alias("e")).select("e.*")
    walked = "conv long, task long, slot int, audits array<string>, exits array<int>"
    walked_schema = _arrow(walked, spark)

    def walks(t: pa.Table) -> pa.Table:
        _, _, _, faults, initials = _columns(t)
        costs = cost_to_go(faults, initials, tuple(t["after"][0].as_py()))
        ways = [walk(faults, initials, costs, s, t["last"][0].as_py()) for s in range(4)]
        row = {"conv": t["conv"][0].as_py(), "task": t["task"][0].as_py(), "slot": t["slot"][0].as_py(), "audits": [w[0] for w in ways], "exits": [w[1] for w in ways]}
        return pa.Table.from_pylist([row], walked_schema)

    forward = cut(parts.join(F.broadcast(after), _KEY).groupBy(*_KEY).applyInArrow(walks, walked), "walks")  # two rows for each stretch at most
    chosen = "conv long, audit string, pieces array<struct<task:long,slot:int,entry:int,edits:string>>"
    chosen_schema = _arrow(chosen, spark)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                state, pieces = 0, []
                for p in row["parts"]:
                    pieces.append({"task": p["task"], "slot": p["slot"], "entry": state, "edits": p["audits"][state]})
                    state = p["exits"][state]
                out.append({"conv": row["conv"], "audit": "".join(p["edits"] for p in pieces), "pieces": pieces})
            yield _batch(out, chosen_schema)

    audits = cut(in_order(forward, "audits", "exits").mapInArrow(choose, chosen), "audits")
    pieces = audits.select(F.explode("pieces").alias("p")).select("p.*")
    shown = "conv long, task long, piece int, bytes binary"
    shown_schema = _arrow(shown, spark)

    def show(t: pa.Table) -> pa.Table:
        _, roles, texts, _, _ = _columns(t)
        out, held, size = [], [], 0
        name = {"conv": t["conv"][0].as_py(), "task": t["task"][0].as_py()}
        for line in rendered(t["edits"][0].as_py(), t["entry"][0].as_py(), roles, texts):
            held.append(line.encode())
            size += len(held[-1])
            if size >= PIECE:
                out.append({**name, "piece": len(out), "bytes": b"\n".join(held)})
                held, size = [], 0
        if held:
            out.append({**name, "piece": len(out), "bytes": b"\n".join(held)})
        return pa.Table.from_pylist(out, shown_schema)

    lines = parts.join(F.broadcast(pieces), _KEY).groupBy(*_KEY).applyInArrow(show, shown)  # two rows for each stretch at most
    hash_schema = _arrow("conv long, repaired_sha256 string", spark)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = digest = None
        for b in batches:
            out = []
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                    conv, digest = c, hashlib.sha256(x)
                else:
                    digest.update(b"\n")
                    digest.update(x)
            yield _batch(out, hash_schema)
        yield _batch([] if digest is None else [{"conv": conv, "repaired_sha256": digest.hexdigest()}], hash_schema)

    hashed = lines.repartition(n, "conv").sortWithinPartitions("conv", "task", "piece").select("conv", "bytes").mapInArrow(hashes, "conv long, repaired_sha256 string")
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"])
    crossed = backward.drop("ends").join(audits.drop("pieces"), same(backward, audits)).select(*[backward[c] for c in ("conv", *_FIGURES, "cost")], audits["audit"])
    across = crossed.join(hashed, same(crossed, hashed), "left").select(*[crossed[c] for c in crossed.columns], hashed["repaired_sha256"])
    return inside.unionByName(across).withColumnRenamed("conv", "conv_id")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """repair() of the damaged turns, with a row for every conv_id of turns: zeros, an empty audit and the hash of nothing where the damage leaves no turn."""
    every = turns.select(F.col("conv_id").cast("long").alias("__conv")).distinct()
    done = repair(damaged(turns))
    nothing = hashlib.sha256(b"").hexdigest()
    both = every.join(done, F.col("__conv").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*_FIGURES, "cost"]]
    return both.select(F.col("__conv").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
