"""Repair of conversations by iterative-deepening A*.

A repaired conversation is empty or has an optional system turn and then pairs of a
user and an assistant turn.  Each row is kept, given another role or deleted, and
empty turns may be put in anywhere.  A depth-first search under a cost bound tries
edits in ASCII order (Delete, Insert, Keep, Rerole) and returns at the first
accepting path; the bound then grows to the least cost that went beyond it.  A table
holds, for each (row, state) that failed, the least cost still needed from there, so
no state is searched again with as little left.  Under the least sufficient bound the
first accepting path is the cheapest with the ASCII-least edits.

Long conversations are searched in blocks, from each state at a block's start to each
at its end, and the blocks are joined in order by the least (cost, edits) per state.
Equal costs over the same rows never have one string of edits as the other's prefix,
so the order of joined strings is that of their parts and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What edits cost; a row kept or given a role that is cut off adds ``UNFINISHED``.
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
#: Rows searched at once.
BLOCK = 64

#: States by the role of the last turn: none yet, system, user, assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a role's initial leads to from each state.
_AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: From each state the one turn that may be put in or take a row's place.
_PUT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
_ACCEPTED = (EMPTY, ASSISTANT)
_SPACE = " \t\n\x0b\f\r"

Row = tuple[str, str]  # initial of the role; "" sound, "b" blank, "d" duplicate, "t" truncated


def _moves(rows: list[Row], at: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, next row, next state) in ASCII order."""
    follower = _PUT[state][1]
    insert = ("I", INSERT, at, follower)
    if at == len(rows):
        return [insert]
    initial, fault = rows[at]
    found = [("D", DELETE, at + 1, state), insert]
    if fault not in ("b", "d"):
        more = UNFINISHED if fault == "t" else 0
        kept = _AFTER[state].get(initial)
        if kept is not None:
            found.append(("K", more, at + 1, kept))
        found.append(("R", REROLE + more, at + 1, follower))
    return found


def _needed(rows: list[Row], goals: tuple[int, ...]) -> list[list[float]]:
    """A bound from below on the cost from each (row, state) on.

    Faulty rows cost two at least.  No way leads back to an earlier state than user, so
    where only such a goal is left all rows but one system turn must be deleted.
    """
    early = max(goals) < USER
    least = [[0 if not early or state in goals else inf for state in range(4)]]
    for initial, fault in reversed(rows):
        after = least[-1]
        if early:
            row = [DELETE + after[EMPTY], DELETE + after[SYSTEM], inf, inf]
            if initial == "s" and fault not in ("b", "d"):
                row[EMPTY] = min(row[EMPTY], after[SYSTEM] + (UNFINISHED if fault else 0))
        else:
            row = [cost + (DELETE if fault else 0) for cost in after]
        least.append(row)
    return least[::-1]


def search(rows: list[Row], start: int = EMPTY, goals: tuple[int, ...] = _ACCEPTED) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest, then ASCII-least, way from ``start`` to one of ``goals``; None if there is none."""
    least = _needed(rows, goals)

    def visit(at: int, state: int, left: int) -> str | None:
        if at == len(rows) and state in goals:
            return ""
        needs = inf
        for edit, cost, then, after in _moves(rows, at, state):
            if cost + least[then][after] <= left:
                rest = visit(then, after, left - cost)
                if rest is not None:
                    return edit + rest
            needs = min(needs, cost + least[then][after])
        least[at][state] = needs
        return None

    # all rows deleted and two turns put in reach user and assistant from anywhere
    most = DELETE * len(rows) + 2 * INSERT
    bound = least[0][start]
    while bound <= most:
        edits = visit(0, start, bound)
        if edits is not None:
            return bound, edits
        bound = least[0][start]
    return None


def cheapest(rows: list[Row], block: int = BLOCK) -> tuple[int, str]:
    """(cost, edits) that repair a conversation of any length."""
    if len(rows) <= block:
        return search(rows)
    reached: dict[int, tuple[int, str]] = {EMPTY: (0, "")}
    for first in range(0, len(rows), block):
        part, onward = rows[first : first + block], {}
        last = first + block >= len(rows)
        for state, (cost, edits) in reached.items():
            for goal in _ACCEPTED if last else range(4):
                found = search(part, state, (goal,))
                if found:
                    way = cost + found[0], edits + found[1]
                    onward[goal] = min(onward.get(goal, way), way)
        reached = onward
    return min(reached.values())


def apply(rows: list[tuple[str, str]], edits: str) -> list[tuple[str, str]]:
    """The (role, text) rows after ``edits``."""
    state, at, out = EMPTY, 0, []
    for edit in edits:
        role, follower = _PUT[state]
        if edit == "I":
            out.append((role, ""))
            state = follower
            continue
        if edit == "K":
            out.append(rows[at])
            state = _AFTER[state][rows[at][0][:1]]
        elif edit == "R":
            out.append((role, rows[at][1]))
            state = follower
        at += 1
    return out


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """Each row's first fault: ``b`` blank, ``d`` duplicate, ``t`` truncated, else none."""
    seen, found = set(), []
    for role, text in rows:
        trimmed = text.rstrip(_SPACE)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        found.append("b" if not trimmed else "d" if key in seen else "" if trimmed[-1] in ".!?" else "t")
        seen.add(key)
    return found


def _conversation(turns: list[int | None], rows: list[tuple[str, str]]) -> dict[str, object]:
    kinds = faults(rows)
    known = {t for t in turns if t is not None}
    initials = [role[:1] for role, _ in rows]
    cost, edits = cheapest(list(zip(initials, kinds, strict=True)))
    repaired = apply(rows, edits)
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": kinds.count("b"),
        "duplicate": kinds.count("d"),
        "truncated": kinds.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": edits,
        "repaired": [{"role": role, "text": text} for role, text in repaired],
    }


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()),
                     ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
_DIGESTS = pa.schema([*list(_RESULT)[:-1], ("repaired_sha256", pa.string())])


def _digested(found: dict[str, object]) -> dict[str, object]:
    lines = "\n".join(f"{r['role']}:{r['text']}" for r in found.pop("repaired"))
    return found | {"repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}


def _repair_batches(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation follow one another, also from one batch to the next."""
    schema = _DIGESTS if digest else _RESULT
    ready: list[dict[str, object]] = []
    turns: list[int | None] = []
    rows: list[tuple[str, str]] = []
    begun, current = False, None

    def finish() -> None:
        found = {"conv_id": current, **_conversation(turns, rows)}
        ready.append(_digested(found) if digest else found)

    for batch in batches:
        for conv_id, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or conv_id != current:
                if begun:
                    finish()
                begun, current, turns, rows = True, conv_id, [], []
            if not gone:
                turns.append(turn)
                rows.append((role, text))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready = []
    if begun:
        finish()
        yield pa.RecordBatch.from_pylist(ready, schema)


def _run(rows: DataFrame, digest: bool) -> DataFrame:
    own = rows.select("conv_id", "turn", "role", "text", "gone")
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    last = "repaired_sha256 string" if digest else "repaired array<struct<role: string, text: string>>"
    return ordered.mapInArrow(partial(_repair_batches, digest=digest), f"conv_id long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, {last}")


def _plain(turns: DataFrame) -> DataFrame:
    words = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")}
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *words.values())


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by the checksum of ``conv_id:turn``.

    Of 20 remainders, 0 marks a row as gone, 1 empties its text, 2 takes out its
    ``.!?``, 3 doubles it and 4 sets the role user.  Null roles and texts, and nulls
    in the checksum's text, are one space.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind: Column = F.col("kind")
    dealt = _plain(turns).withColumn("kind", F.crc32(name.cast("binary")) % 20)
    texts = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = dealt.withColumns({"role": F.when(kind == 4, "user").otherwise(F.col("role")), "text": texts, "gone": kind == 0})
    return changed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))).drop("kind", "copy")


def repair(turns: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired turns of each conversation of ``turns``.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).
    Turns go by number, null first, ties by role and text; a null role or text is one
    space; rows that repeat are duplicates of the first; rows without conv_id form one
    conversation; an empty table gives an empty result; other columns are not looked
    at.  A conversation is one row of the result, so its rows meet in one task; the
    search works on blocks of ``BLOCK`` rows.
    """
    return _run(_plain(turns).withColumn("gone", F.lit(False)), False)


def report(turns: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a digest in place of the repaired turns.

    Rows marked as gone count for nothing, but their conversation is reported: without
    other rows all its counts are 0 and it has no turns.
    """
    return _run(damage(turns), True)
