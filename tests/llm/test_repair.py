import hashlib
import random
import zlib

from contestry.llm import repair

FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def brute(rows):
    """(cost, edits, repaired) by relaxing every state row by row; rows of (role, text, fault)."""

    def put_in(best):
        for _ in range(2):
            more = dict(best)
            for last, (cost, edits, out) in best.items():
                for after in FOLLOWS[last].replace("s", ""):
                    way = (cost + 5, edits + "I", [*out, (NAMES[after], "")])
                    more[after] = min(more.get(after, way), way)
            best = more
        return best

    best = {"": (0, "", [])}
    for role, text, fault in rows:
        onward = {}
        for last, (cost, edits, out) in put_in(best).items():
            ways = [(last, (cost + 2, edits + "D", out))]
            if fault not in ("b", "d"):
                extra = 5 if fault == "t" else 0
                if role[:1] and role[:1] in FOLLOWS[last]:
                    ways.append((role[:1], (cost + extra, edits + "K", [*out, (role, text)])))
                ways += [(a, (cost + extra + 1, edits + "R", [*out, (NAMES[a], text)])) for a in FOLLOWS[last] if a in NAMES]
            for after, way in ways:
                onward[after] = min(onward.get(after, way), way)
        best = onward
    return min(way for last, way in put_in(best).items() if last in ("", "a"))


def test_search_and_blocks_find_the_cheapest_then_least_edits():
    rng = random.Random(3)
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", " ", "", "tool"]), f"t{k}", rng.choice(["", "", "", "b", "d", "t"])) for k in range(rng.randrange(13))]
        cost, edits, out = brute(rows)
        short = [(r[:1], f) for r, _, f in rows]
        assert repair.search(short) == (cost, edits)
        assert {repair.cheapest(short, block) for block in (1, 2, 5)} == {(cost, edits)}
        assert repair.apply([(r, t) for r, t, _ in rows], edits) == out


def test_long_conversations_end_in_time():
    rng = random.Random(4)
    rows = [(rng.choice("uuaa"), rng.choice(["", "", "", "b", "d", "t"])) for _ in range(4000)]
    cost, edits, _ = brute([(r, "", f) for r, f in rows])
    assert repair.cheapest(rows) == (cost, edits)


def expected(rows):
    """The report by plain Python; rows of (conv_id, turn, role, text)."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
            own += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        own.sort(key=lambda r: (*r[:2], r[2].encode(), r[3].encode()))
        marked = []
        for k, (_, _, role, text) in enumerate(own):
            trimmed = text.strip(" \t\n\x0b\f\r")
            seen = (role, text) in [r[2:] for r in own[:k]]
            marked.append((role, text, "b" if not trimmed else "d" if seen else "" if trimmed[-1] in ".!?" else "t"))
        turns = [r[1] for r in own if r[0]]
        cost, edits, out = brute(marked)
        kinds = [f for *_, f in marked]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[conv] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, edits, digest)
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def odd_turns():
    rng = random.Random(9)
    texts = ["Fine.", "cut off", "", " \n", None, "What?", "line\nline.", "é中😀!", "x " * 4000 + "."]
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "", "tool"]), rng.choice(texts)) for c in range(60) for t in range(rng.randrange(9))]
    rows += [(None, None, "user", "a."), (None, None, "assistant", "b."), (None, 1, None, None), (100, 5, "user", "u."), (100, 5, "user", "u."), (100, 9, "assistant", "a.")]
    rows += [(101, t, "user" if t % 2 else "assistant", f"text {t}{'.' if t % 5 else ''}") for t in range(300)]
    return rows


def test_report_of_odd_turns(spark):
    rows = odd_turns()
    # 20 conversations of one row: some lose it, and are still reported
    rows += [(200 + k, 0, "user", "Alone.") for k in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS gone", "1 AS cost", "'k' AS kind", "0 AS copy")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.report(turns.repartition(4)).collect()}
    assert got == expected(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()
    assert repair.report(turns.limit(0)).collect() == []


def test_repair_gives_the_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "assistant", " "), (2, 0, "assistant", "Only."), (3, 0, "system", "S."), (3, 1, "user", "Q?"), (3, 2, "assistant", "cut")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS gone", "'x' AS repaired")
    found = {r.conv_id: (r.audit, [tuple(t) for t in r.repaired]) for r in repair.repair(turns).collect()}
    assert found[1] == ("KRD", [("user", "Hi."), ("assistant", "Hello.")])
    assert found[2] == ("D", [])
    assert found[3] == ("RRD", [("user", "S."), ("assistant", "Q?")])  # 4, where a row that is cut off costs 5
    assert repair.repair(turns.limit(0)).collect() == []
