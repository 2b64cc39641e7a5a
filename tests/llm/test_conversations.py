"""Conversation repair against a plain dynamic program that keeps whole audits."""

import hashlib
import random
import re
import zlib

import pytest

from gridweave.llm import queries as Q
from gridweave.llm.common import table
from gridweave.llm.conversations import conversation_report, repair_conversations

SF = "/root/testdata/sf0.001"
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [] if kind == 0 else [(c, t, role, text)] * (2 if kind == 3 else 1)
    return out


def repair(rows):
    """The result columns behind conv_id for the (turn, role, text) of one conversation, in order."""
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}  # state -> cost, audit, lines

    def take(to, new):
        if new[1] is not None and (new[0] not in to or new[1] < to[new[0]]):
            to[new[0]] = new[1]

    def inserted(at):
        for _ in range(3):
            for s, (cost, audit, lines) in list(at.items()):
                to = follows[s]
                take(at, (to, (cost + 2, audit + "I", (*lines, ("user" if to == "u" else "assistant") + ":"))))
        return at

    best = inserted(best)
    for (_, role, text), fault, first in zip(rows, faults, initials, strict=True):
        to = {}
        for s, (cost, audit, lines) in best.items():
            take(to, (s, (cost + 3, audit + "D", lines)))
            if fault in ("b", "d"):
                continue
            extra = fault == "t"
            if first == follows[s] or (first == "s" and s == ""):
                take(to, (first, (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
            name = "user" if follows[s] == "u" else "assistant"
            take(to, (follows[s], (cost + 2 + extra, audit + "R", (*lines, f"{name}:{text}"))))
        best = inserted(to)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha


def brute(rows, damaging=True):
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    groups = {c: [] for c, *_ in rows}
    for c, t, role, text in damage(rows) if damaging else spaced:
        groups[c].append((t, role, text))
    low = -(2**63)
    return {c: repair(sorted(g, key=lambda r: (low if r[0] is None else r[0], r[1]))) for c, g in groups.items()}


def held(df, want):
    got = {r.conv_id: tuple(r[k] for k in NAMES[1:]) for r in df.select(*NAMES).collect()}
    assert df.count() == len(got) == len(want)
    for c, row in want.items():
        assert got[c] == row, c


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, seq string")


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", "agent", "umpire", None]


def chat(r, conv, n, kinds=40):
    """Turns that differ, and texts of every kind of fault."""
    return [
        (conv, k if r.random() < 0.97 else None, r.choice(ROLES[: 4 + r.randrange(7)]), r.choice([f"said {r.randrange(kinds)}.", f"cut {k}", "", " \t", None, "é!", f"well {k}? \n"]))
        for k in r.sample(range(-n, 3 * n), n)
    ]


def one_null_turn(rows):
    """Turns of a conversation differ: ties have an order of their own, tested apart."""
    seen, out = set(), []
    for x in rows:
        if (x[0], x[1]) not in seen:
            seen.add((x[0], x[1]))
            out.append(x)
    return out


@pytest.mark.parametrize("damaging", [True, False])
def test_many_short_conversations(spark, damaging):
    r = random.Random(5)
    rows = one_null_turn([x for c in [None, *range(300)] for x in chat(r, c, r.randrange(1, 9))])
    r.shuffle(rows)
    held(conversation_report(frame(spark, rows)) if damaging else repair_conversations(frame(spark, rows)), brute(rows, damaging))


def test_one_conversation_holds_most_rows(spark):
    """It goes over several partitions and many segments; so do its duplicates."""
    r = random.Random(9)
    rows = one_null_turn([x for c in range(40) for x in chat(r, c, 5)] + chat(r, 777, 700, 30) + [(778, k, "user", "the same.") for k in range(300)])
    r.shuffle(rows)
    df = frame(spark, rows).repartition(6)
    held(repair_conversations(df, segment_rows=16), brute(rows, False))
    held(conversation_report(df), brute(rows))


def test_every_conversation_in_segments(spark):
    r = random.Random(11)
    rows = one_null_turn([x for c in range(60) for x in chat(r, c, r.randrange(1, 14))])
    held(repair_conversations(frame(spark, rows), segment_rows=2), brute(rows, False))


def test_repeated_rows_are_duplicates(spark):
    rows = [(1, 4, "user", "hello there.")] * 3000 + [(1, 5, "assistant", "hi!"), (2, 1, "user", "one"), (2, 1, "user", "one")]
    held(repair_conversations(frame(spark, rows), segment_rows=64), brute(rows, False))


def test_ties_of_a_turn_go_by_role(spark):
    rows = [(1, 1, "user", "b?"), (1, 1, "assistant", "a."), (1, 1, "system", "c.")]
    got = repair_conversations(frame(spark, rows)).first()
    assert (got.audit, got.illegal, got.gaps) == brute(rows, False)[1][6:7] + (brute(rows, False)[1][4], 0)


def test_long_texts_extreme_turns_and_nothing(spark):
    rows = [(1, -(2**63), "user", "x" * 3_000_000), (1, 2**63 - 1, "assistant", " " * 2_000_000 + "y."), (2, None, None, None)]
    want = brute(rows, False)
    want[1] = (2**63 - 1, *want[1][1:])
    held(repair_conversations(frame(spark, rows)), want)
    assert repair_conversations(frame(spark, [])).count() == 0
    dropped = [(c, t, "user", "gone.") for c in range(50) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    held(conversation_report(frame(spark, dropped)), {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in dropped})


def test_query_against_brute_force(spark):
    rows = [tuple(x) for x in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    held(Q.op13_conversation_repair(spark, SF), brute(rows))
