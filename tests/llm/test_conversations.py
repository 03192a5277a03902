"""Conversation repair against a plain dynamic programme over whole conversations."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from lumenrisk.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, extra string"
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
TO = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
LONG = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for c, t, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        if kind:
            out += [(c, t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def plain(rows):
    """rows of one conversation after damage, in order."""
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    seen, edits = set(), {0: (0, "", [])}

    def better(to, s, new):
        if s not in to or new[:2] < to[s][:2]:
            to[s] = new

    def inserted(at):
        at = dict(at)
        for _ in range(3):
            for s, (c, a, lines) in list(at.items()):
                better(at, TO[s][1], (c + 3, a + "I", [*lines, LONG[TO[s][0]] + ":"]))
        return at

    for _, _, role, text in rows:
        bare = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        to, more = {}, 3 * (fault == "truncated")
        for s, (c, a, lines) in inserted(edits).items():
            better(to, s, (c + 4, a + "D", lines))
            if fault not in ("blank", "duplicate"):
                if role[:1] in STEPS[s]:
                    better(to, STEPS[s][role[:1]], (c + more, a + "K", [*lines, f"{role}:{text}"]))
                new, s2 = TO[s]
                better(to, s2, (c + 3 + more, a + "R", [*lines, f"{LONG[new]}:{text}"]))
        edits = to
    cost, audit, lines = min(v for s, v in inserted(edits).items() if s in (0, 3))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return {"gaps": gaps, **counts, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    return {c: plain(sorted(own, key=key)) for c, own in by.items()}


def made(seed, convs, turns):
    rng, out = np.random.default_rng(seed), []
    roles = ["user", "assistant", "system", "tool", "", "User", None]
    for c in range(convs):
        for t in range(int(rng.integers(1, turns))):
            role = ("system" if t == 0 and rng.random() < 0.3 else ("user", "assistant")[t % 2]) if rng.random() < 0.7 else roles[rng.integers(len(roles))]
            text = [f"Line {rng.integers(30)}.", f"cut {rng.integers(30)}", "", None, " \n", "Same one!", "é ü?  "][rng.choice(7, p=[0.5, 0.2, 0.05, 0.05, 0.05, 0.1, 0.05])]
            out.append((c, None if rng.random() < 0.04 else int(t + (rng.random() < 0.1) * rng.integers(3)), role, text, "x"))
    return out


def found(df):
    rows = [r.asDict() for r in df.collect()]
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r.pop("conv_id"): r for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_plain_programme(spark, seed):
    rows = made(seed, 150, 14)
    rows += [(None, 1, "user", "No id.", "x"), (None, 2, "assistant", "Fine.", "x"), (900, None, None, None, "x"), (901, 5, "user", "word " * 30000 + ".", "x")]
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = found(conversations.damaged_repair(df))
    assert got == expected(rows)


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_long_conversations_are_stitched(spark, chunk):
    """Several long conversations over many tasks and chunks; one holds a long passage of repeats, one only such."""
    rows = [(7, t, r, x, "x") for _, t, r, x, _ in made(5, 30, 20)]
    rows = [(c, i, r, x, e) for i, (c, _, r, x, e) in enumerate(rows)]
    rows += [(8, i, ("user", "assistant")[i % 2], "Again and again." if 40 < i < 160 else f"Turn {i}.", "x") for i in range(220)]
    rows += [(9, i, "user", "", "x") for i in range(90)] + [(10, 4, "assistant", "Same.", "x")] * 70
    rows += made(6, 12, 6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(conversations.repair(conversations.damage(df), df, chunk)) == expected(rows)


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    rng = np.random.default_rng(3)
    for _ in range(50):
        rows = [("sua-"[rng.integers(4)], bool(rng.random() < 0.3), False) for _ in range(rng.integers(1, 30))]
        new = tuple(int(x) for x in rng.integers(0, 7, 4))
        new = tuple(x - min(new) for x in new)
        left, total = conversations.backward(rows, conversations.SPECULATIVE)
        assert conversations.refit(rows, conversations.SPECULATIVE, new, left, total) == conversations.backward(rows, new)


def test_every_row_lost_and_empty_table(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hello.", "x")], SCHEMA)
    assert found(conversations.damaged_repair(df)) == {lost: {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}}
    assert found(conversations.damaged_repair(df.where("false"))) == {}
