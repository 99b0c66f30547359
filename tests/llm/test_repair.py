import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from faultline.llm import queries, repair
from llm_tables import listed

SCHEMA = "conv_id long, turn long, role string, text string, TEXT string, Role string"


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        if kind:
            yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def cheapest(rows):
    """Faults, and the least (cost, audit) over all edits, grown forwards row by row."""
    faults, seen = [], set()
    for _, role, text in rows:
        words = text.rstrip(" \t\n\v\f\r")
        faults.append(
            "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
        )
        seen.add((role, text))
    every = [("", 0, "", ())]  # (grammar state, cost, audit, lines) of what is edited so far
    for (_, role, text), fault in zip(rows, faults):
        grown = expand(every)
        after = []
        for short, cost, audit, lines in grown:
            after.append((short, cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            stay = 3 if fault == "truncated" else 0
            if role[:1] and role[0] in step(short):
                after.append((moved(short, role[0]), cost + stay, audit + "K", lines + (f"{role}:{text}",)))
            given = "assistant" if short == "u" else "user"
            after.append((moved(short, given[0]), cost + 3 + stay, audit + "R", lines + (f"{given}:{text}",)))
        every = pruned(after)
    done = [(cost, audit, lines) for short, cost, audit, lines in expand(every) if short in ("", "ua")]
    cost, audit, lines = min(done)
    return faults, cost, audit, "\n".join(lines)


def step(short):
    return {"": "su", "s": "u", "u": "a", "ua": "u"}[short]


def moved(short, initial):
    return {"s": "s", "u": "u", "a": "ua"}[initial]


def expand(states):
    """Each state, with up to three inserts."""
    found = list(states)
    for _ in range(3):
        states = [
            (moved(s, g[0]), cost + 3, audit + "I", lines + (f"{g}:",))
            for s, cost, audit, lines in states for g in ["assistant" if s == "u" else "user"]
        ]
        found += states
    return found


def pruned(states):
    """Per state, only the cheapest, of these the least audit: all consume the same rows."""
    best = {}
    for s, cost, audit, lines in states:
        if s not in best or (cost, audit) < best[s][:2]:
            best[s] = (cost, audit, lines)
    return [(s, *b) for s, b in best.items()]


def brute(rows):
    found = {}
    groups = defaultdict(list)
    for conv, *_ in rows:
        groups[conv] = []
    for conv, turn, role, text in damaged(rows):
        groups[conv].append((turn, role, text))
    for conv, lines in groups.items():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][: repair.PREFIX], hashlib.md5(r[2].encode()).digest()))
        turns = [t for t, *_ in lines if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = zip((r[1][:1] for r in lines), (r[1][:1] for r in lines[1:]))
        faults, cost, audit, text = cheapest(lines)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
        found[conv] = (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def found(spark, rows, **columns):
    table = repair.clean(spark.createDataFrame([(*r, None, "x") for r in rows], SCHEMA))
    got = [tuple(r.values()) for r in listed(repair.digests(repair.damaged(table), table))]
    assert len({g[0] for g in got}) == len(got)
    return {g[0]: g for g in got}


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    query = queries.op11_repair(spark, sf)
    assert query.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    ]
    assert {r["conv_id"]: tuple(r.values()) for r in listed(query)} == brute(rows)


def random_rows(seed, convs, length):
    import random

    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "US"]
    texts = ["One.", "Two words", " \t", "", None, "Is it?", "No!\n", "end . x", "One.", "x" * 40 + ".", "x" * 40 + "!"]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(length + 1)):
            turn = rng.choice([t, t, t, t + 3, None, rng.randrange(3)])
            rows.append((rng.choice([c, c, c, None]), turn, rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [1, 3, 256])
def test_random_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = random_rows(block, 60, 9)
    assert found(spark, rows) == brute(rows)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 16)
    rows = [(7, t // 2, "user" if t % 3 else "assistant", f"Line {t % 50}" + "." * (t % 2)) for t in range(4000)]
    rows += [(8, 1, "user", "a?"), (8, 1, "user", "a?"), (9, None, None, None)]
    assert found(spark, rows) == brute(rows)
    table = repair.ordered(repair.clean(spark.createDataFrame([(*r, None, "x") for r in rows], SCHEMA)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    blocks = repair.signatures(table).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({b.part for b in blocks if b.c == "7"}) > 1 and max(len(b.sig) for b in blocks) <= 16


def test_repaired_lines(spark):
    rows = [(1, 0, "user", "Hi there."), (1, 1, "user", "Are you?"), (1, 2, "assistant", "Yes."), (1, 3, "system", " ")]
    lines = listed(repair.repaired(spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA)))
    lines = [tuple(r.values()) for r in sorted(lines, key=lambda r: r["place"])]
    assert lines == [
        (1, 1, "K", "user", "Hi there."), (1, 2, "I", "assistant", ""),
        (1, 3, "K", "user", "Are you?"), (1, 4, "K", "assistant", "Yes."),
    ]
    assert listed(repair.repaired(spark.createDataFrame([], SCHEMA))) == []


def test_empty_table_and_dropped_rows(spark):
    assert found(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "a.")]) == {
        gone: (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    }


def test_endings_are_shared(monkeypatch):
    import pyarrow as pa

    made = []
    plain = repair.node
    monkeypatch.setattr(repair, "node", lambda symbol, after: made.append(symbol) or plain(symbol, after))
    sigs = sorted({"uaua", "saua", "xua", "ua", "oua"}, key=lambda s: s[::-1])
    rows = [r for b in repair._endings([pa.RecordBatch.from_arrays([pa.array(sigs)], names=["sig"])]) for r in b.to_pylist()]
    assert [r["sig"] for r in rows] == sigs
    assert len(made) == 2 + 1 + 1 + 1 + 2  # ua; x, o and a before it; u and s before that
