"""Conversation repair against a plain search over edits, and its edge cases."""

import hashlib
import random
import re
import zlib

import pytest

from tickweave.llm import conversation_repair as cr

ROW = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if v is None else v for v in (role, text))
        case = zlib.crc32(key.encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def plain_repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # Forward search over written turns; audits are compared whole.
    paths = {"": {(0, "", ())}}

    def closure(paths):
        out = {s: set(v) for s, v in paths.items()}
        for _ in range(2):
            for state, ways in list(out.items()):
                role = "assistant" if state == "u" else "user"
                out.setdefault(role[0], set()).update((c + 5, a + "I", (*o, f"{role}:")) for c, a, o in list(ways))
        return out

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        extra = 5 if fault == "truncated" else 0
        for state, ways in closure(paths).items():
            for cost, audit, out in ways:
                after.setdefault(state, set()).add((cost + 2, audit + "D", out))
                if fault in ("blank", "duplicate"):
                    continue
                new = "assistant" if state == "u" else "user"
                after.setdefault(new[0], set()).add((cost + 1 + extra, audit + "R", (*out, f"{new}:{text}")))
                if role[:1] == new[0] or (role[:1] == "s" and state == ""):
                    after.setdefault(role[0], set()).add((cost + extra, audit + "K", (*out, f"{role}:{text}")))
        # Of equal cost only the least audit can lead to the least one from the same state.
        paths = {s: {min(w for w in ways if w[0] == c) for c in {x[0] for x in ways}} for s, ways in after.items()}
        paths = {s: {w for w in ways if w[0] <= min(x[0] for x in ways) + 10} for s, ways in paths.items()}
    ends = [w for s, ways in closure(paths).items() if s in ("", "a") for w in ways]
    cost, audit, out = min(ends, key=lambda w: w[:2])
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain(rows):
    damaged = plain_damage(rows)
    return {conv: plain_repair([r for r in damaged if r[0] == conv]) for conv in {r[0] for r in rows}}


def run(spark, rows, schema=ROW):
    names = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    got = cr.repair(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[n] for n in names) for r in got}


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Well.", "No", "Yes!", " ", "", "So it is?", "a\n", None, "Ünd. ", "x"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = []
    for conv in [*range(convs), None]:
        for k in range(rng.randint(1, most)):
            turn = rng.choice([k, k, k, k + 1, None])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    return rows


def test_random_conversations(spark):
    rows = random_rows(5, 150, 7)
    rows += rows[:40]  # repeated rows
    assert run(spark, rows) == plain(rows)


def test_segments_are_joined(spark, monkeypatch):
    rows = random_rows(6, 40, 8)
    want = plain(rows)
    monkeypatch.setattr(cr, "SEGMENT", 3)
    assert run(spark, rows) == want


def test_a_long_conversation_and_dropped_ones(spark):
    turns = ["user", "assistant"] * 150
    rows = [(1, k, role, f"Turn {k}.") for k, role in enumerate(turns)]
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "All of it is dropped."))
    got = run(spark, rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    damaged = plain_damage([r for r in rows if r[0] == 1])
    assert len(damaged) > 8 * cr.SEGMENT  # several rounds of joining
    assert got[1] == plain_repair(damaged)


def test_empty_table_and_clashing_names(spark):
    schema = ROW + ", place long, sign string, audit string, conv string, cost long"
    assert run(spark, [], schema) == {}
    rows = random_rows(7, 10, 5)
    wide = [(*r, 1, "x", "y", "z", 2) for r in rows]
    assert run(spark, wide, schema) == plain(rows)


def test_nodes_are_shared(spark):
    signs = ["ua", "uaua", "aua", "uaua", "sua"]
    nodes = cr.automaton(spark.createDataFrame([(s,) for s in signs], "signs string")).collect()
    assert sorted(r.suffix for r in nodes) == ["aua", "sua", "ua", "uaua"]
    best = {r.suffix: r.best for r in nodes}
    assert best["uaua"][0 * 4 + 3].audit == "KKKK" and best["sua"][0 * 4 + 3].cost == 0


@pytest.mark.parametrize("sign, audit", [("d", "D"), ("x", "D"), ("S", "D")])
def test_single_rows(sign, audit):
    best = cr.solve(sign, cr.EMPTY)
    ends = [(c[0] + cr.TO_END[t] * cr.INSERT, c[1] + "I" * cr.TO_END[t]) for t in range(4) if (c := best[t])]
    assert min(ends) == (2, audit)
