"""Cheapest repair of damaged conversations by a suffix-shared automaton.

Every row of a conversation becomes one sign of its role and first fault; a conversation's
signs in order are its signature, cut into segments of at most ``SEGMENT`` signs. Distinct
segments share their suffixes: an automaton node is one distinct suffix of any segment of
any conversation, and its only edge reads the first sign and leads to the node that is one
shorter. Nodes are solved level by level from the end, once for all conversations: for every
pair of grammar states the least cost and, among the cheapest edits, the ASCII-least audit.
Conversations look up the nodes of their whole segments; those with several segments join
neighbours pairwise, which takes as many rounds as the logarithm of the longest one.

Grammar states: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an
assistant turn. Joining segments keeps the ASCII-least audit: equally cheap audits of the
same rows between the same states never begin with one another, as the longer one would
hold more insertions at the same other edits.

Defined results: a null role or text counts as one space, a null turn sorts first and counts
as one space in the damage key. Rows of one conversation and turn are put in order of role,
then text. A null conversation id is a conversation of its own. A role that begins with
none of s, u, a (the empty one too) cannot be kept. Repeated rows are rows. An empty table
has no result rows. Further columns are not needed and not kept.

A conversation's rows are sorted in one task, which spills, and its repaired text is hashed
there as a stream of rows, since SHA-256 is a chain; nothing of it is held whole but the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import col

SEGMENT = 16
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
#: state -> (state after it, role) of the turn that may be written next.
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
#: Insertions that lead from one state to another before a row or at the end.
INSERTS = {0: ((0, 0), (2, 1), (3, 2)), 1: ((1, 0), (2, 1), (3, 2)), 2: ((2, 0), (3, 1)), 3: ((3, 0), (2, 1))}
#: Insertions that complete a conversation from each state.
TO_END = {0: 0, 1: 2, 2: 1, 3: 0}
PAIRS = [(s, t) for s in range(4) for t in range(4)]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, copy: the rows with planted faults, by the hash of conversation and turn."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(col(conv).cast("string"), space), F.lit(":"), F.coalesce(col(turn).cast("string"), space))
    plain = F.coalesce(col(text), space)
    case = F.crc32(key.cast("binary")) % 20
    new_text = F.when(case == 1, "").when(case == 2, F.regexp_replace(plain, "[.!?]", "")).otherwise(plain)
    new_role = F.when(case == 4, "user").otherwise(F.coalesce(col(role), space))
    copies = F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(case != 0).select(
        col(conv).alias("conv"), col(turn).cast("long").alias("turn"), new_role.alias("role"), new_text.alias("text"),
        F.explode(copies).alias("copy"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Rows of :func:`damaged` with place (from 0), first fault and sign, one shuffle on the conversation."""
    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    here = Window.partitionBy("conv").orderBy(*order)
    same = Window.partitionBy("conv", "role", "text").orderBy("place")
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    initial = F.substring("role", 1, 1)
    placed = rows.select(
        "*",
        (F.row_number().over(here) - 1).cast("long").alias("place"),
        F.lag(initial).over(here).alias("before"),
        F.lag("turn").over(here).alias("turn_before"),
    )
    found = placed.withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(last == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    sign = F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(kind)).otherwise(kind)
    pair = F.concat(F.col("before"), initial)
    return found.withColumn("fault", fault).select(
        "conv", "turn", "role", "text", "place", "fault", sign.alias("sign"),
        ((F.col("place") > 0) & ~pair.isin("su", "ua", "au")).alias("is_illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
    )


def solve(sign: str, child: list) -> list:
    """Best (cost, audit) for every pair of states over a suffix, from those of the suffix one shorter."""
    kind, extra = sign.lower(), TRUNCATED if sign.isupper() else 0
    best: list = [None] * len(PAIRS)

    def offer(start: int, inserts: int, cost: int, edit: str, state: int) -> None:
        for end in range(4):
            rest = child[state * 4 + end]
            if rest is not None:
                found = (inserts * INSERT + cost + rest[0], "I" * inserts + edit + rest[1])
                if best[start * 4 + end] is None or found < best[start * 4 + end]:
                    best[start * 4 + end] = found

    for start, reached in INSERTS.items():
        for state, inserts in reached:
            offer(start, inserts, DELETE, "D", state)
            if kind == "d":
                continue
            after, role = NEXT[state]
            offer(start, inserts, REROLE + extra, "R", after)
            if kind == role[0]:
                offer(start, inserts, KEEP + extra, "K", after)
            elif kind == "s" and state == 0:
                offer(start, inserts, KEEP + extra, "K", 1)
    return best


EMPTY = [(0, "") if s == t else None for s, t in PAIRS]
BEST = "array<struct<cost: bigint, audit: string>>"


BEST_ARROW = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _read(best: list | None) -> list:
    return EMPTY if best is None else [None if b is None else (b["cost"], b["audit"]) for b in best]


def _write(best: list) -> list:
    return [None if b is None else {"cost": b[0], "audit": b[1]} for b in best]


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(suffix, best of the shorter suffix) -> (suffix, best)."""
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        out = [_write(solve(suffix[0], _read(child))) for suffix, child in rows]
        yield pa.record_batch([batch.column(0), pa.array(out, BEST_ARROW)], ["suffix", "best"])


def automaton(segments: DataFrame) -> DataFrame:
    """suffix, best: the solved nodes that are whole segments, from ``segments`` (signs)."""
    distinct = stage(segments.select("signs").distinct())
    longest = distinct.agg(F.max(F.length("signs"))).first()[0] or 0  # at most SEGMENT
    solved, below = [], None
    for size in range(1, longest + 1):
        suffixes = distinct.where(F.length("signs") >= size).select(F.expr(f"right(signs, {size})").alias("suffix")).distinct()
        if below is None:
            nodes = suffixes.select("suffix", F.lit(None).cast(BEST).alias("best"))
        else:
            child = below.select(F.col("suffix").alias("child"), "best")
            nodes = suffixes.join(child, F.expr(f"right(suffix, {size - 1})") == F.col("child")).select("suffix", "best")
        below = stage(nodes.mapInArrow(_level, f"suffix string, best {BEST}"))
        solved.append(below.join(distinct.select(F.col("signs").alias("suffix")), "suffix", "left_semi"))
    if not solved:
        return distinct.select(F.col("signs").alias("suffix"), F.lit(None).cast(BEST).alias("best"))
    whole = solved[0]
    for nodes in solved[1:]:
        whole = whole.unionByName(nodes)
    return stage(whole)


def joined(first: list, second: list) -> list:
    """Best results over two neighbouring segments."""
    best = []
    for start, end in PAIRS:
        halves = [(first[start * 4 + k], second[k * 4 + end]) for k in range(4)]
        best.append(min(((a[0] + b[0], a[1] + b[1]) for a, b in halves if a and b), default=None))
    return best


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, segment, first, second) -> (conv, segment, best); a last segment may stand alone."""
    for batch in batches:
        rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        out = [_write(_read(a) if b is None else joined(_read(a), _read(b))) for a, b in rows]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, BEST_ARROW)], ["conv", "segment", "best"])


def folded(segments: DataFrame) -> DataFrame:
    """conv, best over all segments, from (conv, segment, best); neighbours join pairwise."""
    while True:
        most = segments.agg(F.max("segment")).first()[0]
        if not most:
            return segments.select("conv", "best")
        at = F.col("segment") % 2
        pairs = segments.groupBy("conv", F.floor(F.col("segment") / 2).cast("long").alias("half")).agg(
            F.max(F.when(at == 0, F.struct("segment", "best")))["best"].alias("first"),
            F.max(F.when(at == 1, F.struct("segment", "best")))["best"].alias("second"),
        )
        kind = segments.schema["conv"].dataType.simpleString()
        segments = stage(pairs.mapInArrow(_pairs, f"conv {kind}, segment long, best {BEST}"))


def finished(best: Column) -> Column:
    """The cheapest complete repair (cost, audit) from the empty start."""
    ways = [
        F.when(
            best[t].isNotNull(),
            F.struct((best[t]["cost"] + n * INSERT).alias("cost"), F.concat(best[t]["audit"], F.lit("I" * n)).alias("audit")),
        )
        for t, n in TO_END.items()
    ]
    return F.array_min(F.array(*ways))


def repaired_turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits of ``audit``; a role is asked for when its row's edit is due."""
    state = 0
    for edit in audit:
        if edit == "I":
            state, role = NEXT[state]
            yield role, ""
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = 1
        elif edit == "K":
            state = NEXT[state][0]
        else:
            state, role = NEXT[state]
        yield role, text


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, SHA-256 of the repaired turns. Rows come by conversation and place, the audit (place -1) first."""

    def rows():
        for batch in batches:
            yield from zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3)))

    stream = rows()
    ahead = next(stream, None)
    done: list = []

    def turns():
        nonlocal ahead
        while True:
            ahead = next(stream, None)
            if ahead is None or ahead[1] < 0:
                return
            yield ahead[2], ahead[3]

    def out() -> pa.RecordBatch:
        keys = pa.array([k.as_py() for k, _ in done], done[0][0].type)
        return pa.record_batch([keys, pa.array([h for _, h in done])], ["conv", "repaired_sha256"])

    while ahead is not None:
        key, audit = ahead[0], ahead[3]
        digest, left = hashlib.sha256(), turns()
        for k, (role, text) in enumerate(repaired_turns(audit, left)):
            digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
        for _ in left:
            pass  # moves on to the next conversation
        done.append((key, digest.hexdigest()))
        if len(done) >= 5000:
            yield out()
            done.clear()
    if done:
        yield out()


def hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, repaired_sha256 for (conv, place, role, text) and (conv, audit)."""
    heads = audits.select("conv", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv", "place", "role", "text").unionByName(heads)
    kind = both.schema["conv"].dataType.simpleString()
    sorted_rows = both.repartition("conv").sortWithinPartitions("conv", "place")
    return sorted_rows.mapInArrow(_hashes, f"conv {kind}, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``rows``: gaps, faults, cost, audit and hash of the repaired turns."""
    turns = stage(marked(damaged(rows, conv, turn, role, text)))
    named = {"gaps": F.when(F.count("turn") > 0, F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn")).otherwise(0)}
    named |= {f: F.count_if(F.col("fault") == f) for f in ("blank", "duplicate", "truncated")}
    named["illegal"] = F.count_if("is_illegal")
    counts = turns.groupBy("conv").agg(*(c.cast("long").alias(n) for n, c in named.items()))
    segments = stage(
        turns.groupBy("conv", F.floor(F.col("place") / SEGMENT).cast("long").alias("segment"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "sign"))).alias("found"))
        .select("conv", "segment", F.array_join(F.col("found")["sign"], "").alias("signs"))
    )
    nodes = automaton(segments)
    solved = stage(segments.join(nodes, segments["signs"] == nodes["suffix"]).select("conv", "segment", "best"))
    audits = stage(folded(solved).select("conv", finished(F.col("best")).alias("end")).select("conv", "end.cost", "end.audit"))
    same = lambda other: F.col("all_conv").eqNullSafe(other["conv"])
    results = audits.join(
        hashed(turns, audits).withColumnRenamed("conv", "hash_conv"), F.col("conv").eqNullSafe(F.col("hash_conv"))
    ).drop("hash_conv")
    everyone = rows.select(col(conv).alias("all_conv")).distinct()
    merged = everyone.join(counts, same(counts), "left").drop("conv")
    merged = merged.join(results, same(results), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return merged.select(
        F.col("all_conv").alias(conv),
        *(F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in (*named, "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
