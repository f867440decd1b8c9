"""Quality rules with thresholds whose false rejections are bounded.

Each rule rejects a document when a measure of it is above a cutoff. Labelled documents
say which cutoffs are safe, all rules of a stratum together. A third of them, chosen by a
hash of the id, draws a path per stratum: from rejecting nothing on, each step tightens
one rule to its next cutoff that gains by itself (bad documents rejected less ``loss`` times
the good ones), that with the fewest good ones lost first, then in the order of ``RULES``. The other
two thirds test the path in this order: the hypothesis "more than ``limit`` of the
good documents is rejected by all rules together" must be refuted by the exact binomial
tail; testing stops at the first step that fails. Of the safe steps, the one with the
greatest gain is taken, the most lenient of equals. A path is a fixed sequence to the rows
that test it, so its steps need no correction among them; the error level is divided among
the strata (Bonferroni) that have enough good documents to refute anything. So with
probability 1 - ``level`` no stratum loses more than ``limit`` of its good documents. A
stratum without a safe step, or where nothing is gained, rejects nothing.

Defined results: a null text has no words and fails the base. A null stratum is a stratum
of its own. Labels that are null are ignored, and an id labelled twice counts with the
smaller label; an id with several texts counts with the least stratum and stats. Repeated
rows get equal verdicts. No labels: the base decides alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import broadcast_if_small, stage
from .common import col, words_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Measures of a document, each the worse the higher; per rule, cutoffs from lenient to strict.
SHARES = tuple(round(1.0 * 0.85**k, 6) for k in range(36))
RULES = {
    "symbols": ("try_divide(n_symbols, word_chars)", SHARES),
    "dup_lines": ("try_divide(n_dup_lines, n_lines)", SHARES),
    "repeats": ("try_divide(n_repeat_words, n_words)", SHARES),
    "long_words": ("try_divide(word_chars, n_words)", tuple(float(k) for k in range(40, 5, -1))),
}


def text_stats(text: str | None, width: int = 3) -> tuple[int, ...]:
    """The values of ``STATS`` for a whole text."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeated = 0
    if n > width:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
        windows = ids[: n - width + 1]
        for k in range(1, width):
            # Renumbered before each step, so that the product cannot run over.
            if len(known) > 1_000_000:
                windows = np.unique(windows, return_inverse=True)[1]
            windows = windows * len(known) + ids[k : n - width + 1 + k]
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse] > 1)
        covered = np.zeros(n, dtype=bool)
        for k in range(width):
            covered[starts + k] = True
        repeated = int(covered.sum())
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
    )


def stats_of(text: Column) -> Column:
    """A struct of ``STATS``."""

    @F.pandas_udf(StructType([StructField(s, LongType()) for s in STATS]))
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = [text_stats(t if isinstance(t, str) else None) for t in texts]
            yield pd.DataFrame(rows, columns=list(STATS), dtype="int64")

    return of(text)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most ``k`` of ``n``) at rate ``p``, exactly, for any ``n``.

    The tail is the regularised incomplete beta function I(1 - p; n - k, k + 1), taken
    by its continued fraction on the side where that converges fast.
    """
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(b, a, 1 - x)
    return _beta_part(a, b, x)


def _beta_part(a: float, b: float, x: float) -> float:
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 100_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def safe_cutoff(
    good: list[int], bad: list[int], cutoffs: tuple[float, ...], limit: float, level: float, loss: int = 3
) -> float | None:
    """The cutoff of one rule in one stratum; None if it should reject nothing.

    ``good`` and ``bad`` count documents by how many cutoffs their measure exceeds.
    """
    n, chosen, most = sum(good), None, 0
    for k, cutoff in enumerate(cutoffs):
        over = len(cutoffs) - k  # who exceeds this cutoff exceeds all stricter ones
        if n == 0 or binomial_tail(sum(good[over:]), n, limit) > level:
            break
        if (gain := sum(bad[over:]) - loss * sum(good[over:])) > most:
            chosen, most = cutoff, gain
    return chosen


def tightening_path(tallies: dict[str, np.ndarray], loss: int = 3) -> list[dict[str, int]]:
    """Steps from rejecting nothing on; each says how many cutoffs of every rule are in force.

    ``tallies`` has per rule a row of good and a row of bad documents (label 1, 0) by how
    many cutoffs their measure exceeds.
    """
    state, path = {name: 0 for name in tallies}, []
    while True:
        moves = []
        for name, tally in tallies.items():
            # Of the documents that each further cutoff rejects, those before included.
            bad, good = tally[:, ::-1][:, state[name] : -1].cumsum(axis=1)
            gaining = np.flatnonzero(bad > loss * good)
            if len(gaining):
                moves.append((int(good[gaining[0]]), name, state[name] + int(gaining[0]) + 1))
        if not moves:
            return path
        _, name, place = min(moves, key=lambda m: m[0])  # the first of equals
        state = {**state, name: place}
        path.append(state)


def fit_cutoffs(
    stats: DataFrame, labels: DataFrame, limit: float = 0.05, level: float = 0.05, key: str = "doc_id",
    label: str = "quality", loss: int = 3,
) -> DataFrame:
    """One row per stratum with labels: stratum, and a cutoff per rule (null: no rejection).

    ``stats`` has ``id``, ``stratum`` and ``STATS``. Documents are counted in Spark; a
    stratum's path and its test are worked out in a task from counts, of which there are
    rules x cutoffs for the path and as many steps for the test.
    """

    def n_over(measure: Column, cuts: tuple[float, ...]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: measure > c))

    known = labels.where(col(label).isin(0, 1)).groupBy(col(key).alias("id")).agg(F.min(col(label)).alias("label"))
    once = stats.where(~base_failed()).groupBy("id").agg(F.min(F.struct("stratum", *STATS)).alias("s"))
    labelled = once.join(known, "id").select(
        F.pmod(F.xxhash64(F.lit("path"), F.col("id")), F.lit(3)).alias("third"), "s.*", "label"
    )
    rows = stage(
        labelled.select(
            (F.col("third") == 0).alias("draws"), "stratum", "label",
            *(n_over(F.expr(measure), cuts).alias(name) for name, (measure, cuts) in RULES.items()),
        )
    )
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_over")) for n in RULES))).alias("x")
    drawn = rows.select("stratum", F.when(F.col("draws"), F.col("label")).alias("label"), each)
    counts = drawn.groupBy("stratum", "x.rule", "x.n_over", "label").count()

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        tallies = {}
        for name, (_, cuts) in RULES.items():
            tallies[name] = np.zeros((2, len(cuts) + 1), dtype=np.int64)
            mine = part[(part["rule"] == name) & part["label"].notna()]
            np.add.at(tallies[name], (mine["label"].astype(int), mine["n_over"]), mine["count"])
        path = tightening_path(tallies, loss)
        found = {"stratum": part["stratum"].iloc[0], "n_steps": len(path)}
        for name, (_, cuts) in RULES.items():
            in_force = [0] + [step[name] for step in path]
            # The first step that rejects a document over j of the cutoffs: it exceeds the last j.
            first = np.searchsorted(in_force, len(cuts) - np.arange(len(cuts) + 1), side="right")
            found[f"at_{name}"] = [int(k) if k <= len(path) else None for k in first]
            found[f"cuts_{name}"] = [cuts[k - 1] if k else None for k in in_force[1:]]
        return pd.DataFrame([found])

    schema = "stratum string, n_steps int" + "".join(f", at_{n} array<int>, cuts_{n} array<double>" for n in RULES)
    paths = stage(counts.groupBy("stratum").applyInPandas(draw, schema))

    tested = rows.where(~F.col("draws"))
    # Rows of one pattern are counted before they meet their path.
    tested = tested.groupBy("stratum", "label", *RULES).count().withColumnRenamed("stratum", "of")
    few = broadcast_if_small(paths, 100_000, is_stored=True)
    met = tested.join(few, F.col("of").eqNullSafe(F.col("stratum")))
    step = F.least(*(F.get(f"at_{n}", F.col(n)) for n in RULES))
    tallies = stage(met.groupBy("of", "label", step.alias("step")).agg(F.sum("count").alias("n")))
    share = level / n_testable(tallies, limit, level)

    def test(part: pd.DataFrame) -> pd.DataFrame:
        n_steps = int(part["n_steps"].iloc[0])
        # By how many steps of the path reject a document: those from its first one on.
        found = {1: [0] * (n_steps + 1), 0: [0] * (n_steps + 1)}
        for row in part[part["label"].notna()].itertuples():
            found[int(row.label)][0 if pd.isna(row.step) else n_steps + 1 - int(row.step)] += int(row.n)
        chosen = safe_cutoff(found[1], found[0], tuple(range(n_steps)), limit, share, loss)
        cutoffs = {n: None if chosen is None else part[f"cuts_{n}"].iloc[0][chosen] for n in RULES}
        return pd.DataFrame([{"stratum": part["stratum"].iloc[0], **cutoffs}])

    told = paths.select("stratum", "n_steps", *(f"cuts_{n}" for n in RULES))
    joined = told.join(tallies, F.col("of").eqNullSafe(F.col("stratum")), "left").drop("of")
    schema = "stratum string, " + ", ".join(f"{name} double" for name in RULES)
    return joined.groupBy("stratum").applyInPandas(test, schema)


def n_testable(tallies: DataFrame, limit: float, level: float) -> int:
    """The least number among which ``level`` can be divided so that no more strata can refute anything.

    A stratum with n good documents refutes at its share of the level only if (1 - limit)^n
    is no greater. Sizes alone decide, so this is no choice by results.
    """
    good = tallies.groupBy("of").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n"))
    # The log of the greatest divisor; sizes that bear more strata than there can be count as one.
    rate = -math.log1p(-limit)
    most = F.lit(math.log(level)) + F.least(F.col("n"), F.lit(math.ceil(50 / rate))) * F.lit(rate)
    sizes = good.groupBy(most.alias("most")).count().orderBy("most").collect()
    divisor = 1
    for k, size in enumerate(sizes):
        able = sum(r["count"] for r in sizes[k:])
        if max(able, divisor) <= math.exp(size.most):
            return max(able, divisor)
        divisor = math.floor(math.exp(size.most)) + 1
    return divisor


def judge(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``stats`` with ``base_failed`` and ``kept``."""
    cuts = broadcast_if_small(cutoffs.withColumnRenamed("stratum", "of"), 100_000)
    over = [F.coalesce(F.expr(measure) > F.col(name), F.lit(False)) for name, (measure, _) in RULES.items()]
    rejected = over[0]
    for one in over[1:]:
        rejected = rejected | one
    joined = stats.join(cuts, F.col("stratum").eqNullSafe(F.col("of")), "left")
    return joined.select(
        *stats.columns, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept")
    )


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """id, stratum and ``STATS`` of every row, stored."""
    found = docs.select(col(key).alias("id"), col(stratum).cast("string").alias("stratum"), stats_of(col(text)).alias("s"))
    return stage(found.select("id", "stratum", "s.*"))
