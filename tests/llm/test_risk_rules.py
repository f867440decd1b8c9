import math
import random
from collections import Counter
from math import comb

import numpy as np

from tickweave.llm.risk_rules import (
    RULES, SHARES, binomial_tail, fit_cutoffs, judge, measured, n_testable, safe_cutoff, text_stats, tightening_path,
)
from tickweave.session import stage


def brute_stats(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, dup, len(covered))


def test_stats_match_plain_code():
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "x\x1cy é z\n\n \nx\n \n", "a a a a", "l\r\nl\r\nl"]
    for _ in range(300):
        texts.append("".join(rng.choice("ab é#|\n \t\x85&") for _ in range(rng.randint(0, 60))))
    texts.append("w1 w2 w3 " * 30_000)
    for text in texts:
        assert text_stats(text) == brute_stats(text), repr(text)[:80]


def test_binomial_tail_is_exact():
    for n in (1, 5, 60, 400):
        for p in (0.001, 0.0125, 0.3, 0.9):
            for k in {0, 1, n // 3, n - 1, n}:
                want = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
                assert abs(binomial_tail(k, n, p) - want) < 1e-9
    assert 0 < binomial_tail(12_000, 1_000_000, 0.0125) < 1e-5


def test_cutoffs_stop_at_the_first_unsafe_one_and_take_the_most_lenient():
    cuts = (0.9, 0.5, 0.2, 0.1)
    assert safe_cutoff([1000, 0, 0, 0, 0], [5, 0, 7, 0, 0], cuts, 0.05, 0.01) == 0.2
    assert safe_cutoff([1000, 0, 0, 0, 0], [5, 0, 7, 0, 2], cuts, 0.05, 0.01) == 0.2
    assert safe_cutoff([1000, 0, 0, 0, 0], [12, 0, 0, 0, 0], cuts, 0.05, 0.01) is None
    assert safe_cutoff([900, 100, 0, 0, 0], [0, 9, 2, 0, 0], cuts, 0.05, 0.01) == 0.2
    assert safe_cutoff([990, 4, 0, 0, 0], [0, 11, 2, 0, 0], cuts, 0.05, 0.01) == 0.2
    assert safe_cutoff([900, 0, 0, 0, 100], [0, 0, 9, 0, 0], cuts, 0.05, 0.01) is None
    assert safe_cutoff([0] * 5, [0, 0, 0, 0, 9], cuts, 0.05, 0.01) is None
    assert safe_cutoff([20, 0, 0, 0, 0], [0, 0, 0, 0, 9], cuts, 0.05, 0.01) is None


def test_false_rejections_stay_below_the_limit(spark):
    rng = random.Random(4)

    def doc(bad):
        words = [f"w{rng.randrange(10_000)}" for _ in range(80)]
        return " ".join(w + ("###" if bad and rng.random() < 0.7 else "") for w in words)

    rows = [(k, doc(k % 4 == 0), "en" if k % 2 else None) for k in range(4000)]
    labels = [(k, 0 if k % 4 == 0 else 1) for k in range(0, 3600)] + [(1, None), (5, 1)]
    docs = spark.createDataFrame(rows + [(9000, None, "de"), (9001, doc(True), "xx")], "doc_id long, text string, lang string")
    stats = measured(docs)
    cuts = stage(fit_cutoffs(stats, spark.createDataFrame(labels, "doc_id long, quality int")))
    found = {r.stratum: r for r in cuts.collect()}
    assert found[None].symbols in SHARES and found["en"].symbols is None
    got = {r.id: r for r in judge(stats, cuts).collect()}
    assert got[9000].base_failed and not got[9000].kept and got[9001].kept
    good = [k for k in range(4000) if k % 4]
    assert sum(not got[k].kept for k in good) <= 0.05 * len(good)
    assert sum(got[k].kept for k in range(0, 4000, 4)) < 50
    none = judge(stats, fit_cutoffs(stats, spark.createDataFrame([], "doc_id long, quality int")))
    assert all(r.kept != r.base_failed for r in none.collect())
    assert judge(stats.limit(0), cuts).count() == 0
    assert set(cuts.columns) == {"stratum", *RULES}


def test_path_takes_gaining_cutoffs_that_lose_least_first():
    # Rows: bad, good documents by how many of three cutoffs they exceed (3: the lenient one already).
    one = np.array([[10, 0, 4, 3], [50, 9, 1, 0]])
    two = np.array([[10, 2, 0, 5], [60, 0, 0, 0]])
    path = tightening_path({"one": one, "two": two})
    assert path == [
        {"one": 1, "two": 0}, {"one": 1, "two": 1}, {"one": 1, "two": 3}, {"one": 2, "two": 3},
    ]
    assert tightening_path({"one": np.array([[9, 0], [0, 9]])}) == []


def test_level_is_divided_among_strata_that_can_refute(spark):
    def divisor(sizes, limit=0.05, level=0.05):
        rows = [(str(k), 1, None, n) for k, n in enumerate(sizes)] + [("0", 0, 2, 10_000)]
        return n_testable(spark.createDataFrame(rows, "of string, label int, step int, n long"), limit, level)

    def brute(sizes, limit=0.05, level=0.05):
        return next(d for d in range(1, 1000) if sum((1 - limit) ** n <= level / d for n in sizes) <= d)

    for sizes in ([0], [20, 30], [149, 31, 25, 23], [75, 75, 75, 75], [60] * 9, [400] * 30 + [10] * 500, [59, 73, 81]):
        assert divisor(sizes) == brute(sizes), sizes


def test_cutoffs_match_plain_code_and_small_strata_get_one(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        bad = rng.random() < 0.2
        words = [f"w{rng.randrange(9_000)}" + ("##" if bad and rng.random() < 0.6 else "") for _ in range(70)]
        rows.append((k, " ".join(words), "en" if k < 300 else "de" if k < 330 else None))
        labels.append((k, int(not bad)))
    docs = spark.createDataFrame([*rows, rows[0], (5, "another text " * 40, "aa")], "doc_id long, text string, lang string")
    stats = stage(measured(docs))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r.stratum: r.asDict() for r in fit_cutoffs(stats, labelled).collect()}
    assert found == {r.stratum: r.asDict() for r in fit_cutoffs(stats.repartition(7), labelled).collect()}
    # 300 labelled documents bear a cutoff, 30 do not.
    assert found["en"]["symbols"] and found[None]["symbols"] and found["de"]["symbols"] is None

    thirds = {r.id: r.t for r in spark.sql("select id, pmod(xxhash64('path', id), 3) t from range(900)").collect()}
    quality = dict(labels)
    measure = {}
    for row in sorted(stats.collect(), key=lambda r: (r.stratum is not None, r.stratum, tuple(r)), reverse=True):
        if row.n_words >= 50 and 2 * row.n_repeat_words <= row.n_words:
            share = [row.n_symbols / row.word_chars, row.n_dup_lines / row.n_lines, row.n_repeat_words / row.n_words]
            measure[row.id] = (row.stratum, dict(zip(RULES, [*share, row.word_chars / row.n_words])))
    for stratum in ("en", None):
        mine = {k: m for k, (s, m) in measure.items() if s == stratum}
        over = {k: {n: sum(m[n] > c for c in RULES[n][1]) for n in RULES} for k, m in mine.items()}
        tallies = {n: np.zeros((2, len(cuts) + 1), dtype=int) for n, (_, cuts) in RULES.items()}
        for k in mine:
            for n in RULES:
                tallies[n][quality[k], over[k][n]] += thirds[k] == 0
        best, most = {n: None for n in RULES}, 0
        for step in tightening_path(tallies):
            cuts = {n: RULES[n][1][p - 1] if p else math.inf for n, p in step.items()}
            lost = [quality[k] for k in mine if thirds[k] and any(mine[k][n] > cuts[n] for n in RULES)]
            n_good = sum(quality[k] for k in mine if thirds[k])
            if binomial_tail(sum(lost), n_good, 0.05) > 0.05 / 2:
                break
            if len(lost) - 4 * sum(lost) > most:
                best, most = {n: None if c == math.inf else c for n, c in cuts.items()}, len(lost) - 4 * sum(lost)
        assert {n: found[stratum][n] for n in RULES} == best


def test_the_bound_holds_over_many_draws():
    """Fixed sequence on one half of the path: few of many draws lose more than the limit."""
    rng = np.random.default_rng(3)
    n, limit, level, broken = 400, 0.05, 0.05, 0
    chances = np.cumsum(np.full(10, 0.012))  # true rejection of good documents by step: 1.2% to 12%
    for _ in range(400):
        first = np.searchsorted(chances, rng.random(n)) + 1
        good = [0] * 11
        for f in first:
            good[max(0, 11 - f)] += 1
        step = safe_cutoff(good, [0] + [50] * 10, tuple(range(10)), limit, level)
        broken += step is not None and chances[step] > limit
    assert broken <= 400 * level + 3 * math.sqrt(400 * level)
