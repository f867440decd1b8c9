"""Document quality from a conditional random field over lines.

A linear chain labels every line good or bad from its own features and those of the
lines beside it. The marginals of "bad", weighted by the length of the lines, give a
document's share of bad text, and a logistic curve on its log-odds gives the score.

The chain is fitted on a bounded sample of labelled documents: ``max_docs``, chosen by
a hash of the id, all their lines. Labels belong to documents; lines of bad documents
that look good to a first fit are relabelled before the second. Scoring reads whole texts.

Defined results: null and empty texts are one empty line; they get a score like any
other text. Labels that are null are ignored; an id labelled twice counts as labelled by
the smaller label. With no labelled document, or with one class only, every score is that
class's share among the labels, 0.5 without any. Repeated rows get equal scores.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import col, fresh, hash_sample, without
from .crf import Chain, fit, marginals, with_neighbours

#: Fixed characters that junk text is full of, as the rules of this library count them.
SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
MARKS = ".,;:?!"
_TAIL = re.compile(r"[#*$%&!?]{2,}(?!\S)")
_STEPS = (0.02, 0.1, 0.3, 0.6)
BAD = 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A feature row and a weight (its length) per line of the whole text."""
    lines = (text or "").split("\n")
    seen: set[str] = set()
    rows, weights = [], []
    for line in lines:
        n, words = len(line), line.split()
        k = max(1, len(words))
        shares = (
            sum(map(line.count, SYMBOLS)) / max(1, n),
            sum(map(line.count, DIGITS)) / max(1, n),
            sum(map(line.count, MARKS)) / max(1, n),
            sum(map(str.isupper, words)) / k,
            len(_TAIL.findall(line)) / k,
            1 - len(set(words)) / k if words else 0.0,
            sum(map(eq, words, words[1:])) / k,
            words.count("|") / k,
        )
        end = line.rstrip()[-1:]
        rows.append(
            (
                *shares,
                np.log1p(n) / 8,
                np.log1p(len(words)) / 6,
                min(4.0, n / k / 10),
                not words,
                len(words) <= 2,
                end in (".", "!", "?") and bool(end),
                line[:1].islower(),
                bool(words) and line in seen,
            )
        )
        weights.append(n)
        seen.add(line)
    x = np.array(rows, dtype=np.float64)
    steps = [(x[:, :8] > s).astype(np.float64) for s in _STEPS]
    return np.hstack([np.ones((len(x), 1)), x, *steps]), np.array(weights, dtype=np.float64)


@dataclass(frozen=True)
class QualityModel:
    chain: Chain | None
    slope: float
    offset: float

    def bad_shares(self, texts: list[str | None]) -> np.ndarray:
        """Share of bad text per document; documents go through in bounded blocks."""
        out, block, held = [], [], 0
        for text in texts:
            block.append(line_features(text))
            held += len(block[-1][1])
            if held > 10_000:
                out.append(_shares(self.chain, block))
                block, held = [], 0
        if block:
            out.append(_shares(self.chain, block))
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.chain is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.offset)))
        return 1 / (1 + np.exp(-(self.offset + self.slope * _log_odds(self.bad_shares(texts)))))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def _shares(chain: Chain, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    lengths = np.array([len(w) for _, w in docs])
    x = with_neighbours(np.vstack([x for x, _ in docs]), lengths)
    bad = marginals(chain, chain.scores(x), lengths)[:, BAD]
    weights = np.concatenate([w if w.sum() else np.ones(len(w)) for _, w in docs])
    starts = np.cumsum(lengths) - lengths
    return np.add.reduceat(bad * weights, starts) / np.add.reduceat(weights, starts)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a small ridge."""
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, design.T @ (p - y) + 1e-3 * w)
    return float(w[0]), float(w[1])


def fit_quality(rows: list[tuple[bytes, int]], seed: int = 1) -> QualityModel:
    """Fit on (packed line features, label 0 or 1) of whole documents."""
    labels = np.array([label for _, label in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return QualityModel(None, 0.0, float(np.log(share / (1 - share))))
    docs = [pickle.loads(packed) for packed, _ in rows]
    lengths = np.array([len(w) for _, w in docs])
    x = with_neighbours(np.vstack([x for x, _ in docs]), lengths)
    y = np.repeat(1 - labels, lengths)
    # Chains of at most 64 lines: the same rows, and fewer steps one after the other.
    pieces = np.concatenate([np.diff(np.r_[np.arange(0, n, 64), n]) for n in lengths])
    chain = fit(x, y, pieces, rounds=80)
    bad = marginals(chain, chain.scores(x), lengths)[:, BAD]
    starts = np.cumsum(lengths) - lengths
    worst = np.repeat(np.maximum.reduceat(bad, starts), lengths)
    y = y * ((bad >= 0.5) | (bad >= worst))
    chain = fit(x, y, pieces, rounds=120, start=chain)
    slope, offset = _logistic(_log_odds(_shares(chain, docs)), labels.astype(float))
    return QualityModel(chain, slope, offset)


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    max_docs: int = 4_000,
) -> QualityModel:
    """Fit on at most ``max_docs`` labelled rows of ``docs`` for which ``may_learn`` holds.

    Features are made in the tasks; the driver fits the bounded sample.
    """
    known = (
        labels.where(col(label).isin(0, 1))
        .groupBy(col(key).alias("q_id"))
        .agg(F.min(col(label)).alias("q_label"))
    )
    ids = docs.where(may_learn).select(col(key).alias("q_id")).distinct()
    chosen = hash_sample(known.join(ids, "q_id"), F.col("q_id"), max_docs)

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([pickle.dumps(line_features(t.as_py())) for t in texts], pa.binary())

    # At most max_docs ids and labels: safe to broadcast.
    found = docs.where(may_learn).select(col(key).alias("q_id"), col(text).alias("q_text"))
    # An id given to several texts counts with its least text, whatever the order of the rows.
    found = found.join(F.broadcast(chosen), "q_id").groupBy("q_id", "q_label").agg(F.min("q_text").alias("q_text"))
    rows = found.select(packed("q_text").alias("f"), "q_label", "q_id").collect()
    return fit_quality([(bytes(r.f), r.q_label) for r in sorted(rows, key=lambda r: str(r.q_id))])


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1, higher: better) in the column ``out``, in place of one so named."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two small matrices

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(texts.to_pylist()), pa.float64())

    return without(docs, out).withColumn(out, score(col(text)))


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text", cutoff: float = 0.7) -> DataFrame:
    """The rows that score at least ``cutoff``, same columns."""
    (score,) = fresh(docs, "quality_score")
    good = with_quality(docs, model, text, score).where(F.col(score) >= cutoff)
    return good.select(*(col(c) for c in docs.columns))
