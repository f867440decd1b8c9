"""Linear-chain conditional random fields over dense feature rows, in numpy.

Sequences lie one after the other in one matrix; ``lengths`` says how long each is.
All sequences advance together, one position at a time, so the cost of a batch
follows its rows, not its longest sequence times its sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """Label scores per feature, between neighbouring labels, and for the first label."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.emit


def with_neighbours(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row with the rows before and after it in its sequence (zeros at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        before[1:], after[:-1] = x[:-1], x[1:]
        ends = np.cumsum(lengths[lengths > 0])
        before[ends - lengths[lengths > 0]] = 0
        after[ends - 1] = 0
    return np.hstack([x, before, after])


def _steps(lengths: np.ndarray):
    """Row numbers of all sequences' t-th positions, for t = 0, 1, ..."""
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        yield starts[: np.searchsorted(-sizes, -t, side="left")] + t


def forward_backward(chain: Chain, scores: np.ndarray, lengths: np.ndarray):
    """Log forward and backward sums per row and label, and log Z per row."""
    alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
    steps = list(_steps(lengths))
    for t, rows in enumerate(steps):
        if t:
            last = np.logaddexp.reduce(alpha[rows - 1][:, :, None] + chain.move, axis=1)
            alpha[rows] = scores[rows] + last
        else:
            alpha[rows] = scores[rows] + chain.first
    for rows in reversed(steps[1:]):
        ahead = (scores[rows] + beta[rows])[:, None, :] + chain.move
        beta[rows - 1] = np.logaddexp.reduce(ahead, axis=2)
    total = np.logaddexp.reduce(alpha + beta, axis=1)
    return alpha, beta, total


def marginals(chain: Chain, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    alpha, beta, total = forward_backward(chain, scores, lengths)
    return np.exp(alpha + beta - total[:, None])


def viterbi(chain: Chain, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of every row; ties go to the smaller label."""
    best, back = np.zeros_like(scores), np.zeros(scores.shape, dtype=np.int64)
    steps = list(_steps(lengths))
    for t, rows in enumerate(steps):
        if t:
            ways = best[rows - 1][:, :, None] + chain.move
            back[rows] = ways.argmax(axis=1)
            best[rows] = scores[rows] + ways.max(axis=1)
        else:
            best[rows] = scores[rows] + chain.first
    labels = best.argmax(axis=1)
    for rows in reversed(steps[1:]):
        labels[rows - 1] = back[rows, labels[rows]]
    return labels


def fit(
    x: np.ndarray,
    y: np.ndarray,
    lengths: np.ndarray,
    n_labels: int = 2,
    rounds: int = 150,
    rate: float = 0.1,
    ridge: float = 1e-4,
    start: Chain | None = None,
) -> Chain:
    """Maximum likelihood with a ridge, by Adam over all rows at once."""
    parts = [start.emit, start.move, start.first] if start else [
        np.zeros((x.shape[1], n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    ]
    parts = [p.copy() for p in parts]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    lengths = lengths[lengths > 0]
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(x), dtype=bool)
    inner[firsts] = False
    inner = np.flatnonzero(inner)
    seen = np.eye(n_labels)[y]
    seen_moves = np.zeros((n_labels, n_labels))
    np.add.at(seen_moves, (y[inner - 1], y[inner]), 1)
    for k in range(1, rounds + 1):
        chain = Chain(*parts)
        scores = chain.scores(x)
        alpha, beta, total = forward_backward(chain, scores, lengths)
        expected = np.exp(alpha + beta - total[:, None])
        pairs = (
            alpha[inner - 1][:, :, None]
            + chain.move
            + (scores[inner] + beta[inner])[:, None, :]
            - total[inner][:, None, None]
        )
        grads = [
            x.T @ (expected - seen) / len(x) + ridge * parts[0],
            (np.exp(pairs).sum(axis=0) - seen_moves) / len(x) + ridge * parts[1],
            (expected[firsts] - seen[firsts]).sum(axis=0) / len(x) + ridge * parts[2],
        ]
        for p, g, (m, v) in zip(parts, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Chain(*parts)
