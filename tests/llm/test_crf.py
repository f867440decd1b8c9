from itertools import product

import numpy as np

from tickweave.llm.crf import Chain, fit, forward_backward, marginals, viterbi, with_neighbours


def brute(chain, scores):
    n, labels = scores.shape
    paths = list(product(range(labels), repeat=n))
    worth = [
        chain.first[p[0]] + sum(scores[k, p[k]] for k in range(n)) + sum(chain.move[a, b] for a, b in zip(p, p[1:]))
        for p in paths
    ]
    z = np.logaddexp.reduce(worth)
    share = np.zeros((n, labels))
    for p, w in zip(paths, worth):
        for k in range(n):
            share[k, p[k]] += np.exp(w - z)
    return z, share, paths[int(np.argmax(worth))]


def test_sums_marginals_and_best_paths_match_all_paths():
    rng = np.random.default_rng(1)
    for labels in (2, 3):
        chain = Chain(rng.normal(size=(4, labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels))
        lengths = np.array([3, 1, 6, 2, 6])
        x = rng.normal(size=(lengths.sum(), 4))
        scores = chain.scores(x)
        total = forward_backward(chain, scores, lengths)[2]
        share, best = marginals(chain, scores, lengths), viterbi(chain, scores, lengths)
        at = 0
        for n in lengths:
            z, want, path = brute(chain, scores[at : at + n])
            assert np.allclose(total[at : at + n], z) and np.allclose(share[at : at + n], want)
            assert tuple(best[at : at + n]) == path
            at += n


def test_neighbours_stop_at_the_ends():
    x = np.arange(1.0, 6).reshape(5, 1)
    got = with_neighbours(x, np.array([2, 0, 3]))
    assert got.tolist() == [[1, 0, 2], [2, 1, 0], [3, 0, 4], [4, 3, 5], [5, 4, 0]]
    assert with_neighbours(np.zeros((0, 2)), np.array([], dtype=int)).shape == (0, 6)


def test_fit_learns_labels_and_moves():
    rng = np.random.default_rng(2)
    y, lengths = [], []
    for _ in range(200):
        n = int(rng.integers(2, 9))
        label = int(rng.integers(0, 2))
        for _ in range(n):
            y.append(label)
            label = label if rng.random() < 0.9 else 1 - label
        lengths.append(n)
    y, lengths = np.array(y), np.array(lengths)
    x = np.stack([np.ones(len(y)), y + rng.normal(scale=1.0, size=len(y))], axis=1)
    chain = fit(x, y, lengths)
    alone = ((x[:, 1] > 0.5) == y).mean()
    chained = (viterbi(chain, chain.scores(x), lengths) == y).mean()
    assert chained > alone + 0.05 and chain.move[0, 0] > chain.move[0, 1]
