import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickweave.llm import maxent_lm as lm


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def make_rows():
    rng = np.random.default_rng(1)
    english = "the of and house tree runs green bird sings over hill with a".split()
    german = "der und die haus baum rennt grün vogel singt über berg mit ein".split()
    rows = []
    for k in range(600):
        words = english if k % 2 else german
        text = " ".join(rng.choice(words, rng.integers(3, 40))) + f" Rare{k % 90} X{k}\n"
        rows.append((k, text))
    return rows + [(600, None), (601, ""), (602, " \t"), (603, "zz " * 30_000), (5, rows[5][1]), (None, "the hill")]


@pytest.mark.parametrize("head", [10, 65_536])
def test_counts_and_base_match_plain_code(spark, monkeypatch, head):
    monkeypatch.setattr(lm.head_threshold, "__defaults__", (head,))
    rows = make_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learns = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 != 1
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    scored, counts = lm.score_texts(docs, ~held)
    found = scored.collect()
    seen, n_texts = Counter(), 0
    for d, t in rows:
        if learns(d):
            seen.update(tokens_of(t))
            n_texts += 1
    total, kinds = sum(seen.values()) + n_texts, len(seen) + 1
    assert (counts.n_tokens, counts.n_distinct) == (total, kinds)
    assert sum(counts.class_tokens) == total and sum(counts.class_distinct) == kinds
    for k in range(lm.OWN + 1, lm.CLASSES):
        mine = [w for w in seen if lm.ending_class(w.encode()) == k and w.encode() not in counts.own]
        assert counts.class_tokens[k] == sum(seen[w] for w in mine) and counts.class_distinct[k] == len(mine)
    want = []
    for d, t in rows:
        words = tokens_of(t)
        base = sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        base += math.log10((n_texts + 0.5) / (total + 0.5 * (kinds + 1)))
        want.append((d, len(words) + 1, sum(seen[w] > 0 for w in words) + 1, base))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for a, b in zip(sorted(want, key=key), sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in found), key=key)):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 * max(1, abs(a[3]))
    held_out = [r for r in found if not learns(r.doc_id)]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out) + 20
    assert all(r.score <= 0 for r in found)


def test_class_shares_sum_to_one_and_sums_of_runs():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    codes = lm.Codes((b"the",))
    block, sizes = next(lm._blocks(iter([[b"the", b"x", b"yy"], [], [b"the"] * 5]), codes))
    places = lm._places(sizes)
    assert sizes.tolist() == [4, 1, 6] and (block[places[[3, 4, 10]]] % lm.CLASSES == lm.END).all()
    shares = lm._shares(weights, lm._features(block // lm.CLASSES, places))
    assert np.allclose(shares.sum(axis=1), 1, atol=1e-5)
    values = rng.normal(size=(100, 4))
    starts = np.array([0, 1, 3, 40, 60, 99])
    assert np.allclose(lm._group_sums(values, starts), np.add.reduceat(values, starts, axis=0))


def test_no_texts_and_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    scored, counts = lm.score_texts(docs, F.lit(False))
    got = {r.doc_id: r for r in scored.collect()}
    assert counts.n_tokens == 0 and got[1].n_known == 0 and got[1].n_tokens == 4
    assert abs(got[1].base_score) < 1e-9 and got[2].n_tokens == 1
    assert lm.score_texts(docs.limit(0), F.lit(True))[0].count() == 0


def test_words_of_a_class_depend_on_what_precedes_them():
    rng = np.random.default_rng(3)
    pairs = {b"left": b"w0", b"right": b"w1"}
    place = lambda w: (lm.ending_class(w), zlib.crc32(w) >> lm.LEAF_SHIFT & lm.LEAVES - 1)
    mates = [b"x%dend" % k for k in range(2)]  # one class, two leaves
    assert place(mates[0])[0] == place(mates[1])[0] and place(mates[0])[1] != place(mates[1])[1]
    pairs = dict(zip(pairs, mates))
    texts = [[w for s in rng.choice([b"left", b"right"], 20).tolist() for w in (s, pairs[s])] for _ in range(200)]
    weights = np.zeros((lm.ALL_ROWS, lm.CLASSES), dtype=np.float32)
    codes, leaf_log = lm.Codes((b"left", b"right")), np.zeros((lm.CLASSES, lm.LEAVES))
    for block, sizes in lm._blocks(iter(texts), codes):
        for _ in range(4):
            lm.train_block(weights, np.zeros_like(weights), block, sizes, 0.3)

    def score(words):
        return lm.class_logs(weights, *next(lm._blocks(iter([words]), codes)), leaf_log)[0]

    assert score([b"left", mates[0]]) > score([b"left", mates[1]]) + 0.5
    assert score([b"right", mates[1]]) > score([b"right", mates[0]]) + 0.5


def test_branches_give_shares_that_sum_to_one():
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(lm.ALL_ROWS, lm.CLASSES)).astype(np.float32)
    block, sizes = next(lm._blocks(iter([[b"a", b"bb", b"cc", b"the"]]), lm.Codes((b"the",))))
    has, ways, rows = lm._branches(block // lm.CLASSES, block % lm.CLASSES, lm._places(sizes))
    assert has.tolist() == [0, 1, 2] and len(ways) == 6 and (ways < lm.WAYS).all()
    below = lm._branch_part(weights)
    assert np.shares_memory(below, weights) and all(r.max() < len(below) for r in rows)
    assert np.allclose(lm._shares(below, rows).sum(axis=1), 1, atol=1e-5)


ODD = [None, "", " \t\n", "\x0bThe the\x0cTHE\r\n", "a\x1cB \x85Z\u2003\u212a \x00x", "ÄÖ grün " * 40, "x" * 47 + " " + "y" * 48 + " " + "Z" * 49, "ü" * 9_000, " one two", "w"]


def plain_codes(texts, own):
    found = []
    for text in texts:
        words = [w.encode() for w in tokens_of(text)]
        classes = [own.index(w) if w in own else lm.ending_class(w) for w in words]
        found.append([lm.BOS * lm.CLASSES] * 2 + [zlib.crc32(w) * lm.CLASSES + c for w, c in zip(words, classes)])
        found[-1].append(lm.EOS * lm.CLASSES + lm.END)
    return found


@pytest.mark.parametrize("most", [1, 60, 8_000_000])
def test_codes_of_texts_match_plain_ones_and_blocks_end_with_a_text(most):
    texts, own = ODD * 3, (b"the", b"grun", "grün".encode())
    want = plain_codes(texts, own)
    pieces = list(lm._word_lists(pa.array(texts, pa.string()), most))
    assert sum(map(len, pieces)) == len(texts) and (most > 60) == (len(pieces) == 1)
    assert [[w.decode() for w in t] for p in pieces for t in p.to_pylist()] == [tokens_of(t) for t in texts]
    blocks = list(lm._blocks(iter(pieces), lm.Codes(own), 100))
    assert np.concatenate([c for c, _ in blocks]).tolist() == sum(want, [])
    assert np.concatenate([s for _, s in blocks]).tolist() == [len(t) - 2 for t in want]
    for code, sizes in blocks[:-1]:  # as few texts as have over 100 codes
        assert len(code) > 100 >= len(code) - sizes[-1] - 2
    assert not list(lm._word_lists(pa.array([], pa.string()))) and not list(lm._blocks(iter([]), lm.Codes(own)))


def test_a_word_is_coded_once_for_all_its_tokens(monkeypatch):
    asked, of = [], lm.Codes.of
    monkeypatch.setattr(lm.Codes, "of", lambda self, words: asked.append(len(words)) or of(self, words))
    texts = pa.array([" ".join(["b", "a", "the"] * 500)] * 40)
    blocks = list(lm._blocks(lm._word_lists(texts), lm.Codes((b"the",))))
    assert sum(len(code) for code, _ in blocks) == 40 * 1503 and asked == [3]


def test_sums_of_long_runs_are_added_in_order():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 500, 8, 9, 2, lm.TAIL - 1, lm.TAIL, lm.TAIL + 1, 1, 3])
    starts, order = np.cumsum(sizes) - sizes, rng.permutation(sizes.sum())
    values = rng.normal(size=(sizes.sum(), lm.WAYS)).astype(np.float32)
    found = lm._group_sums(values, starts, order)
    for at, size, got in zip(starts, sizes, found):
        run = values[order[at : at + size]]
        want = run[:8].sum(axis=0)  # rows one after another, those behind the eighth apart
        want = want + run[8:].sum(axis=0) if size > 8 else want
        assert (got == want).all()


def test_shares_of_what_was_taken_are_those_of_the_softmax():
    rng = np.random.default_rng(6)
    n = lm.CHUNK * 2 + 7
    weights = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    rows = [np.zeros(n, dtype=np.int64), *(rng.integers(f, f + size, n) for f, (size, _) in list(zip(lm.FIRST, lm.PARTS))[1:])]
    logits = sum(weights[r].astype(np.float64) for r in rows)
    want = np.exp(logits) / np.exp(logits).sum(axis=1)[:, None]
    taken = rng.integers(0, lm.CLASSES, n)
    assert np.allclose(lm._shares(weights, rows), want, rtol=1e-4)
    assert np.allclose(lm._shares_of(weights, rows, taken), want[np.arange(n), taken], rtol=1e-4)


def test_texts_without_words_are_scored(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    scored, counts = lm.score_texts(docs, F.lit(True))
    assert counts.n_tokens == 3 and [(r.n_tokens, r.n_known) for r in scored.collect()] == [(1, 1)] * 3
