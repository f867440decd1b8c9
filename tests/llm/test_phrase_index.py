"""Phrase and proximity search against plain scans of the texts."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tickweave.llm import phrase_index as pi
from tickweave.session import stage

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_windows(text, size):
    words = plain_words(text)
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def plain_result(docs, items, size=10):
    want = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, item_text in items:
            for w in plain_windows(item_text, size):
                for k in range(len(words) - len(w) + 1):
                    if tuple(words[k : k + len(w)]) == w:
                        hit |= set(range(k, k + len(w)))
                        found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return sorted(want, key=str)


def run(spark, docs, items, doc_schema=DOC, item_schema=ITEM, size=10):
    got = pi.contaminated(spark.createDataFrame(docs, doc_schema), spark.createDataFrame(items, item_schema), size=size)
    return sorted((tuple(r)[:6] for r in got.collect()), key=str)


def some_text(rng, n, words="the a cat dog Über ran 7 Far away then".split()):
    return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", ". "]) for _ in range(n))


def corpus(seed, n_docs=60):
    rng = random.Random(seed)
    items = [(k, some_text(rng, rng.choice([1, 2, 3, 5, 9]))) for k in range(12)]
    items += [(30, None), (31, "..."), (None, "cat dog cat"), (2, "the the the"), (2, "zebra never seen")]
    docs = [(k, some_text(rng, rng.randint(0, 60))) for k in range(n_docs)] + [(None, "cat dog cat"), (99, None), (98, "")]
    return docs + docs[:3], items + items[:2]


@pytest.mark.parametrize("size", [1, 3, 10])
def test_phrases_against_plain_scan(spark, monkeypatch, size):
    docs, items = corpus(size)
    whole = pi.build_index
    monkeypatch.setattr(pi, "build_index", lambda *a: whole(*a, block_words=50))
    assert run(spark, docs, items, size=size) == plain_result(docs, items, size)


def test_no_phrase_crosses_documents(spark):
    docs = [(1, "one two"), (2, "three four"), (3, "one two three four")]
    assert [r[2] for r in run(spark, docs, [(1, "one two three four")])] == [0, 0, 4]


def test_empty_tables_and_clashing_names(spark):
    docs, items = corpus(8, 10)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == plain_result(docs, [])
    wide = [(*d, 1, "x", [2], "y") for d in docs]
    schema = DOC + ", block long, term string, sizes array<long>, phrase string"
    assert run(spark, wide, [(*i, "z", "q") for i in items], schema, ITEM + ", item string, words string") == plain_result(docs, items)


def test_one_document_far_longer_than_a_block(spark):
    rng = random.Random(4)
    docs = [(1, some_text(rng, 30_000)), (2, "cat")]
    items = [(1, "the a cat dog über ran"), (2, "away then the cat")]
    index = stage(pi.build_index(spark.createDataFrame(docs, DOC), block_words=1000))
    phrases = stage(pi.windows(spark.createDataFrame(items, ITEM)))
    got = pi.hits_by_document(index, pi.phrase_matches(index, phrases)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in got) == [r[:3] for r in plain_result(docs, items)]


def plain_spans(words, query, width):
    """Least spans that hold all words of the query, repeats counted."""
    need, spans = Counter(query), []
    for first in range(len(words)):
        for last in range(first, min(first + width, len(words))):
            if not need - Counter(words[first : last + 1]):
                spans.append((first, last))
                break
    return [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]


@pytest.mark.parametrize("slop", [0, 2, 6])
def test_proximity_against_plain_scan(spark, slop):
    rng = random.Random(slop)
    docs = [(k, some_text(rng, rng.randint(0, 40))) for k in range(25)]
    queries = ["cat dog", "the the a", "über", "far away then far", "never seen"]
    index = stage(pi.build_index(spark.createDataFrame(docs, DOC), block_words=90))
    got = pi.near_matches(index, spark.createDataFrame([(q,) for q in queries], "phrase string"), slop).collect()
    want = [
        (q, i, *span) for i, text in docs for q in queries for span in plain_spans(plain_words(text), q.split(), len(q.split()) + slop)
    ]
    assert sorted(tuple(r) for r in got) == sorted(want)
