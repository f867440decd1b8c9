import random

import numpy as np
import pytest

from tickweave.llm.sentencepiece_trie import (
    MODEL, Encoder, Pieces, decode, decode_ids, encode, encode_sorted, load_pieces,
)

sentencepiece = pytest.importorskip("sentencepiece")
LETTERS = "  aábcdeéilnorstuTHE.,-'0129\n\tß日😀█"


@pytest.fixture(scope="module")
def pieces():
    return load_pieces()


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], dtype=np.int32).tolist()


def test_ids_equal_the_library_and_come_back(pieces):
    model, encoder, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), Encoder(pieces, 500), random.Random(1)
    texts = ["", " ", "  a  b\t\n ", "日本語テキスト 😀 abc", "a" * 1000, " " * 40 + "Hello" + " " * 20, "\x00\x1f"]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        ids = ids_of(encoder, text)
        assert ids == model.encode(text) and decode_ids(ids, pieces.surface) == text


def test_marks_of_the_text_come_back(pieces):
    encoder = Encoder(pieces)
    for text in ("▁", "x ▁ y▁▁", "﷐▁", "▁ "):
        assert decode_ids(ids_of(encoder, text), pieces.surface) == text


def test_unigram_search_finds_the_greatest_sum():
    rng = random.Random(5)
    scored = {c: (k, -8.0 - k / 7) for k, c in enumerate("▁abc")}
    for k in range(40):
        piece = "".join(rng.choice("abc") for _ in range(rng.randint(2, 4)))
        scored.setdefault(("▁" if rng.random() < 0.3 else "") + piece, (len(scored), -rng.uniform(3, 20)))
    model = Pieces(scored, tuple(range(1000, 1256)), (), False, "test")
    score = {k: s for k, s in scored.values()}

    def best(word):
        sums = [0.0] + [-1e18] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                if word[start:end] in scored:
                    sums[end] = max(sums[end], sums[start] + scored[word[start:end]][1])
        return sums[-1]

    words = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(400)})
    for word, ids in zip(words, encode_sorted(words, model)):
        assert abs(sum(score[k] for k in ids) - best(word)) < 1e-9
    assert list(encode_sorted(["▁aé"], model))[0][-2:] == (1000 + 0xC3, 1000 + 0xA9)


def test_frames_keep_rows_columns_nulls_and_long_texts(spark):
    long = "Straße und Haus, " * 30_000
    rows = [(1, "a b", 7), (1, "a b", 7), (None, None, 8), (3, "", None), (4, long, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `IDS x` long")
    got = decode(encode(df)).collect()
    assert [(r.doc_id, r.text, r["IDS x"]) for r in got] == rows
    assert all(r.text == r.decoded for r in got)
    assert got[2].ids is None and got[3].ids == [] and len(got[4].ids) > 100_000
    assert decode(encode(df.limit(0))).count() == 0
