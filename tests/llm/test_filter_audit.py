"""The streamed filter audit against plain counting, over many files and in any file order."""

import random
import re
import tempfile
from itertools import permutations

import pytest

from tickweave.llm import filter_audit as fa

DOC = "doc_id long, text string, lang string"
LABEL = "doc_id long, quality int, toxic int"


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
    ]


def plain_report(docs, labels):
    rows = [(i, t or "", p or "") for i, t, p in docs]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    fails = [(p, plain_mask(t) + [i is not None and i > least[t]], i in good, i in toxic) for i, t, p in rows]
    out, first = {}, {}
    for part in {p for _, _, p in rows}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            gone = [False] * len(mine)
            for step, letter in enumerate(order):
                x = "ABCDE".index(letter)
                hit = [f[1][x] for f in mine]
                removed = [h and not g for h, g in zip(hit, gone)]
                redundant = sum(h and g for h, g in zip(hit, gone))
                gone = [g or h for g, h in zip(gone, hit)]
                out[part, "".join(order), step + 1] = [
                    gone.count(False), sum(removed), redundant, sum(f[1][x] and sum(f[1]) == 1 for f in mine),
                    sum(r and f[2] for r, f in zip(removed, mine)), sum(r and f[3] for r, f in zip(removed, mine)),
                ]
                first[part, letter] = first.get((part, letter), 0) + sum(removed)
    return {k: (*v, first[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, docs, labels, schema=DOC, files=6, batches=4):
    folder = tempfile.mkdtemp(prefix="audit-") + "/documents.parquet"
    spark.createDataFrame(docs, schema).repartition(files).write.parquet(folder)
    got = fa.audit_filters(spark, folder, spark.createDataFrame(labels, LABEL), batches=batches).collect()
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got}


def some_docs(seed, n):
    rng = random.Random(seed)
    texts = [None, "", "A|B", "the cat " * 150, " ".join(f"w{k}" for k in range(250)), "UPPER Case text", "ü" * 40]
    texts += [" ".join(f"W{k} #{k}" for k in range(220)), "plain short"]
    ids = [rng.choice([rng.randint(-50, 400), rng.randint(-50, 400), None]) for _ in range(n)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in ids]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i in rng.sample(range(-50, 400), 200)]
    return docs, labels + labels[:20]


def test_against_plain_counting(spark):
    docs, labels = some_docs(3, 400)
    docs += docs[:60]  # repeated rows
    assert run(spark, docs, labels) == plain_report(docs, labels)


def test_one_file_and_extra_columns(spark):
    docs, labels = some_docs(4, 60)
    wide = [(*d, 1, "x", 2, True) for d in docs]
    got = run(spark, wide, labels, DOC + ", mask int, part string, n long, good boolean", files=1, batches=1)
    assert got == plain_report(docs, labels)


def test_smaller_ids_that_come_later_are_retracted():
    import pandas as pd

    class State:
        exists, value = False, None

        def update(self, value):
            self.exists, self.value = True, value

        @property
        def get(self):
            return self.value

    state, counters = State(), {}
    digest = b"d" * fa.DIGEST
    for doc_id, part in [(9, "a"), (5, "b"), (7, "a"), (5, "a"), (1, "c")]:
        frame = pd.DataFrame([(digest, 3, True, doc_id, part, 1)], columns=["digest", "mask", "has_id", "doc_id", "part", "n"])
        for out in fa.fold_texts((0,), iter([frame]), state):
            for row in out.itertuples():
                key = (row.doc_id, row.part, row.mask)
                counters[key] = counters.get(key, 0) + row.n
    kept = {k: n for k, n in counters.items() if n}
    assert kept == {(9, "a", 19): 1, (5, "b", 19): 1, (7, "a", 19): 1, (5, "a", 19): 1, (1, "c", 3): 1}
    assert state.value[1] == [1]


def test_empty_table(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}


@pytest.mark.parametrize("text", ["", "a b", "A" * 5, "x " * 300, "#", "Ä|ß" * 10])
def test_masks(text):
    want = sum(f << k for k, f in enumerate(plain_mask(text)))
    assert fa.text_mask(text.encode(), len(text)) == want
