import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from tickweave.llm.components import components
from tickweave.llm.simhash import keep_one, links, near_duplicates
from tickweave.session import stage


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("most_at_place", [3, 2_000])
def test_links_span_the_same_classes_as_all_pairs(spark, radius, most_at_place):
    rng = random.Random(radius)
    prints = set()
    for _ in range(25):
        p = rng.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
    prints = [signed(p) for p in prints]
    df = stage(spark.createDataFrame([(p,) for p in prints], "print long"))
    found = [(r.a, r.b) for r in links(df, radius, most_at_place, 10_000).collect()]
    mask = (1 << 64) - 1
    near = [(a, b) for a, b in combinations(sorted(prints), 2) if ((a ^ b) & mask).bit_count() <= radius]
    assert set(found) <= set(near)
    assert classes(prints, found) == classes(prints, near)


def test_radius_beyond_three_is_refused(spark):
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "print long"), 4)


def test_components_of_chains_stars_and_nothing(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {199: 199, 200: 199}
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = {
    1: "One two three four FIVE six",
    2: "one two three four five six",
    3: "quite another text with other words here",
    4: None,
    5: " \n\t",
    6: "short",
    7: "two words",
    8: "émile says   nothing\x1cat all",
    9: "wort " * 40_000,
}


def test_fingerprints_match_plain_code(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    got = {r.id: r for r in near_duplicates(df).collect()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: signed(brute_print(t)) for k, t in TEXTS.items()}
    want = classes(
        TEXTS,
        [(a, b) for a, b in combinations(TEXTS, 2) if (brute_print(TEXTS[a]) ^ brute_print(TEXTS[b])).bit_count() <= 3],
    )
    assert {k: r.component_id for k, r in got.items()} == want
    assert got[1].component_id == got[2].component_id == 1 and got[4].fingerprint == 0 == got[5].fingerprint


def test_keep_one_with_repeats_nulls_and_clashing_names(spark):
    rows = [
        (2, "a b c d e", "x"), (1, "a b c d e", "y"), (3, "f g h i j", "z"), (3, "f g h i j", "z"),
        (None, "a b c d e", "n"), (None, "k l m n o", "n"), (None, "k l m n o", "m"), (3, "a b c d e", "w"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, sim_gone string")
    got = keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text[0]) for r in got.collect()) == [(0, "k"), (1, "a"), (3, "f")]
    assert keep_one(df.limit(0)).count() == 0
    assert near_duplicates(df.limit(0)).count() == 0
    copies = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same old text").alias("text"))
    assert [r.doc_id for r in keep_one(copies).collect()] == [0]
