"""Exact shard sizes, gapless slots, the law of the communication matrix, and the mix, against plain counting."""

import random
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from tickweave.llm.mixing import mixed_rows
from tickweave.llm.sharding import communication_matrix, random_shards


def test_shards_are_even_and_slots_gapless(spark):
    rows = spark.range(103).select("id", F.lit("x").alias("Shard"), F.lit(7).alias("slot"))
    rows = rows.unionByName(rows.limit(4)).unionByName(rows.limit(1).withColumn("id", F.lit(None).cast("long")))
    got = random_shards(rows, [F.col("id")], n_shards=8, rows_per_block=9).collect()
    again = random_shards(rows, [F.col("id")], n_shards=8, rows_per_block=9).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    assert Counter(r.id for r in got) == Counter(r.id for r in rows.collect())
    sizes = Counter(r.shard for r in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert random_shards(rows.limit(0), [F.col("id")]).count() == 0


def test_matrix_sums_and_law():
    seen = Counter()
    for seed in range(4000):
        matrix = communication_matrix([3, 4], [4, 3], seed)
        assert [sum(r) for r in matrix] == [3, 4] and [sum(c) for c in zip(*matrix)] == [4, 3]
        seen[matrix[0][0]] += 1
    for k in range(4):  # the first block's rows in the first shard: hypergeometric
        want = comb(4, k) * comb(3, 3 - k) / comb(7, 3)
        assert abs(seen[k] / 4000 - want) < 0.03


def test_mix_against_plain_counting(spark):
    rng = random.Random(5)
    rows = [(k, " ".join("w" * rng.randint(0, 30)), rng.choice(["a", "b", "c", None])) for k in range(300)]
    rows += [(k, " ".join("w" * 400), "big") for k in range(300, 320)] + [(900, None, "a"), (901, "", None)] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumn("mix", F.lit(1)).withColumn("size", F.lit("z"))
    got = mixed_rows(docs)
    assert got.columns == docs.columns
    copies = Counter((r.doc_id, r.source) for r in got.collect())
    given = Counter((d, s) for d, _, s in rows)
    assert all(n <= 3 * given[k] for k, n in copies.items())
    words, taken = Counter(), Counter()
    size = {(d, s): len((t or "").split()) for d, t, s in rows}
    for d, t, s in rows:
        words[s] += len((t or "").split())
    for k, n in copies.items():
        taken[k[1]] += n * size[k]
    order = sorted([s for s in words if s is not None]) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, rest, left = {}, sum(words.values()), set(words)
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * words[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * words[s]
            rest -= target[s]
            left.discard(s)
    target |= share
    for s in words:
        assert abs(taken[s] - target[s]) <= 2 * max(n for k, n in size.items() if k[1] == s)
    assert mixed_rows(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks, shards", [([], [0, 0]), ([0, 0], [0]), ([5], [5])])
def test_small_matrices(blocks, shards):
    matrix = communication_matrix(blocks, shards, 1)
    assert [sum(r) for r in matrix] == blocks
