"""A uniform shuffle into shards of exact sizes, by a communication matrix.

Rows lie in blocks. How many rows every block sends to every shard is drawn from
the law that a uniform random permutation of all rows would give: a multivariate
hypergeometric draw per block, from what the shards can still take. Every block is
then permuted on its own and cut by its row of the matrix, and every shard is
permuted again. Shard sizes are exact and no sort over all rows is needed.

Rows move with DataFrame operations only. The driver draws the matrix, of at most
``MOST_BLOCKS`` x shards counts, whatever the input.

Defined results: a null text counts as empty: size 1, crc32 0. A null id is a value
like any other. Repeated rows are separate rows with slots of their own. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stage
from .common import col, prefix, without

MOST_BLOCKS = 4096


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """Good items among ``draws`` taken without putting back; any size.

    Few draws are made one by one. Many use rejection under a table-mountain hat
    (Stadlober's ratio of uniforms), at constant cost.
    """
    total = good + bad
    if draws > total - draws:
        return good - hypergeometric(good, bad, total - draws, rng)
    if good > bad:
        return draws - hypergeometric(bad, good, draws, rng)
    if draws <= 12 or good == 0:
        taken = 0
        for k in range(draws):
            taken += rng.random() * (total - k) < good - taken
        return taken
    share = good / total
    middle = draws * share + 0.5
    spread = math.sqrt((total - draws) * draws * share * (1 - share) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e))
    mode = (draws + 1) * (good + 1) // (total + 2)
    most = min(min(draws, good) + 1, math.floor(middle + 16 * spread))

    def log_weight(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, draws - k, bad - draws + k))

    top = log_weight(mode)
    while True:
        u = 1.0 - rng.random()
        at = middle + width * (rng.random() - 0.5) / u
        if 0 <= at < most and 2 * math.log(u) <= log_weight(int(at)) - top:
            return int(at)


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Row per block, column per shard; rows sum to ``blocks``, columns to ``shards``."""
    rng = random.Random(seed)
    room, matrix = list(shards), []
    for rows in blocks:
        line, ahead = [], sum(room)
        for s, free in enumerate(room):
            ahead -= free
            line.append(hypergeometric(free, ahead, rows, rng) if rows else 0)
            rows -= line[-1]
            room[s] -= line[-1]
        matrix.append(line)
    return matrix


def random_shards(
    rows: DataFrame, key: list[Column], n_shards: int = 8, seed: int = 1, rows_per_block: int = 50_000
) -> DataFrame:
    """``rows`` with ``shard`` (int) and ``slot`` (long, from 0 without gaps in its shard).

    Shard sizes differ by one at most. ``key`` feeds the hashes that stand for random
    numbers; rows with equal keys may swap places. ``rows`` is read three times:
    pass a stored table. Columns named shard or slot are replaced.
    """
    rows = without(rows, "shard", "slot")
    spark: SparkSession = rows.sparkSession
    p = prefix(rows, "shard_")
    n = rows.count()
    n_blocks = max(1, min(MOST_BLOCKS, -(-n // rows_per_block)))
    block = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(n_blocks)).cast("int")
    counted = {r[0]: r[1] for r in rows.groupBy(block.alias("b")).count().collect()}
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([counted.get(b, 0) for b in range(n_blocks)], sizes, seed)
    cuts = spark.createDataFrame(
        [(b, [sum(line[: s + 1]) for s in range(n_shards)]) for b, line in enumerate(matrix)],
        f"{p}b int, {p}cuts array<long>",
    )

    def shuffled(*by: str, salt: str):
        return Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.lit(salt), *key), *key)

    # At most MOST_BLOCKS rows of n_shards numbers: safe to broadcast.
    placed = (
        rows.withColumn(p + "block", block)
        .withColumn(p + "at", F.row_number().over(shuffled(p + "block", salt="send")))
        .join(F.broadcast(cuts), F.col(p + "block") == F.col(p + "b"))
        .withColumn(p + "to", F.size(F.filter(p + "cuts", lambda c: c < F.col(p + "at"))))
    )
    bins = max(1, -(-n // (n_shards * rows_per_block)))
    bin_ = F.pmod(F.xxhash64(F.lit(seed), F.lit("bin"), *key), F.lit(bins)).cast("int")
    sent = stage(
        placed.select(*(col(c) for c in rows.columns), F.col(p + "to"), bin_.alias(p + "bin"))
    )
    by_bin = sent.groupBy(F.col(p + "to").alias(p + "s"), F.col(p + "bin").alias(p + "k")).agg(
        F.count(F.lit(1)).alias(p + "n")
    )
    earlier = Window.partitionBy(p + "s").orderBy(p + "k").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bin.withColumn(p + "start", F.coalesce(F.sum(p + "n").over(earlier), F.lit(0)))
    slots = sent.withColumn(
        p + "at", F.row_number().over(shuffled(p + "to", p + "bin", salt="place"))
    ).join(starts, (F.col(p + "to") == F.col(p + "s")) & (F.col(p + "bin") == F.col(p + "k")))
    return slots.select(
        *(col(c) for c in rows.columns),
        F.col(p + "to").cast("int").alias("shard"),
        (F.col(p + "start") + F.col(p + "at") - 1).cast("long").alias("slot"),
    )
