"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint has a ball of variants: all fingerprints within half the
radius. Two that are close enough meet at a variant between them. Fingerprints that
meet are verified by their distance and linked to one of them per variant; connected
classes follow. The shuffle goes by the half of a variant that a flip leaves alone:
a fingerprint then travels once for all variants that share this half, which the
receiving task makes, instead of once for each.

Half of an odd radius: one of two fingerprints at an odd distance has an even number
of set bits. That one goes the longer way, and of its longer flips those inside one
half of the bits are enough, since most of the differing bits lie in one half. So for
radius 3 a ball has 65 variants, or 1,057 for even fingerprints, and no link is lost.

Defined results: null texts and texts without words have fingerprint 0 and are linked
like any other. Texts shorter than a shingle are one shingle. Null ids take part; the
class id is the smallest id that is not null, or null if the class has none. Repeated
rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import broadcast_if_small, stage
from .common import col, fresh, lower_words_of
from .components import components

BITS, HALF = 64, 32
LOW = np.uint64((1 << HALF) - 1)
HASH_SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    words = lower_words_of(text)
    if not words:
        return 0
    size = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    n = len(words) - size + 1
    ones = np.zeros(BITS, dtype=np.int64)
    while True:
        some = islice(shingles, 1 << 15)
        part = np.array([xxhash.xxh64_intdigest(s, HASH_SEED) for s in some], dtype="<u8")
        if not len(part):
            break
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(width: int = 3):
    """A column function: the fingerprint of a text as a long with the same bits."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        prints = np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64)
        return pa.array(prints.view(np.int64))

    return of


def ball_masks(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Flips inside one half that all fingerprints emit, and those of even ones besides."""
    near = [sum(1 << b for b in c) for k in range(radius // 2 + 1) for c in combinations(range(HALF), k)]
    far = [sum(1 << b for b in c) for c in combinations(range(HALF), radius // 2 + 1)] if radius % 2 else []
    return np.array(near, dtype=np.uint64), np.array(far, dtype=np.uint64)


def _halves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return prints & LOW, prints >> np.uint64(HALF)


def _place(fixed: np.ndarray, side: int) -> np.ndarray:
    """A key for the half ``side`` of a variant."""
    return (fixed | np.uint64(side << HALF)).view(np.int64)


def _spread(free: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The part of a crowded place that a variant's other half belongs to."""
    return (free.view(np.int64) * 40503 >> 8) % splits


def _emit(radius: int):
    """Each fingerprint, to the places where variants of its ball lie.

    A place is one half of a variant. All variants with flips in the other half only
    lie at one place, so the fingerprint goes there once (``visit`` false) and its flips
    are made there. Variants with flips in the place's half go there one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = ball_masks(radius)[0][1:]
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in np.array_split(prints, len(prints) // 2000 + 1):
                keys, visits = [], []
                for side in (0, 1):
                    fixed = _halves(part)[side]
                    keys += [_place(fixed, side), _place((fixed[:, None] ^ flips).ravel(), side)]
                    visits += [np.zeros(len(part), dtype=bool), np.ones(len(part) * len(flips), dtype=bool)]
                own = np.concatenate([part, np.repeat(part, len(flips))] * 2)
                columns = [np.concatenate(keys), own.view(np.int64), np.concatenate(visits)]
                yield pa.record_batch([pa.array(c) for c in columns], ["place", "print", "visit"])

    return run


def _pairs(groups: np.ndarray, prints: np.ndarray, away: np.ndarray, radius: int) -> np.ndarray:
    """Links among rows of the same group (a variant), each verified by its distance.

    The member nearest to the variant is linked with all others. If two members are
    at most ``radius`` from each other by way of the variant, both are from it too.
    """
    order = np.argsort(groups)
    same = np.diff(groups[order]) == 0
    order = order[np.r_[same, False] | np.r_[False, same]] if len(order) > 1 else order[:0]
    groups, prints, away = groups[order], prints[order], away[order]
    order = np.lexsort((prints, away, groups))
    groups, prints = groups[order], prints[order]
    firsts = np.r_[True, np.diff(groups) != 0] if len(groups) else np.zeros(0, dtype=bool)
    centre = prints[np.maximum.accumulate(np.where(firsts, np.arange(len(prints)), 0))]
    close = (np.bitwise_count(centre ^ prints) <= radius) & (centre != prints)
    pairs = np.stack([centre.view(np.int64), prints.view(np.int64)], axis=1)[close]
    return np.unique(np.sort(pairs, axis=1), axis=0)


def _meet(radius: int, most_variants: int = 200_000):
    """Links of the places of one task, some places at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        near, far = ball_masks(radius)
        place, prints, visit, splits, part = (
            np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in parts]) for k in range(5)
        )
        del parts
        prints = prints.view(np.uint64)
        order = np.lexsort((part, place))
        place, prints, visit, splits, part = (x[order] for x in (place, prints, visit, splits, part))
        begins = np.r_[True, (np.diff(place) != 0) | (np.diff(part) != 0)]
        groups = np.cumsum(begins).astype(np.uint64)
        made = np.cumsum(np.where(visit, 1, len(near) + len(far)))
        starts = np.flatnonzero(begins)
        cuts = starts[np.flatnonzero(np.diff(made[starts] // most_variants)) + 1]
        for rows in np.split(np.arange(len(place)), cuts):
            found = _meet_some(place[rows], prints[rows], visit[rows], splits[rows], part[rows], groups[rows], near, far, radius)
            if len(found):
                yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _meet_some(place, prints, visit, splits, part, groups, near, far, radius) -> np.ndarray:
    high = (place >> HALF).astype(bool)
    low_half, high_half = _halves(prints)
    free = np.where(high, low_half, high_half)
    own = np.flatnonzero(~visit)
    even = own[np.bitwise_count(prints[own]) % 2 == 0]
    rows = np.concatenate([np.flatnonzero(visit), np.repeat(own, len(near)), np.repeat(even, len(far))])
    variants = np.concatenate([free[visit], (free[own, None] ^ near).ravel(), (free[even, None] ^ far).ravel()])
    mine = (splits[rows] == 1) | (_spread(variants, splits[rows]) == part[rows])
    rows, variants = rows[mine], variants[mine]
    away = np.bitwise_count(variants ^ free[rows]).astype(np.int64)
    fixed = (place & int(LOW)).view(np.uint64)[rows]
    away += np.bitwise_count(np.where(high, high_half, low_half)[rows] ^ fixed)
    return _pairs(groups[rows] - groups[0] << np.uint64(HALF) | variants, prints[rows], away, radius)


def links(prints: DataFrame, radius: int = 3, most_at_place: int = 2_000, variants_per_task: int = 8_000_000) -> DataFrame:
    """Verified pairs (a, b) of different fingerprints that span all classes.

    ``prints`` is a stored table of distinct fingerprints (one long column). Places with
    more than ``most_at_place`` fingerprints are dealt to several tasks, each of which
    makes its part of their variants.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the halves of a ball are laid out for a radius of 0 to 3")
    near, far = ball_masks(radius)
    n = prints.count()
    tasks = max(8, -(-n * 2 * (len(near) + len(far) // 2) // variants_per_task))
    sent = prints.repartition(tasks).mapInArrow(_emit(radius), "place long, print long, visit boolean")
    low, high = F.col("print").bitwiseAND(int(LOW)), F.shiftrightunsigned("print", HALF)
    at = F.explode(F.array(low, high.bitwiseOR(1 << HALF)))
    crowded = (
        prints.toDF("print").select(at.alias("place")).groupBy("place").count()
        .where(F.col("count") > most_at_place)
        .select("place", F.ceil(F.col("count") / most_at_place).alias("splits"))
    )
    sent = sent.join(broadcast_if_small(crowded, 100_000), "place", "left").fillna({"splits": 1})
    free = F.when(F.shiftrightunsigned("place", HALF) == 1, low).otherwise(high)
    part = F.pmod(F.shiftright(free * 40503, 8), F.col("splits"))
    every = F.explode(
        F.when(F.col("visit"), F.array(part)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1))
    )
    return (
        sent.select("place", "print", "visit", "splits", every.alias("part"))
        .repartition(tasks, "place", "part")
        .mapInArrow(_meet(radius), "a long, b long")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, radius: int = 3
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (long), component_id, class_print.

    ``class_print`` is the smallest fingerprint of the class, a name that every class has.
    """
    prints = stage(docs.select(col(key).alias("id"), simhash(width)(col(text)).alias("fingerprint")))
    per_print = stage(prints.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    roots = components(links(per_print.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    named = per_print.join(roots, "fingerprint", "left").withColumn(
        "class_print", F.coalesce("root", "fingerprint")
    )
    named = stage(named.select("fingerprint", "first_id", "class_print"))
    smallest = named.groupBy("class_print").agg(F.min("first_id").alias("component_id"))
    ids = named.join(smallest, "class_print").select("fingerprint", "class_print", "component_id")
    return prints.join(ids, "fingerprint").select("id", "fingerprint", "component_id", "class_print")


def keep_one(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, radius: int = 3
) -> DataFrame:
    """``docs`` with one row of every class: that of the smallest id.

    Rows without an id stay only where no row of their class has one, one per class.
    Rows that share an id and a class count as one document; the first met stays.
    """
    found = stage(near_duplicates(docs, text, key, width, radius))
    gone, twice = fresh(docs, "sim_gone", "sim_twice")
    drop = found.where(F.col("id").isNotNull() & (F.col("id") != F.col("component_id")))
    repeated = found.where(F.col("id") == F.col("component_id")).groupBy("id").count().where("count > 1")
    # A repeated id may name different texts: then those of the other classes go.
    both = drop.join(repeated.select("id"), "id", "left_semi").select("id", "fingerprint")
    named = docs.where(col(key).isNotNull())
    lone = drop.select(F.col("id").alias(gone)).join(
        repeated.select(F.col("id").alias(gone)), gone, "left_anti"
    )
    kept = named.join(lone, col(key) == F.col(gone), "left_anti")
    again = repeated.select(F.col("id").alias(twice))
    if not repeated.isEmpty():
        once = kept.join(again, col(key) == F.col(twice), "left_anti")
        many = kept.join(again, col(key) == F.col(twice), "left_semi").withColumn(gone, simhash(width)(col(text)))
        many = many.join(
            both, (col(key) == F.col("id")) & (F.col(gone) == F.col("fingerprint")), "left_anti"
        ).dropDuplicates([key])
        kept = once.unionByName(many.drop(gone))
    orphans = found.where(F.col("id").isNull() & F.col("component_id").isNull())
    if not orphans.isEmpty():
        names = orphans.select(F.col("fingerprint").alias(gone), F.col("class_print").alias(twice)).distinct()
        rest = docs.where(col(key).isNull()).withColumn(gone, simhash(width)(col(text)))
        rest = rest.join(names, gone).dropDuplicates([twice]).drop(gone, twice)
        kept = kept.unionByName(rest)
    return kept.select(*(col(c) for c in docs.columns))
