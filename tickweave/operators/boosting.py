"""One boosted-tree model per security, all securities in the same jobs.

Features are binned once, by quantiles of their security. A tree grows level by level: the
gradients of a level are summed by (security, node, feature, bin), and every node takes the split
of greatest gain. Securities of up to ``block_rows`` rows share tasks: a batch of them is one set of
arrays, and a level is one sum for all. The rows of larger ones lie in cached blocks: each
level is one job over the blocks, whose histograms are added up in the task, then by security,
and only the splits come back. Scores move along with the first level of the next tree.
Both ways use the same functions and bins and build the same trees.

Every round gives a tree and, with validation rows, a loss per security. The round kept is
the one of least loss; a security stops when ``patience`` rounds brought no smaller one.

A security whose labels are not all finite numbers fails: it has a row with the reason and no
tree. Missing feature values count as the smallest. Keys must not be null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..session import broadcast_if_small, stage


@dataclass(frozen=True)
class Boosting:
    """How trees are grown; ``depth`` 5 allows 32 leaves."""

    rounds: int = 100
    step: float = 0.05
    depth: int = 5
    bins: int = 32
    min_leaf: int = 20
    logistic: bool = False
    patience: int | None = None
    block_rows: int = 200_000


class Tree:
    """Splits and values by node: the root is 1, the children of n are 2n and 2n + 1.

    Several trees lie behind one another.
    """

    def __init__(self, depth: int, count: int = 1) -> None:
        size = count * (2 << depth)
        self.feature = np.full(size, -1, dtype=np.int64)
        self.cut = np.zeros(size, dtype=np.int64)
        self.value = np.zeros(size)

    def split(self, nodes: np.ndarray, feature, cut, left, right) -> None:
        self.feature[nodes], self.cut[nodes] = feature, cut
        self.value[2 * nodes], self.value[2 * nodes + 1] = left, right


def _values(sums: np.ndarray, step: float) -> np.ndarray:
    """The value of a node by its sums of gradient and hessian (last axis)."""
    return np.where(sums[..., 1] > 0, -step * sums[..., 0] / np.where(sums[..., 1] > 0, sums[..., 1], 1), 0.0)


def _best_splits(sums: np.ndarray, how: Boosting):
    """Of ``sums`` (node, feature, bin, of gradient, hessian and rows): the nodes to split, each with
    the feature and cut of greatest gain and the values of its children."""
    total = sums[:, 0].sum(axis=1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    fits = (np.minimum(left[..., 2], right[..., 2]) >= how.min_leaf) & (np.minimum(left[..., 1], right[..., 1]) > 1e-3)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = total[:, 0] ** 2 / total[:, 1]
        gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - whole[:, None, None]
    gain = np.where(fits, gain, -np.inf).reshape(len(sums), -1)
    best = gain.argmax(axis=1)
    hit = np.flatnonzero(gain[np.arange(len(sums)), best] > 1e-12)
    feature, cut = np.divmod(best[hit], sums.shape[2] - 1)
    return hit, feature, cut, _values(left[hit, feature, cut], how.step), _values(right[hit, feature, cut], how.step)


def _slopes(score: np.ndarray, label: np.ndarray, how: Boosting) -> tuple[np.ndarray, np.ndarray]:
    if not how.logistic:
        return score - label, np.ones(len(score))
    share = 1 / (1 + np.exp(-score))
    return share - label, share * (1 - share)


def _loss(score: np.ndarray, label: np.ndarray, how: Boosting) -> np.ndarray:
    return np.logaddexp(0, score) - label * score if how.logistic else (score - label) ** 2


def _slot_sums(bins, slope, bend, rows, slots, n_slots: int, how: Boosting) -> np.ndarray:
    """Gradients, hessians and rows of ``rows`` by (slot, feature, bin)."""
    sums = np.empty((n_slots, len(bins), how.bins, 3))
    slope, first, size = slope[rows], slots * how.bins, n_slots * how.bins
    bend = bend[rows] if how.logistic else None
    for f, mine in enumerate(bins):
        cell = first + mine[rows]
        n = np.bincount(cell, minlength=size)
        sums[:, f, :, 0] = np.bincount(cell, slope, size).reshape(n_slots, -1)
        sums[:, f, :, 1] = (n if bend is None else np.bincount(cell, bend, size)).reshape(n_slots, -1)
        sums[:, f, :, 2] = n.reshape(n_slots, -1)
    return sums


def _base(mean: float, how: Boosting) -> float:
    if not how.logistic:
        return mean
    mean = min(max(mean, 1e-9), 1 - 1e-9)
    return float(np.log(mean / (1 - mean)))


def _grow(bins, label, score, learn, owner, n_owners: int, how: Boosting):
    """One tree for each of some securities, and the node of every row; ``owner`` is the security of a row.

    A node is at (owner, node) of the flat arrays. Nodes too small for two children are not summed.
    """
    size = 2 << how.depth
    trees, first = Tree(how.depth, n_owners), owner * size
    slope, bend = _slopes(score, label, how)
    roots = np.stack([np.bincount(owner[learn], w[learn], n_owners) for w in (slope, bend)], axis=1)
    trees.value[1::size] = _values(roots, how.step)
    node, live = np.ones(len(label), dtype=np.int64), np.arange(len(label))
    for _ in range(how.depth):
        at = first[learn] + node[learn]
        wanted = np.flatnonzero(np.bincount(at, minlength=n_owners * size) >= max(2 * how.min_leaf, 1))
        if not len(wanted):
            break
        slots = np.full(n_owners * size, -1)
        slots[wanted] = np.arange(len(wanted))
        large = slots[at] >= 0
        learn, slots = learn[large], slots[at[large]]
        hit, feature, cut, left, right = _best_splits(_slot_sums(bins, slope, bend, learn, slots, len(wanted), how), how)
        nodes = wanted[hit]
        if not len(nodes):
            break
        trees.feature[nodes], trees.cut[nodes] = feature, cut
        child = nodes + nodes % size
        trees.value[child], trees.value[child + 1] = left, right
        live = live[trees.feature[first[live] + node[live]] >= 0]
        learn = learn[trees.feature[first[learn] + node[learn]] >= 0]
        at = first[live] + node[live]
        node[live] = 2 * node[live] + (bins[trees.feature[at], live] > trees.cut[at])
    return trees, node


def _fit_batch(bins, label, is_valid, owner, base: np.ndarray, how: Boosting):
    """(round from 1, owners, losses, trees in flat arrays) of each round for the securities of a batch."""
    n, size = len(base), 2 << how.depth
    score, best, best_round, active = base[owner], np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.arange(n)
    for k in range(how.rounds):
        trees, node = _grow(bins, label, score, np.flatnonzero(~is_valid), owner, n, how)
        score = score + trees.value[owner * size + node]
        late = np.flatnonzero(is_valid)
        n_late = np.bincount(owner[late], minlength=n)
        total = np.bincount(owner[late], _loss(score[late], label[late], how), n)
        loss = np.where(n_late > 0, total / np.maximum(n_late, 1), np.nan)
        yield k + 1, active, loss[active], trees
        better = loss < best
        best, best_round = np.where(better, loss, best), np.where(better, k, best_round)
        if how.patience:
            stops = (n_late > 0) & (k - best_round >= how.patience)
            active = active[~stops[active]]
            if not len(active):
                return
            stay = np.flatnonzero(~stops[owner])
            if len(stay) < len(owner):
                bins, label, is_valid, owner, score = bins[:, stay], label[stay], is_valid[stay], owner[stay], score[stay]


def _binned(columns: Sequence[np.ndarray], edges: list) -> np.ndarray:
    """Bins by feature and row."""
    found = np.zeros((len(columns), len(columns[0]) if columns else 0), np.uint8)
    for k, (values, cuts) in enumerate(zip(columns, edges)):
        values = np.where(np.isnan(values), -np.inf, values)
        found[k] = np.searchsorted(np.array(cuts or [], dtype=float), values, side="left")
    return found


def _floats(table, names: Sequence[str]) -> list[np.ndarray]:
    return [table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False) for name in names]


def profiles(rows: DataFrame, key: str, features: Sequence[str], label: str, valid: str | None, how: Boosting) -> DataFrame:
    """One row per security: bin edges, rows, mean label of the training rows, whether labels are finite, blocks."""
    shares = [k / how.bins for k in range(1, how.bins)]
    edges = F.array(*(F.array_distinct(F.percentile_approx(F.col(c).cast("double"), shares, 1000)) for c in features))
    value = F.col(label).cast("double")
    odd = value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf"))
    learn = F.lit(True) if valid is None else ~F.col(valid)
    found = rows.groupBy(key).agg(
        edges.alias("_edges"),
        F.count(F.lit(1)).alias("_rows"),
        F.avg(F.when(learn, value)).alias("_mean"),
        F.coalesce(F.bool_or(odd), F.lit(False)).alias("_odd"),
    )
    return stage(found.withColumn("_blocks", F.ceil(F.col("_rows") / how.block_rows).cast("int")))


def _in_blocks(rows: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by hash to the blocks of their key, and the row of ``known`` once for every block."""
    dealt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.col("_blocks")).cast("int")
    placed = rows.join(known.select(key, "_blocks"), key).withColumn("_block", dealt).drop("_blocks")
    each = known.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return placed, each.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), *[c for c in known.columns if c != key])


def fit_rounds(
    rows: DataFrame, key: str, features: Sequence[str], label: str, valid: str | None = None, how: Boosting = Boosting()
) -> tuple[DataFrame, DataFrame]:
    """The profiles, and one row per security and round: round (from 1), loss, feature, cut, value, error.

    The lists of a tree end after its last node.
    """
    features = list(features)
    known = profiles(rows, key, features, label, valid, how)
    flags = F.lit(False) if valid is None else F.col(valid)
    columns = [F.col(key), *(F.col(c).cast("double").alias(f"_f{k}") for k, c in enumerate(features))]
    data = rows.select(*columns, F.col(label).cast("double").alias("_label"), flags.alias("_valid"))
    failed = known.where("_odd").select(
        key, F.lit(0).alias("round"), *(F.lit(None).cast(k).alias(n) for n, k in ROUND_KINDS[1:-1]),
        F.lit("labels are not all finite numbers").alias("error"),
    )
    found = _fit_small(data, known, key, len(features), how).unionByName(failed)
    large = known.where("_blocks > 1 and not _odd").where(F.col(key).isNotNull())
    if large.isEmpty():
        return known, stage(found)
    return known, stage(found.unionByName(_fit_large(data, large, key, len(features), how)))


ROUND = "round int, loss double, feature array<int>, cut array<int>, value array<double>, error string"
ROUND_KINDS = [tuple(part.split()) for part in ROUND.split(", ")]
ROUND_NAMES = [name for name, _ in ROUND_KINDS]
#: Rows of a task that fits small securities; a larger security may come on top.
BATCH_ROWS = 50_000
#: Rows of a block, and of a task over blocks, when large securities are fitted.
IN_BLOCK, IN_TASK = 50_000, 2_000_000
#: Rounds after which scores are worked out from all trees so far: shorter lineage against less work.
ROUNDS_KEPT = 50
#: Trees of large securities that the driver gathers before it writes them.
TREES_KEPT = 2_000
#: Most sums of a level, one per security and task, that the driver adds up by itself; more are shuffled.
FEW_SUMS = 500


def _tree_lists(trees: Tree, depth: int, owners: np.ndarray) -> list[pa.Array]:
    """The lists feature, cut, value of some securities in flat arrays, each up to its last node."""
    size = 2 << depth
    splits = trees.feature.reshape(-1, size)[owners] >= 0
    last = np.where(splits.any(axis=1), size - 1 - splits[:, ::-1].argmax(axis=1), 0)
    lengths = 2 * last + 2
    kept = np.arange(size) < lengths[:, None]
    offsets = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
    flat = [
        pa.array(getattr(trees, name).reshape(-1, size)[owners][kept], kind)
        for name, kind in (("feature", pa.int32()), ("cut", pa.int32()), ("value", pa.float64()))
    ]
    return [pa.ListArray.from_arrays(offsets, values) for values in flat]


def _fit_small(data: DataFrame, known: DataFrame, key: str, n_features: int, how: Boosting) -> DataFrame:
    """Securities dealt by hash to batches; a task fits all of a batch at once."""
    kind = data.schema[key].dataType.simpleString()
    names = [f"_f{k}" for k in range(n_features)]
    whole = (F.col("_blocks") <= 1) & ~F.col("_odd")
    n_rows = known.where(whole).agg(F.sum("_rows")).first()[0] or 0
    deal = F.pmod(F.xxhash64(key), F.lit(max(8, -(-n_rows // BATCH_ROWS)))).alias("_batch")

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        keys, parts = known.column("_key").combine_chunks(), []
        owner = pc.index_in(rows.column(key), value_set=keys).to_numpy().astype(np.int64)
        order = np.argsort(owner, kind="stable")
        rows, owner = rows.take(pa.array(order)), owner[order]
        ends = np.searchsorted(owner, np.arange(len(keys) + 1))
        columns, bins = _floats(rows, names), np.zeros((n_features, len(owner)), np.uint8)
        for k, edges in enumerate(known.column("_edges").to_pylist()):
            mine = slice(ends[k], ends[k + 1])
            bins[:, mine] = _binned([c[mine] for c in columns], edges)
        label, is_valid = rows.column("_label").to_numpy(), rows.column("_valid").to_numpy().astype(bool)
        base = np.array([_base(m or 0.0, how) for m in known.column("_mean").to_pylist()])
        for k, owners, loss, trees in _fit_batch(bins, label, is_valid, owner, base, how):
            n = len(owners)
            lists = _tree_lists(trees, how.depth, owners)
            loss = pa.array(loss, mask=np.isnan(loss))
            columns = [keys.take(pa.array(owners)), pa.array(np.full(n, k), pa.int32()), loss, *lists, pa.nulls(n, pa.string())]
            parts.append(pa.table(columns, [key, *ROUND_NAMES]))
        return pa.concat_tables(parts)

    # Few securities are large or fail; their rows are not needed here.
    others = broadcast_if_small(known.where(~whole).select(key))
    mine = data.where(F.col(key).isNotNull()).join(others, key, "left_anti").select("*", deal)
    named = known.where(whole & F.col(key).isNotNull()).select("*", deal).withColumnsRenamed({key: "_key", "_batch": "_in"})
    return mine.groupBy("_batch").cogroup(named.groupBy("_in")).applyInArrow(run, f"`{key}` {kind}, {ROUND}")


def _node_sums(tree: Tree, level: int, bins, slope, bend, how: Boosting, sums: np.ndarray) -> None:
    """Adds gradients, hessians and rows by (node of the level, feature, bin) to ``sums``."""
    parts = [(1, bins, slope, bend)]
    for _ in range(level):
        parts = [part for node, *rows in parts for part in _children(tree, node, *rows)]
    for node, bins, slope, bend in parts:
        for to, mine in zip(sums[node - (1 << level)], bins):
            cell = mine.astype(np.intp)
            n = np.bincount(cell, minlength=how.bins)
            to[:, 0] += np.bincount(cell, slope, how.bins)
            to[:, 1] += n if bend is None else np.bincount(cell, bend, how.bins)
            to[:, 2] += n


def _tree_values(tree: Tree, bins: np.ndarray) -> np.ndarray:
    found, some = np.empty(bins.shape[1]), [(1, np.arange(bins.shape[1]))]
    while some:
        node, rows = some.pop()
        if tree.feature[node] < 0:
            found[rows] = tree.value[node]
            continue
        right = bins[tree.feature[node]][rows] > tree.cut[node]
        some += (2 * node, rows[~right]), (2 * node + 1, rows[right])
    return found


def _children(tree: Tree, node: int, bins, *others):
    """The rows of both children of a node, none if it is not split."""
    if tree.feature[node] < 0:
        return
    right = bins[tree.feature[node]] > tree.cut[node]
    for child, rows in ((2 * node, np.flatnonzero(~right)), (2 * node + 1, np.flatnonzero(right))):
        yield child, bins.take(rows, 1), *(None if x is None else x.take(rows) for x in others)


def _fit_large(data: DataFrame, known: DataFrame, key: str, n_features: int, how: Boosting) -> DataFrame:
    """One job over the cached blocks per level; the driver holds the trees.

    Large securities are fewer than rows / ``block_rows``; so are the trees of a round. Blocks are
    an RDD of arrays: the plan of a DataFrame cached round after round doubles in text with every round.
    """
    spark, kind = data.sparkSession, data.schema[key].dataType.simpleString()
    names = [f"_f{k}" for k in range(n_features)]
    infos = known.select(key, "_edges", "_mean", "_rows").collect()
    places, edges = {r[key]: at for at, r in enumerate(infos)}, [r._edges for r in infos]
    bases = [_base(r._mean or 0.0, how) for r in infos]
    n_rows = sum(r._rows for r in infos)
    n_tasks = max(spark.sparkContext.defaultParallelism, -(-n_rows // IN_TASK))
    parts = ("bins", "label", "valid")

    def pack(batches):
        held, sizes = {}, Counter()

        def out(name):
            rows = pa.Table.from_batches(held.pop(name))
            bins = _binned(_floats(rows, names), edges[places[name]])
            content = (bins, rows.column("_label").to_numpy().astype(float), rows.column("_valid").to_numpy().astype(bool))
            sizes[name] = 0
            return pa.record_batch([pa.array([places[name]], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in content)], ["at", *parts])

        for batch in batches:
            for name in pc.unique(batch.column(key)):
                mine = batch.filter(pc.equal(batch.column(key), name))
                name = name.as_py()
                held.setdefault(name, []).append(mine)
                sizes[name] += mine.num_rows
                if sizes[name] >= IN_BLOCK:
                    yield out(name)
        for name in list(held):
            yield out(name)

    def unpack(rows):
        for r in rows:
            label = np.frombuffer(r.label)
            bins = np.frombuffer(r.bins, dtype=np.uint8).reshape(n_features, len(label))
            yield r.at, bins, label, np.frombuffer(r.valid, dtype=bool), np.full(len(label), bases[r.at])

    def level_job(blocks: RDD, trees: dict, level: int) -> dict:
        """By security: root value, loss, the nodes to split with feature, cut and values."""
        shape = (1 << level, n_features, how.bins, 3)

        def sums(blocks):
            found = {}
            for at, bins, label, valid, score in blocks:
                if at not in trees:
                    continue
                if at not in found:
                    found[at] = np.zeros(shape), np.zeros(2)
                whole, lost = found[at]
                if not level:
                    lost += _loss(score[valid], label[valid], how).sum(), valid.sum()
                if valid.any():
                    learn = np.flatnonzero(~valid)
                    bins, label, score = bins.take(learn, 1), label.take(learn), score.take(learn)
                slope, bend = _slopes(score, label, how)
                _node_sums(trees[at], level, bins, slope, bend if how.logistic else None, how, whole)
            return found.items()

        def add(some, more):
            return some[0] + more[0], some[1] + more[1]

        def split(found):
            whole, (lost, late) = found
            root = float(_values(whole[0, 0].sum(axis=0), how.step))
            hit, *best = _best_splits(whole, how)
            return root, float(lost / late) if late else None, (len(whole) + hit, *best)

        # A task gives one row per security: nodes x features x bins sums, whatever its rows.
        tables, n_parts = blocks.mapPartitions(sums), blocks.getNumPartitions()
        if len(trees) * n_parts <= FEW_SUMS:  # a shuffle would take longer than to add up few rows here
            found = {}
            for at, part in tables.collect():
                found[at] = add(found[at], part) if at in found else part
            return {at: split(part) for at, part in found.items()}
        return dict(tables.reduceByKey(add, min(n_parts, len(trees))).mapValues(split).collect())

    def moved(blocks: RDD, rounds: list[dict]) -> RDD:
        def move(blocks):
            for at, bins, label, valid, score in blocks:
                if at in rounds[-1]:
                    for trees in rounds:
                        score = score + _tree_values(trees[at], bins)
                    yield at, bins, label, valid, score

        return blocks.mapPartitions(move)

    def kept(blocks: RDD) -> RDD:
        return blocks.persist(StorageLevel.MEMORY_AND_DISK)

    mine = data.join(F.broadcast(known.select(key)), key)
    stored = stage(mine.mapInArrow(pack, "at int, bins binary, label binary, valid binary"))
    unscored = stored.repartition(n_tasks).rdd.mapPartitions(unpack)
    blocks, rounds = kept(unscored), []
    trees, best, tables, grown = {at: Tree(how.depth) for at in range(len(infos))}, {}, [], []

    def write() -> None:
        tables.append(stage(spark.createDataFrame(grown, f"`{key}` {kind}, {ROUND}")))
        grown.clear()

    def end_round(k: int, found: dict) -> None:
        """Losses of round k, which the first level after it finds; securities out of patience stop."""
        for at, (_, loss, _) in found.items():
            lists = _tree_lists(trees[at], how.depth, np.zeros(1, dtype=np.int64))
            grown.append((infos[at][key], k, loss, *(x[0].as_py() for x in lists), None))
            if loss is not None and loss < best.get(at, (np.inf, 0))[0]:
                best[at] = loss, k
            if how.patience and loss is not None and k - best.get(at, (0, 1))[1] >= how.patience:
                del trees[at]

    for k in range(how.rounds + 1):
        after = blocks
        if k:
            rounds.append(dict(trees))
            anew = k % ROUNDS_KEPT == 0 and k < how.rounds
            after = kept(moved(unscored, list(rounds)) if anew else moved(blocks, rounds[-1:]))
        found = level_job(after, dict(trees), 0)
        if k:
            blocks.unpersist()
            end_round(k, found)
        blocks = after
        if grown and (len(grown) >= TREES_KEPT or k == how.rounds or not trees):
            write()
        if k == how.rounds or not trees:
            break
        for at in trees:
            trees[at] = Tree(how.depth)
            trees[at].value[1] = found[at][0]
        for level in range(how.depth):
            if level:
                found = level_job(blocks, trees, level)
            for at, tree in trees.items():
                tree.split(*found[at][2])
            if not any(len(found[at][2][0]) for at in trees):
                break
    blocks.unpersist()
    return reduce(DataFrame.unionByName, tables)


def best_rounds(rounds: DataFrame, key: str) -> DataFrame:
    """The round of least loss per security, the last one where no loss is known."""
    known = rounds.where("round > 0")
    found = known.groupBy(key).agg(
        F.min_by("round", F.struct(F.col("loss").isNull(), "loss", "round")).alias("best"),
        F.min("loss").alias("least"),
        F.max("round").alias("run"),
    )
    return found.withColumn("best", F.when(F.col("least").isNull(), F.col("run")).otherwise(F.col("best")))


def models(known: DataFrame, rounds: DataFrame, key: str, how: Boosting) -> DataFrame:
    """key, base, edges, trees, round (that of least loss), run (rounds made): one row per fitted security."""
    best = best_rounds(rounds, key)
    kept = rounds.join(best, key).where("round > 0 and round <= best")
    trees = kept.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("round", "feature", "cut", "value"))).alias("trees"),
        F.max("best").alias("round"), F.max("run").alias("run"),
    )
    mean = F.coalesce("_mean", F.lit(0.0))
    if how.logistic:
        mean = F.least(F.greatest(mean, F.lit(1e-9)), F.lit(1 - 1e-9))
        mean = F.log(mean / (1 - mean))
    return known.join(trees, key).select(key, mean.alias("base"), F.col("_edges").alias("edges"), "trees", "round", "run")


def score_by_key(rows: DataFrame, fitted: DataFrame, key: str, features: Sequence[str], how: Boosting) -> DataFrame:
    """Rows of fitted securities with ``score``: the predicted value, or the probability of class 1."""
    features = list(features)
    blocks = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / how.block_rows).cast("int").alias("_blocks"))
    placed, each = _in_blocks(rows, stage(fitted.join(blocks, key)), key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"

    def run(found: pa.Table, model: pa.Table) -> pa.Table:
        found = found.drop_columns(["_block"])
        if not model.num_rows or not found.num_rows:
            return found.slice(0, 0).append_column("score", pa.array([], pa.float64()))
        edges, base = model.column("edges")[0].as_py(), model.column("base")[0].as_py()
        trees = forest(model.column("trees").combine_chunks().flatten())
        return found.append_column("score", pa.array(forest_score(_floats(found, features), edges, base, trees, how)))

    placed = placed.select(*rows.columns, "_block")
    return placed.groupBy(key, "_block").cogroup(each.groupBy("_key", "_at")).applyInArrow(run, schema)


def forest(trees: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature, cut, value by (tree, node) of the trees of one security."""
    found = []
    for name, blank in (("feature", -1), ("cut", 0), ("value", 0.0)):
        lists = trees.field(name)
        lengths = pc.list_value_length(lists).to_numpy()
        values = lists.flatten().to_numpy()
        whole = np.full((len(lists), max(lengths.max(initial=0), 2)), blank, dtype=values.dtype)
        whole[np.arange(whole.shape[1]) < lengths[:, None]] = values
        found.append(whole)
    return tuple(found)


def forest_score(columns: Sequence[np.ndarray], edges: list, base: float, trees, how: Boosting, most: int = 500_000) -> np.ndarray:
    """The predicted value, or the probability of class 1; some trees at a time for all rows."""
    bins = _binned(columns, edges)
    n = bins.shape[1]
    score, step = np.full(n, base), max(1, most // max(n, 1))
    for k in range(0, len(trees[0]), step):
        count, width = trees[0][k : k + step].shape
        feature, cut, value = (x[k : k + step].ravel() for x in trees)
        first = np.repeat(np.arange(count) * width, n)
        row, node = np.tile(np.arange(n), count), np.ones(n * count, dtype=np.int64)
        live = np.arange(n * count)
        for _ in range(how.depth):
            live = live[feature[first[live] + node[live]] >= 0]
            at = first[live] + node[live]
            node[live] = 2 * node[live] + (bins[feature[at], row[live]] > cut[at])
        score += value[first + node].reshape(count, n).sum(axis=0)
    return 1 / (1 + np.exp(-score)) if how.logistic else score
