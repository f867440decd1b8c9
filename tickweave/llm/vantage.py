"""Approximate nearest neighbours by vantage-point trees per shard.

A routing tree, fitted on a bounded sample (``max_sample`` rows by a hash of the id),
parts all vectors into cells; a cell is one shard, or several where it is crowded. Each
shard builds a vantage-point tree over all its vectors. A query first searches its own
cell. The distance of its k-th hit then says which cells, and inside a shard which
branches, can hold nearer ones: by the triangle inequality, a side of a vantage point
lies at least ``|distance - radius|`` away. A side is skipped where ``factor`` times this
bound is beyond the k-th hit. Factor 1 is exact; larger factors search less.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite
component take no part, nor do rows without an id, nor vectors whose length is not the
most common one. An id given to several rows counts as the row with the smallest vector.
Ties go to the smaller id. Equal vectors are kept once per shard with their ``k + 1``
smallest ids, which is all that an answer can use. Distances beyond double range count
as none. Queries with fewer candidates than
``k`` get all of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import col, hash_sample

LEAF = 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of ``a`` to every row of ``b``, term by term."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = np.sqrt(((a[k : k + step, None, :] - b[None, :, :]) ** 2).sum(axis=-1))
    return out


@dataclass
class Tree:
    """Inner nodes: vantage point, radius, inner and outer child. Children below 0 are leaves."""

    points: list[np.ndarray] = field(default_factory=list)
    radii: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        """Build over ``x[rows]``; returns the node. Depth is logarithmic: radii are medians."""
        if len(rows) > leaf:
            some = x[rng.choice(rows, min(len(rows), 6), replace=False)]
            probe = x[rng.choice(rows, min(len(rows), 256), replace=False)]
            point = some[distances(some, probe).std(axis=1).argmax()]
            away = distances(point[None, :], x[rows])[0]
            radius = float(np.median(away))
            inner = away <= radius
            if inner.all():
                radius = float(away[away < radius].max()) if (away < radius).any() else radius
                inner = away <= radius
            if not inner.all():
                node = len(self.points)
                self.points.append(point)
                self.radii.append(radius)
                self.children.append([0, 0])
                self.children[node][0] = self.grow(x, rows[inner], leaf, rng)
                self.children[node][1] = self.grow(x, rows[~inner], leaf, rng)
                return node
        self.leaves.append(rows)
        return -len(self.leaves)

    def locate(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        out = np.zeros(len(x), dtype=np.int64)

        def down(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node < 0:
                out[rows] = -node - 1
                return
            inner = distances(self.points[node][None, :], x[rows])[0] <= self.radii[node]
            down(self.children[node][0], rows[inner])
            down(self.children[node][1], rows[~inner])

        down(0 if self.points else -1, np.arange(len(x)))
        return out

    def reach(self, x: np.ndarray, allowed, visit) -> None:
        """Call ``visit(leaf, rows)`` for the rows of ``x`` that may find something there.

        ``allowed(rows, bounds)`` says which of them have not reached it yet: bounds are
        least distances to the part of space at hand.
        """

        def down(node: int, rows: np.ndarray, bounds: np.ndarray) -> None:
            keep = allowed(rows, bounds)
            rows, bounds = rows[keep], bounds[keep]
            if not len(rows):
                return
            if node < 0:
                visit(-node - 1, rows)
                return
            gap = distances(self.points[node][None, :], x[rows])[0] - self.radii[node]
            down(self.children[node][0], rows, np.maximum(bounds, gap))
            down(self.children[node][1], rows, np.maximum(bounds, -gap))

        down(0 if self.points else -1, np.arange(len(x)), np.zeros(len(x)))


def plant(x: np.ndarray, leaf: int, seed: int = 1) -> Tree:
    tree = Tree()
    tree.grow(x, np.arange(len(x)), leaf, np.random.default_rng(seed))
    return tree


def _near_enough(bounds: np.ndarray, factor: float, limits: np.ndarray) -> np.ndarray:
    """Rounding never skips: bounds are taken a little smaller."""
    return factor * np.maximum(bounds * (1 - 1e-9) - 1e-12, 0) <= limits


def search_shard(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, limits: np.ndarray, k: int, factor: float
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best ids and distances per query (id -1 and infinity where none is left)."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    distinct, first, group = np.unique(x, axis=0, return_index=True, return_inverse=True)
    group = group.ravel()
    by_group = np.argsort(group, kind="stable")
    turn = np.arange(len(ids)) - np.searchsorted(group[by_group], group[by_group])
    kept = by_group[turn <= k]
    members = [ids[m] for m in np.split(kept, np.flatnonzero(np.diff(group[kept])) + 1)]
    tree = plant(distinct, LEAF)
    best = np.full((len(q), k), np.inf)
    who = np.full((len(q), k), -1, dtype=np.int64)

    def visit(leaf: int, rows: np.ndarray) -> None:
        points = tree.leaves[leaf]
        sizes = [len(members[p]) for p in points]
        there = np.concatenate([members[p] for p in points])
        away = np.repeat(distances(q[rows], distinct[points]), sizes, axis=1)
        away[query_ids[rows, None] == there[None, :]] = np.inf
        every = np.concatenate([best[rows], away], axis=1)
        names = np.concatenate([who[rows], np.broadcast_to(there, away.shape)], axis=1)
        names[np.isinf(every)] = -1
        order = np.lexsort((names, every), axis=-1)[:, :k]
        best[rows] = np.take_along_axis(every, order, axis=1)
        who[rows] = np.take_along_axis(names, order, axis=1)

    home = tree.locate(q)
    for leaf in np.unique(home):
        visit(leaf, np.flatnonzero(home == leaf))
    tree.reach(
        q,
        lambda rows, bounds: _near_enough(bounds, factor, np.minimum(best[rows, -1], limits[rows])),
        lambda leaf, rows: visit(leaf, rows[home[rows] != leaf]) if (home[rows] != leaf).any() else None,
    )
    return who, best


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _map_of(values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    factor: float = 2.5,
    vector: str = "embedding",
    key: str = "vec_id",
    rows_per_shard: int = 8_192,
    max_sample: int = 4_096,
    queries_per_task: int = 2_048,
    seed: int = 1,
) -> DataFrame:
    """query_id, rank, vec_id, score for every row of ``vectors`` for which ``is_query`` holds."""
    typed = vectors.select(
        col(key).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("v"), is_query.alias("q")
    )
    rows = stage(
        typed.where(F.col("vec_id").isNotNull() & _valid(F.col("v")))
        .groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    )
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    hits_type = "query_id long, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == common["n"])
    sample = hash_sample(rows.select("v", "vec_id"), F.col("vec_id"), max_sample).collect()
    points = np.array([r.v for r in sorted(sample, key=lambda r: r.vec_id)], dtype=np.float64)
    total = common["count"]
    # Leaves of at least 8 sampled rows, so at most max_sample / 8 cells.
    router = plant(points, max(8, int(len(points) * rows_per_shard / total)), seed)

    def with_cell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(cell=router.locate(_matrix(frame["v"])))

    celled = stage(rows.mapInPandas(with_cell, "vec_id long, v array<double>, q boolean, cell long"))
    # One number per cell: a bounded table.
    sizes = {r.cell: r["count"] for r in celled.groupBy("cell").count().collect()}
    parts = _map_of({c: -(-n // rows_per_shard) for c, n in sizes.items()})
    placed = celled.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts[F.col("cell")]))

    def search(requests: DataFrame) -> DataFrame:
        """``requests``: query_id, qv, reach, cell. All shards of the cell are searched."""
        asked = {r.cell: r["count"] for r in requests.groupBy("cell").count().collect()}
        blocks = _map_of({c: -(-asked.get(c, 0) // queries_per_task) for c in sizes})
        n_blocks = blocks[F.col("cell")]
        sent = requests.select(
            "query_id", "qv", "reach", "cell",
            F.explode(F.sequence(F.lit(0).cast("long"), parts[F.col("cell")] - 1)).alias("part"),
            F.pmod(F.xxhash64("query_id"), n_blocks).alias("block"),
        )
        there = placed.where(n_blocks > 0).select(
            "vec_id", "v", "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks.cast("long") - 1)).alias("block")
        )

        def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            query_ids = right["query_id"].to_numpy()
            who, best = search_shard(
                left["vec_id"].to_numpy(), _matrix(left["v"]), query_ids, _matrix(right["qv"]),
                right["reach"].to_numpy(), k, factor,
            )
            real = np.isfinite(best.ravel())
            return pd.DataFrame(
                {"query_id": np.repeat(query_ids, k)[real], "vec_id": who.ravel()[real], "score": best.ravel()[real]}
            )

        keys = ("cell", "part", "block")
        return there.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(both, hits_type)

    queries = celled.where("q").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), "cell")
    home = stage(_best(search(queries.withColumn("reach", F.lit(float("inf")))), k))
    reach = home.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(float("inf")).alias("reach")
    )

    def elsewhere(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            frame = frame.reset_index(drop=True)
            q, limits = _matrix(frame["qv"]), frame["reach"].to_numpy()
            found: list[tuple[int, np.ndarray]] = []
            router.reach(
                q,
                lambda rows, bounds: _near_enough(bounds, factor, limits[rows]),
                lambda leaf, rows: found.append((leaf, rows)),
            )
            for cell, at in found:
                at = at[frame["cell"].to_numpy()[at] != cell]
                if len(at):
                    yield frame.loc[at, ["query_id", "qv", "reach"]].assign(cell=cell)

    asked = queries.join(reach, "query_id", "left").fillna({"reach": float("inf")})
    more = stage(asked.mapInPandas(elsewhere, "query_id long, qv array<double>, reach double, cell long"))
    hits = home.select("query_id", "vec_id", "score").unionByName(search(more))
    return _best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
