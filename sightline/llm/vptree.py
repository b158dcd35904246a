"""Approximate nearest neighbours by vantage-point trees, one per shard.

Rows are spread over shards by a hash of their ids; each shard is a tree over
its unit vectors, where chord distance orders like cosine. A tree is searched
by a block of queries at once: at every node the distance to the vantage point
bounds, by the triangle inequality, how near a child can be, and the child is
skipped for queries whose k-th neighbour is nearer than that bound times
``factor``. Factor one skips only what cannot hold a nearer row, so the search
is exact; larger factors skip more.

Scores are cosines in double precision on the original vectors; ties go to the
smaller id. Vectors that are null, zero or hold null or non-finite components
take no part; vectors of different lengths are not compared; of rows that
repeat an id the smallest vector counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import by_rows
from sightline.session import durable

#: Rows of a shard, about; what a task holds at once.
SHARD_ROWS = 4096
LEAF = 48
NEIGHBOURS = 5
FACTOR = 1.0
SEED = 10
SLACK = 1e-9


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, vector) of the rows that take part."""
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    )
    inf = float("inf")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (x < F.lit(inf)) & (x > F.lit(-inf)))
    rows = rows.where(fine & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def build_tree(units: np.ndarray, seed: int = SEED, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, bounds): nodes are (begin, end, vantage, near child, far child) over ``order``.

    ``bounds`` has the least and largest distance from the vantage point to
    the rows of either child. A leaf has children -1.
    """
    rng = np.random.default_rng(seed)
    order = np.arange(len(units))
    nodes: list[list[int]] = []
    bounds: list[list[float]] = []

    def grow(begin: int, end: int) -> int:
        at = len(nodes)
        nodes.append([begin, end, -1, -1, -1])
        bounds.append([0.0, 0.0, 0.0, 0.0])
        if end - begin <= leaf:
            return at
        vantage = int(order[rng.integers(begin, end)])
        rows = order[begin:end]
        apart = np.sqrt(np.maximum(0, 2 - 2 * (units[rows] @ units[vantage])))
        by = np.argsort(apart, kind="stable")
        order[begin:end] = rows[by]
        apart = apart[by]
        half = (end - begin) // 2
        nodes[at][2] = vantage
        bounds[at] = [apart[0], apart[half - 1], apart[half], apart[-1]]
        nodes[at][3] = grow(begin, begin + half)
        nodes[at][4] = grow(begin + half, end)
        return at

    if len(units):
        grow(0, len(units))
    return order, np.array(nodes, np.int64).reshape(-1, 5), np.array(bounds, np.float64).reshape(-1, 4)


def search_tree(
    units: np.ndarray, ids: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray],
    queries: np.ndarray, own: np.ndarray, k: int, factor: float,
) -> list[np.ndarray]:
    """For each query, the rows that may be among its k nearest."""
    order, nodes, bounds = tree
    n = len(queries)
    best = np.full((n, k), 4.0)  # chord distances of the k nearest so far
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    stack = [(0, np.arange(n), np.zeros(n))]
    while stack:
        node, active, bound = stack.pop()
        open_ = bound * factor <= best[active, -1] + SLACK
        active = active[open_]
        if not len(active):
            continue
        begin, end, vantage, near, far = nodes[node]
        if near < 0:
            rows = order[begin:end]
            apart = np.sqrt(np.maximum(0, 2 - 2 * (queries[active] @ units[rows].T)))
            apart[ids[rows] == own[active][:, None]] = 5.0
            best[active] = np.sort(np.concatenate([best[active], apart], 1), 1)[:, :k]
            for i, q in enumerate(active):
                hit = np.flatnonzero(apart[i] <= min(best[q, -1], 4.0) + SLACK)
                if len(hit):
                    found[q].append((rows[hit], apart[i, hit]))
            continue
        to = np.sqrt(np.maximum(0, 2 - 2 * (queries[active] @ units[vantage])))
        low = np.maximum(0, np.maximum(bounds[node, 0] - to, to - bounds[node, 1]))
        high = np.maximum(0, np.maximum(bounds[node, 2] - to, to - bounds[node, 3]))
        children = [(int(near), active, low), (int(far), active, high)]
        if low.mean() < high.mean():
            children.reverse()
        stack += children
    out = []
    for q in range(n):
        rows = np.concatenate([r for r, _ in found[q]]) if found[q] else np.zeros(0, np.int64)
        apart = np.concatenate([a for _, a in found[q]]) if found[q] else np.zeros(0)
        out.append(rows[apart <= best[q, -1] + SLACK])
    return out


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of a vector with each row; sums run from the first component to the last."""
    total = lambda x: np.add.accumulate(x, axis=-1)[..., -1]
    squares = total(rows * rows), total(query * query)
    if not (np.isfinite(squares[0]).all() and np.isfinite(squares[1]) and squares[0].min() > 1e-200 and squares[1] > 1e-200):
        return cosines(query / np.abs(query).max(), rows / np.abs(rows).max(1, keepdims=True))
    return total(rows * query) / np.sqrt(squares[0] * squares[1])


class Shard:
    """Tree over the rows of one shard."""

    def __init__(self, ids: list[int], vectors: list[list[float]]):
        self.ids = np.array(ids, np.int64)
        self.data = np.array(vectors, np.float64)
        self.units = unit(self.data)
        self.tree = build_tree(self.units)

    def search(self, own: list[int], queries: list[list[float]], k: int, factor: float) -> list[tuple[int, int, float]]:
        """(query id, row id, cosine) of the k nearest rows of each query."""
        asked = np.array(queries, np.float64)
        hits = search_tree(self.units, self.ids, self.tree, unit(asked), np.array(own, np.int64), k, factor)
        out = []
        for q, rows in enumerate(hits):
            if len(rows):
                score = cosines(asked[q], self.data[rows])
                top = np.lexsort((self.ids[rows], -score))[:k]
                out += [(own[q], int(self.ids[rows[t]]), float(score[t])) for t in top]
        return out


def nearest(
    df: DataFrame, is_query: Column, k: int = NEIGHBOURS, factor: float = FACTOR,
    id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every row where ``is_query`` (on vec_id) holds.

    A task holds one shard at a time: its rows come first and make the tree,
    then the queries stream through it in batches.
    """
    vectors = durable(valid_vectors(df, id_col, vector_col), "vp-vectors")
    sizes = vectors.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    known = vectors.join(sizes, "dim")
    rows = known.select(
        "dim", F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.col("shards")).cast("int").alias("shard"),
        F.lit(0).alias("asks"), "vec_id", "vector",
    )
    # Every query visits every shard of its dimension.
    asks = known.where(is_query).select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.lit(1).alias("asks"), "vec_id", "vector",
    )
    dealt = rows.unionByName(asks).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks", "vec_id")

    def run(batches: Iterator[list]) -> Iterator[tuple]:
        at, ids, vectors_, shard = None, [], [], None
        for batch in batches:
            asked: list[tuple] = []
            out: list[tuple] = []

            def answer() -> None:
                if asked:
                    out.extend(shard.search([i for i, _ in asked], [v for _, v in asked], k, factor))
                    asked.clear()

            for dim, part, ask, vec_id, vector in zip(*batch, strict=True):
                if (dim, part) != at:
                    answer()
                    at, ids, vectors_, shard = (dim, part), [], [], None
                if ask:
                    if shard is None:
                        shard = Shard(ids, vectors_) if ids else None
                    if shard is not None:
                        asked.append((vec_id, vector))
                else:
                    ids.append(vec_id)
                    vectors_.append(vector)
            answer()
            if out:
                yield tuple(zip(*out, strict=True))

    found = by_rows(dealt, run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
