"""Connected components by repeated contraction.

Each round every vertex points to its smallest neighbour, pointers are
shortened by a jump, and the edge list is rewritten between the surviving
vertices, which at least halves them. Only the contracted edges and the
round's pointers are written; labels are resolved once at the end by following
the pointers of all rounds. A vertex with very many edges only ever meets a
map-side combined minimum and a join against one row per vertex.

Where the edges of a part lie close to each other, a task first replaces each
stretch of its edges by a star per part it finds in them, which links the same
vertices with fewer edges (``contract``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sightline.session import durable

#: Edges that a task contracts at once.
STRETCH = 1 << 20


def least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the smallest vertex it is linked to, directly or through others."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (before[a], before[b], a, b):
            np.minimum.at(root, side, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from the smallest vertex of each part of a stretch to its other vertices."""

    def contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = least_joined(len(ids), at[: len(a)], at[len(a) :])
        leaf = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[root[leaf]]), pa.array(ids[leaf])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= STRETCH:
            yield contracted(held)
            held, n = [], 0
    if n:
        yield contracted(held)


def _shorten(parent: DataFrame) -> DataFrame:
    """One pointer jump: parent of the parent."""
    up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
    return parent.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, contract: bool = False) -> DataFrame:
    """(v, component) for every vertex that has an edge; component = smallest vertex."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    alone = ends.where("a = b").select(F.col("a").alias("v"))
    work = ends.where("a <> b")
    if contract and all(isinstance(f.dataType, LongType) for f in work.schema):
        work = work.mapInArrow(_stars, "a long, b long")
    work = work.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    work = durable(work, "cc-edges")
    rounds: list[DataFrame] = []
    while not work.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError("components did not converge")
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p"))
        parent = durable(_shorten(least.withColumn("p", F.least("v", "p"))), "cc-parents")
        rounds.append(parent)
        pa = parent.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        pb = parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = work.join(pa, "a").join(pb, "b").where("pa <> pb")
        work = durable(
            moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges"
        )
    if not rounds:
        return alone.distinct().withColumn("component", F.col("v"))
    label = rounds[0].select("v", F.col("p").alias("component"))
    for parent in rounds[1:]:
        step = parent.select(F.col("v").alias("component"), F.col("p").alias("_p"))
        label = label.join(step, "component", "left").select("v", F.coalesce("_p", "component").alias("component"))
    lone = alone.distinct().join(rounds[0], "v", "left_anti").withColumn("component", F.col("v"))
    return label.unionByName(lone)
