"""Nearest-neighbour joins on point clouds.

Reference points are indexed by a pyramid of grids, each level four times
coarser than the one below. Every occupied cell keeps the bounding box of its
points. A query starts with a few coarse cells and descends: cells whose box
lies farther than the best guaranteed distance are dropped, the rest are
replaced by their occupied children. A cell has at most 64 children, so each
join partner is small whatever the density, and no pair of a query with all
points of a crowded region is ever built.

Cells, and copies of them, come from small files whose size says little about
their rows, so these joins are not left to a broadcast.

Where the rows of queries are handed through, groups of few pairs are compared
in one task and only larger ones descend.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators.grouped import Groups, changes
from sightline.operators.voxels import XYZ
from sightline.session import durable

STEP_BITS = 2
LEAF_TARGET = 16
TOP_SALTS = 16
CELL = ("ix", "iy", "iz")
#: Pairs and rows of a group that one task compares, and pairs it holds at once.
GROUP_PAIRS = 1 << 24
GROUP_ROWS = 1 << 18
HELD_PAIRS = 1 << 20


def _with_cells(points: DataFrame, leaf: float) -> DataFrame:
    return points.withColumns({i: g.cell_index(F.col(c), leaf) for i, c in zip(CELL, XYZ)})


def _up(level: int) -> list[Column]:
    return [F.shiftright(F.col(c), STEP_BITS * level).alias(c) for c in CELL]


def _pyramid_level(leaves: DataFrame, on: Sequence[str], level: int) -> DataFrame:
    """Occupied cells of one level with the box of their points and their parent cell."""
    boxes = [f(F.col(f"{e}_{c}")).alias(f"{e}_{c}") for c in XYZ for e, f in (("lo", F.min), ("hi", F.max))]
    cells = leaves.select(*on, *_up(level), *[f"{e}_{c}" for c in XYZ for e in ("lo", "hi")])
    out = cells.groupBy(*on, *CELL).agg(*boxes)
    return out.withColumns({f"p{c}": F.shiftright(F.col(c), STEP_BITS) for c in CELL})


def _near_far() -> tuple[Column, Column]:
    """Squared distance from the query to the nearest and the farthest box corner."""
    near = far = None
    for c in XYZ:
        q, lo, hi = F.col(f"q_{c}"), F.col(f"lo_{c}"), F.col(f"hi_{c}")
        gap = F.greatest(lo - q, q - hi, F.lit(0.0))
        reach = F.greatest(F.abs(q - lo), F.abs(q - hi))
        near = gap * gap if near is None else near + gap * gap
        far = reach * reach if far is None else far + reach * reach
    return near, far


def _prune(cands: DataFrame, qid: Sequence[str], per: Sequence[str], bound2: float | None) -> DataFrame:
    """Drop cells that cannot hold the nearest point."""
    near, far = _near_far()
    slack = F.lit(1.0 + 1e-9)
    scored = cands.withColumns({"_near": near, "_far": far})
    if bound2 is not None:
        scored = scored.where(F.col("_near") < bound2)
    # One window per query point: its few remaining cells, one shuffle per level.
    best = F.min("_far").over(Window.partitionBy(*qid, *per))
    kept = scored.withColumn("_best", best).where(F.col("_near") <= F.col("_best") * slack)
    return kept.drop("_near", "_far", "_best")


def _leaf_size(refs: DataFrame, on: Sequence[str], span: float) -> float:
    """Cell size at which even the fullest leaf holds few distinct points."""
    leaf = span / 16.0
    for _ in range(24):
        cells = _with_cells(refs, leaf).groupBy(*on, *CELL).agg(F.count(F.lit(1)).alias("_n"))
        fullest = cells.agg(F.max("_n")).first()[0]
        if fullest is None or fullest <= LEAF_TARGET:
            break
        leaf /= 4.0
    return leaf


def _span(*frames: DataFrame) -> float:
    """Largest axis extent over all given clouds (one aggregated row each)."""
    lows, highs = [], []
    for f in frames:
        r = f.agg(*[h(c).alias(f"{h.__name__}_{c}") for c in XYZ for h in (F.min, F.max)]).first()
        if r[0] is not None:
            lows.append(r[0::2])
            highs.append(r[1::2])
    if not lows:
        return 0.0
    return max(max(h[k] for h in highs) - min(low[k] for low in lows) for k in range(3))


def nearest(
    queries: DataFrame,
    refs: DataFrame,
    on: Sequence[str],
    leaf: float | None = None,
    bound: float | None = None,
    per: Sequence[str] = (),
    payload: Sequence[str] = (),
    out: str = "dist",
    stored: bool = False,
    carry: Sequence[str] | None = None,
    group_pairs: int = GROUP_PAIRS,
) -> DataFrame:
    """Distance from each distinct query point to the nearest reference point.

    ``on``      columns both sides share; a query only sees references of its group
    ``per``     extra reference columns: one result per (query, per) instead of one per query
    ``bound``   strict upper limit; queries with nothing nearer are not returned
    ``payload`` reference columns of the nearest point; ties take the smallest values
    ``stored``  both inputs are cheap scans of written tables; they are not written again
    ``carry``   further query columns: every query row is returned with them, with nulls where its
                group has no reference; both inputs are cheap scans then, without bound or ``per``.
                Groups of up to ``group_pairs`` pairs are compared in one task, same answer
    """
    on, per, payload = list(on), list(per), list(payload)
    if carry is not None:
        if bound is not None or per or not on:
            raise ValueError("rows are carried without bound and per, and in groups")
        return _carried(queries, refs, on, leaf, payload, out, list(carry), group_pairs)
    keep = (lambda df, name: df) if stored else durable
    q = keep(queries.select(*on, *[F.col(c).cast("double").alias(f"q_{c}") for c in XYZ]).distinct(), "nn-queries")
    pts = refs.select(*on, *per, *payload, *[F.col(c).cast("double").alias(c) for c in XYZ])
    pts = keep(pts.groupBy(*on, *per, *XYZ).agg(F.min(F.struct(*payload, F.lit(0))).alias("_pay")), "nn-points")
    grp = on + per
    span = _span(pts) if bound is None or leaf is None else bound
    qid = on + [f"q_{c}" for c in XYZ]
    if leaf is None:
        leaf = _leaf_size(pts, grp, max(span, 1e-9))
    leaves = _with_cells(pts, leaf)
    boxed = leaves.select(
        *grp, *CELL, *[F.col(c).alias(f"{e}_{c}") for c in XYZ for e in ("lo", "hi")]
    )
    reach = span if bound is None else min(bound, max(span, leaf))
    top = max(0, math.ceil(math.log(max(reach, leaf) / leaf, 4) - 1e-9))
    bound2 = None if bound is None else bound * bound
    level = _pyramid_level(boxed, grp, top)
    if bound is None:
        cands = _join_top(q, level, on)
    else:
        cands = _join_neighbours(q, level, on, leaf * 4**top, bound)
    cands = _prune(cands, qid, per, bound2)
    for depth in range(top - 1, -1, -1):
        child = _pyramid_level(boxed, grp, depth)
        parent = cands.select(*qid, *per, *[F.col(c).alias(f"p{c}") for c in CELL])
        cands = _prune(parent.join(child.hint("merge"), [*grp, *[f"p{c}" for c in CELL]]), qid, per, bound2)
    final = cands.select(*qid, *per, *CELL).join(leaves.hint("merge"), [*grp, *CELL])
    dist = g.distance([F.col(f"q_{c}") for c in XYZ], [F.col(c) for c in XYZ])
    final = final.withColumn("_d", dist)
    if bound is not None:
        final = final.where(F.col("_d") < bound)
    best = final.groupBy(*qid, *per).agg(F.min(F.struct("_d", "_pay")).alias("_b"))
    return best.select(
        *on,
        *per,
        *[F.col(f"q_{c}").alias(c) for c in XYZ],
        F.col("_b._d").alias(out),
        *[F.col(f"_b._pay.{c}").alias(c) for c in payload],
    )


def _join_top(q: DataFrame, level: DataFrame, on: Sequence[str]) -> DataFrame:
    """Queries with the coarsest cells, which are as wide as the data: at most 8 per group.

    Groups are salted, so that a group with very many queries is spread; the few
    cells are repeated for every salt. Without groups the cells are broadcast.
    """
    if not on:
        return q.withColumn("_k", F.lit(0)).join(F.broadcast(level.withColumn("_k", F.lit(0))), "_k").drop("_k")
    salt = F.pmod(F.xxhash64(*[f"q_{c}" for c in XYZ]), F.lit(TOP_SALTS))
    copies = level.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TOP_SALTS - 1).cast("long"))))
    return q.withColumn("_salt", salt).join(copies.hint("merge"), [*on, "_salt"]).drop("_salt")


def _join_neighbours(q: DataFrame, level: DataFrame, on: Sequence[str], size: float, bound: float) -> DataFrame:
    """Queries with the coarse cells inside the bound (the cell is at least that wide)."""
    spread, near = q, F.lit(True)
    for i, c in zip(CELL, XYZ):
        here = g.cell_index(F.col(f"q_{c}"), size)
        spread = spread.withColumn(i, F.explode(F.array(here - 1, here, here + 1)))
        low = F.col(i) * F.lit(size)
        near = near & (F.col(f"q_{c}") > low - bound) & (F.col(f"q_{c}") < low + size + bound)
    return spread.where(near).join(level.hint("merge"), [*on, *CELL])


# ------------------------------------------------------------- rows of queries

def _carried(
    queries: DataFrame, refs: DataFrame, on: list[str], leaf: float | None, payload: list[str], out: str, carry: list[str], group_pairs: int
) -> DataFrame:
    """Query rows (on, x, y, z, carry) with distance and payload of the nearest reference of their group."""
    where = [F.col(c).cast("double").alias(c) for c in XYZ]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*on, *XYZ]])
    q = queries.select(*on, *where, *carry)
    r = refs.select(*on, *where, *payload).where(whole)
    columns = [*on, *XYZ, *carry, out, *payload]
    n = lambda df, name: df.where(whole).groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    sizes = n(q, "_q").join(n(r, "_r").hint("merge"), on, "full").na.fill(0, ["_q", "_r"])
    too_many = (F.col("_q") * F.col("_r") > group_pairs) | (F.col("_q") + F.col("_r") > GROUP_ROWS)
    large = durable(sizes.where(too_many).select(*on), "nn-large")
    some = not large.isEmpty()
    side = lambda df, how: df.join(large.hint("merge"), on, how) if some else df
    none = [F.lit(None).cast("double").alias(out), *[F.lit(None).cast(r.schema[c].dataType).alias(c) for c in payload]]
    rows = side(q.where(whole), "left_anti").withColumn("_ref", F.lit(False))
    rows = rows.unionByName(side(r, "left_anti").withColumn("_ref", F.lit(True)), allowMissingColumns=True)
    # References of a group come after its queries, smallest payload first.
    rows = rows.repartition(*on).sortWithinPartitions(*on, "_ref", *payload)
    schema = rows.withColumn(out, none[0]).select(*columns).schema
    got = rows.mapInArrow(_nearest_rows(on, payload, out, columns), schema)
    if some:
        big = side(q.where(whole), "left_semi")
        near = nearest(big, side(r, "left_semi"), on, leaf, payload=payload, out=out)
        got = got.unionByName(big.join(near.hint("merge"), [*on, *XYZ], "left").select(*columns))
    return got.unionByName(q.where(~whole).select("*", *none).select(*columns))


def _nearest_rows(
    on: list[str], payload: list[str], out: str, columns: list[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares all queries of a group with all its references; of equal distances the first one counts."""

    def solved(table: pa.Table) -> pa.Table:
        is_ref = table["_ref"].to_numpy()
        xyz = [table[c].to_numpy() for c in XYZ]
        starts = np.flatnonzero(changes(table, on))
        ends = np.append(starts[1:], len(table))
        n_refs = np.add.reduceat(is_ref.astype(np.int64), starts)
        best, dist = np.full(len(table), -1), np.full(len(table), np.nan)
        for a, b, k in zip(starts, ends, n_refs):
            m = b - k
            if not k or a == m:
                continue
            step = max(HELD_PAIRS // int(k), 1)
            for s in range(a, m, step):
                e = min(s + step, m)
                total = 0.0
                for x in xyz:
                    gap = x[s:e, None] - x[None, m:b]
                    total = total + gap * gap
                d = np.sqrt(total)
                d[np.isnan(d)] = np.inf
                at = d.argmin(axis=1)
                best[s:e] = m + at
                dist[s:e] = d[np.arange(e - s), at]
        ask = np.flatnonzero(~is_ref)
        found = best[ask] >= 0
        asked = table.take(pa.array(ask)).drop_columns(payload)
        asked = asked.append_column(out, pa.array(dist[ask], mask=~found))
        given = pa.array(best[ask], mask=~found)
        for c in payload:
            asked = asked.append_column(c, table[c].take(given))
        return asked.select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(on)
        for batch in batches:
            for whole in groups.push(pa.Table.from_batches([batch])):
                yield from solved(whole).to_batches()
        for whole in groups.rest():
            yield from solved(whole).to_batches()

    return run
