"""Suppression of overlapping boxes and of copied masks, without limits on how many there are.

A frame of up to ``FRAME_BOXES`` boxes is selected from by one task. Overlapping
boxes of a larger one meet in the cells of grids that follow their size, so it
does not compare all of them, and what greedy selection keeps is the fixpoint of
two rules on the overlap graph: a box no undecided better box overlaps is kept,
and what a kept box overlaps is dropped.

The masks of a frame of up to ``FRAME_CELLS`` cells meet in one task as well;
their cells travel as runs, once. Those of a larger frame meet by a join.

Boxes, cells and masks are exploded from small files, whose size says little
about their rows, so their joins are never left to a broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators import truth as tr
from sightline.operators.grouped import Groups, changes
from sightline.session import durable

BOX = ("x1", "y1", "x2", "y2")
FRAME_BOXES = 4096
#: Cells and masks of a frame that one task compares.
FRAME_CELLS = 1 << 20
FRAME_MASKS = 2048
#: Boxes of a frame that are compared all with all at once, and numbers of a table of masks by cells.
ALL_PAIRS = 512
BLOCK = 1 << 22


def _area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def box_iou(a: str, b: str) -> Column:
    """Overlap of two boxes given as structs with x1, y1, x2, y2."""
    p, q = ([F.col(f"{s}.{c}") for c in BOX] for s in (a, b))
    inter = _area(F.greatest(p[0], q[0]), F.greatest(p[1], q[1]), F.least(p[2], q[2]), F.least(p[3], q[3]))
    return inter / (_area(*p) + _area(*q) - inter + 1e-9)


def overlapping_boxes(boxes: DataFrame, iou_max: float) -> DataFrame:
    """(frame, better, worse): pairs of a frame that overlap by more than ``iou_max``, by their ``rank``.

    A side of such a pair is at most 1 / iou_max times as long as the other,
    so a box looks for partners at its own size level and a few larger ones.
    """
    up = math.ceil(math.log2(1 / max(iou_max, 1e-3)))
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    sized = boxes.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).select(
        "frame", "rank", F.struct(*BOX).alias("box"), F.ceil(F.log2(side)).alias("level")
    )
    at = sized.withColumn("grid", F.explode(F.sequence(F.col("level"), F.col("level") + up)))
    cell = F.pow(F.lit(2.0), F.col("grid"))
    reach = lambda lo, hi: F.sequence(F.floor(F.col(f"box.{lo}") / cell), F.floor(F.col(f"box.{hi}") / cell))
    at = at.withColumn("i", F.explode(reach("x1", "x2"))).withColumn("j", F.explode(reach("y1", "y2")))
    key = ["frame", "grid", "i", "j"]
    b = at.select(*key, F.col("rank").alias("worse"), F.col("box").alias("b"), F.col("level").alias("level_b"))
    pair = at.select(*key, F.col("rank").alias("better"), F.col("box").alias("a"), "level").join(b.hint("merge"), key)
    # Each pair counts in one cell only: at the larger level, where its overlap begins.
    once = (
        (F.col("grid") == F.greatest("level", "level_b"))
        & (F.col("i") == F.floor(F.greatest("a.x1", "b.x1") / cell))
        & (F.col("j") == F.floor(F.greatest("a.y1", "b.y1") / cell))
    )
    return pair.where((F.col("better") < F.col("worse")) & once & (box_iou("a", "b") > iou_max)).select("frame", "better", "worse")


def dropped_by_greedy(pairs: DataFrame) -> DataFrame:
    """(frame, rank) that greedy selection drops, from pairs (frame, better, worse)."""
    left = durable(pairs, "suppress-pairs")
    out = None
    while not left.isEmpty():
        # A round decides at least the best undecided box of every frame.
        kept = left.select("frame", F.col("better").alias("rank")).join(
            left.select("frame", F.col("worse").alias("rank")).distinct(), ["frame", "rank"], "left_anti"
        ).distinct()
        lost = left.join(kept.withColumnRenamed("rank", "better"), ["frame", "better"], "left_semi")
        lost = durable(lost.select("frame", F.col("worse").alias("rank")).distinct(), "suppress-dropped")
        out = lost if out is None else out.unionByName(lost)
        for side in ("worse", "better"):
            left = left.join(lost.withColumnRenamed("rank", side), ["frame", side], "left_anti")
        left = durable(left.select("frame", "better", "worse"), "suppress-pairs")
    return out if out is not None else pairs.select("frame", F.col("better").alias("rank"))


def _kept_of_frame(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, solid: np.ndarray, iou_max: float) -> np.ndarray:
    """Greedy selection inside one frame, best first; the arithmetic is that of ``box_iou``."""
    free = np.ones(len(x1), bool)
    area = np.maximum(x2 - x1, 0.0) * np.maximum(y2 - y1, 0.0)

    def over(i, k):
        wide = np.maximum(np.minimum(x2[i], x2[k]) - np.maximum(x1[i], x1[k]), 0.0)
        inter = wide * np.maximum(np.minimum(y2[i], y2[k]) - np.maximum(y1[i], y1[k]), 0.0)
        return inter / (area[i] + area[k] - inter + 1e-9) > iou_max

    if len(x1) <= ALL_PAIRS:
        every = np.arange(len(x1))
        clash = over(every[:, None], every[None, :]) & solid[:, None] & solid
        for i in np.flatnonzero(solid):
            if free[i]:
                free[i + 1 :] &= ~clash[i, i + 1 :]
        return free
    for i in np.flatnonzero(solid):
        if free[i]:
            k = i + 1 + np.flatnonzero((free & solid)[i + 1 :])
            free[k[over(i, k)]] = False
    return free


def _selected(iou_max: float, frame_boxes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kept boxes with their lane, from rows ordered by frame and rank; boxes of large frames go on without a lane."""

    def kept(table: pa.Table) -> pa.Table:
        starts = np.flatnonzero(changes(table, ["frame"]))
        ends = np.append(starts[1:], len(table))
        if (table["rank"].to_numpy() != np.arange(len(table)) - np.repeat(starts, ends - starts) + 1).any() or (
            table["_n"].to_numpy()[starts] != ends - starts
        ).any():
            raise RuntimeError("the boxes of a frame did not arrive together in their order")
        x1, y1, x2, y2 = (table[c].to_numpy().astype(float) for c in BOX)
        # Boxes without a frame overlap nothing, as in the joins.
        solid = (x2 > x1) & (y2 > y1) & table["frame"].is_valid().to_numpy()
        free = np.zeros(len(table), bool)
        lane = np.zeros(len(table), np.int64)
        for a, b in zip(starts, ends):
            free[a:b] = _kept_of_frame(x1[a:b], y1[a:b], x2[a:b], y2[a:b], solid[a:b], iou_max)
            lane[a:b] = np.cumsum(free[a:b]) - 1
        return table.append_column("lane", pa.array(lane)).filter(pa.array(free))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Groups(["frame"])
        columns = ["frame", "det", "lane", "conf", *BOX, "rank"]
        for batch in batches:
            table = pa.Table.from_batches([batch])
            few = pc.less_equal(table["_n"], frame_boxes)
            many = table.filter(pc.invert(few))
            if len(many):
                yield from many.append_column("lane", pa.nulls(len(many), pa.int64())).select(columns).to_batches()
            for whole in frames.push(table.filter(few)):
                yield from kept(whole).select(columns).to_batches()
        for whole in frames.rest():
            yield from kept(whole).select(columns).to_batches()

    return run


def suppress_boxes(
    boxes: DataFrame, conf_min: float, iou_max: float, candidates: int | None = None, lanes: int | None = None,
    frame_boxes: int = FRAME_BOXES,
) -> DataFrame:
    """Best boxes per frame without overlaps: (frame, det, lane, conf, x1, y1, x2, y2).

    ``candidates`` and ``lanes`` limit what competes and what is returned; none
    by default. ``overflow`` counts what such limits leave out. Frames of up to
    ``frame_boxes`` competing boxes are solved in one task, larger ones by
    rounds over all of them; same answer.
    """
    live = boxes.where(F.col("conf") > conf_min)
    best = Window.partitionBy("frame").orderBy(F.desc("conf"), "det")
    if candidates is not None:
        live = tr.top_k(live, ["frame"], "conf", "det", candidates).drop("rank")
    n = F.count(F.lit(1)).over(Window.partitionBy("frame"))
    ranked = live.select("frame", "det", "conf", *BOX, F.row_number().over(best).alias("rank"), n.alias("_n"))
    columns = ["frame", "det", "lane", "conf", *BOX]
    schema = ranked.select("frame", "det", F.lit(None).cast("long").alias("lane"), "conf", *BOX, "rank").schema
    # Boxes leave the window by frame and rank and are selected from right there, without another shuffle.
    solved = durable(ranked.mapInArrow(_selected(iou_max, frame_boxes), schema), "suppress-solved")
    kept = solved.where("lane IS NOT NULL").select(*columns)
    many = solved.where("lane IS NULL").drop("lane")
    if not many.isEmpty():
        lost = dropped_by_greedy(overlapping_boxes(many, iou_max))
        left = many.join(lost, ["frame", "rank"], "left_anti")
        left = left.withColumn("lane", F.row_number().over(best).cast("long") - 1)
        kept = kept.unionByName(durable(left.select(*columns), "suppress-left"))
    if lanes is not None:
        kept = kept.where(F.col("lane") < lanes)
    return kept.select(*columns)


def overflow(boxes: DataFrame, kept: DataFrame, conf_min: float, candidates: int, lanes: int) -> DataFrame:
    """(frame, n_confident, n_kept, over_candidates, over_lanes): what limits of these sizes would leave out.

    ``kept`` are the boxes of an unlimited suppression.
    """
    n = boxes.groupBy("frame").agg(F.count_if(F.col("conf") > conf_min).alias("n_confident"))
    k = kept.groupBy("frame").agg(F.count(F.lit(1)).alias("n_kept"))
    over = lambda c, most: F.greatest(F.col(c) - most, F.lit(0))
    return n.join(k, "frame", "left").na.fill(0, ["n_kept"]).select(
        "frame", "n_confident", "n_kept",
        over("n_confident", candidates).alias("over_candidates"), over("n_kept", lanes).alias("over_lanes"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(frame, lane, n, runs) for stretches of rows of one mask: how many rows, and first and last of adjacent cells."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        new = changes(table, ["frame", "lane"])
        at = np.flatnonzero(new)
        known = table["cell"].is_valid().to_numpy()
        cell = table["cell"].fill_null(0).to_numpy()[known]
        piece = (np.cumsum(new) - 1)[known]
        first = np.ones(len(cell), bool)
        first[1:] = (np.diff(piece) != 0) | (np.diff(cell) != 1)
        last = np.append(first[1:], True)[: len(cell)]
        ends = np.column_stack([cell[first], cell[last]]).ravel()
        offsets = np.append(0, 2 * np.cumsum(np.bincount(piece[first], minlength=len(at))))
        yield pa.RecordBatch.from_arrays(
            [
                *(table[c].combine_chunks().take(pa.array(at)) for c in ("frame", "lane")),
                pa.array(np.diff(np.append(at, len(table)))),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends, pa.int64())),
            ],
            names=["frame", "lane", "n", "runs"],
        )


def _shared(mask: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """Cells that each two of ``n`` masks share."""
    if not len(cell):
        return np.zeros((n, n))
    low, wide = cell.min(), int(cell.max()) - int(cell.min()) + 1
    if wide <= BLOCK:
        seen = np.bincount(cell - low, minlength=wide) > 0
        at, wide = (np.cumsum(seen) - 1)[cell - low], int(seen.sum())
    else:
        at = np.unique(cell, return_inverse=True)[1]
        wide = int(at.max()) + 1
    out = np.zeros((n, n))
    step = max(BLOCK // n, 1)
    if wide > step:
        order = np.argsort(at, kind="stable")
        mask, at = mask[order], at[order]
    for a in range(0, wide, step):
        here = slice(*np.searchsorted(at, (a, a + step))) if wide > step else slice(None)
        w = min(step, wide - a)
        held = np.bincount(mask[here] * w + at[here] - a, minlength=n * w).reshape(n, w).astype(float)
        out += held @ held.T
    return out


def _originals(area_min: int, iou_max: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lanes that stay, from rows ordered by frame: lanes (``n`` is null) and runs of their masks."""

    def kept(table: pa.Table) -> pa.Table:
        is_lane = table["n"].is_null().to_numpy()
        lane = table["lane"].combine_chunks().dictionary_encode().indices.to_numpy()
        n = table["n"].fill_null(0).to_numpy()
        conf = table["conf"].cast(pa.float64())
        known, conf = conf.is_valid().to_numpy(), conf.fill_null(0.0).to_numpy()
        runs = table["runs"].combine_chunks()
        sizes = np.diff(runs.offsets.to_numpy())
        begin = np.append(0, np.cumsum(sizes))
        ends = runs.flatten().to_numpy()
        starts = np.flatnonzero(changes(table, ["frame"]))
        keep, area = np.zeros(len(table), bool), np.zeros(len(table), np.int64)
        for a, b in zip(starts, np.append(starts[1:], len(table))):
            code = np.unique(lane[a:b], return_inverse=True)[1]
            size = np.bincount(code, weights=n[a:b]).astype(np.int64)
            mine = np.flatnonzero(is_lane[a:b] & (size[code] >= max(area_min, 1)))
            if not len(mine):
                continue
            # Masks without a lane, or too small, hide nothing.
            live = np.full(len(size), -1)
            live[code[mine]] = 1
            live[live > 0] = np.arange(np.count_nonzero(live > 0))
            lo, hi = ends[begin[a] : begin[b]].reshape(-1, 2).T
            of = np.repeat(live[code], sizes[a:b] // 2)
            lo, hi, of = lo[of >= 0], hi[of >= 0], of[of >= 0]
            long = hi - lo + 1
            cell = np.arange(long.sum()) + np.repeat(lo - np.append(0, np.cumsum(long)[:-1]), long)
            shared = _shared(np.repeat(of, long), cell, int(live.max()) + 1)
            who, size = live[code[mine]], size[code[mine]].astype(float)
            both = shared[np.ix_(who, who)]
            c, ok = conf[a:b][mine], known[a:b][mine]
            # A number is below one that is none, as in the joins.
            better = ((c[None, :] > c[:, None]) | (np.isnan(c)[None, :] & ~np.isnan(c)[:, None])) & ok & ok[:, None]
            alike = np.minimum(size[:, None], size) > np.maximum(size[:, None], size) * iou_max
            copy = better & alike & (both > 0) & (both / np.maximum(size[:, None] + size - both, 1.0) > iou_max)
            gone = np.isin(who, who[copy.any(axis=1)])
            keep[a + mine] = ~gone
            area[a + mine] = size
        return table.select(["frame", "lane", "conf"]).append_column("area", pa.array(area)).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = Groups(["frame"])
        for batch in batches:
            for whole in frames.push(pa.Table.from_batches([batch])):
                yield from kept(whole).to_batches()
        for whole in frames.rest():
            yield from kept(whole).to_batches()

    return run


def dedup_masks(
    lanes: DataFrame, cells: DataFrame, area_min: int, iou_max: float, frame_cells: int = FRAME_CELLS, frame_masks: int = FRAME_MASKS
) -> DataFrame:
    """Lanes whose mask is large enough and not a copy of a more confident one.

    lanes (frame, lane, conf), cells (frame, lane, cell). A mask goes if any
    live, more confident mask shares more than ``iou_max`` of their union;
    masks of equal confidence stay. Frames of up to ``frame_cells`` cells and
    ``frame_masks`` masks are compared in one task, larger ones by joins; same
    answer.
    """
    lanes = lanes.select("frame", "lane", "conf").where("frame IS NOT NULL AND lane IS NOT NULL")
    cells = cells.select("frame", "lane", F.col("cell").cast("long").alias("cell")).where("frame IS NOT NULL AND lane IS NOT NULL")
    many = lambda df, most: df.groupBy("frame").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("frame")
    large = durable(many(cells, frame_cells).union(many(lanes, frame_masks)).distinct(), "masks-large")
    if large.isEmpty():
        return _dedup_by_frame(lanes, cells, area_min, iou_max)
    of = lambda df, how: df.join(large.hint("merge"), "frame", how)
    few = _dedup_by_frame(of(lanes, "left_anti"), of(cells, "left_anti"), area_min, iou_max)
    return few.unionByName(_dedup_by_joins(of(lanes, "left_semi"), of(cells, "left_semi"), area_min, iou_max))


def _dedup_by_frame(lanes: DataFrame, cells: DataFrame, area_min: int, iou_max: float) -> DataFrame:
    """Runs of cells and lanes go to their frame in one shuffle."""
    runs = cells.mapInArrow(_runs, cells.select("frame", "lane", F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("runs")).schema)
    rows = lanes.unionByName(runs, allowMissingColumns=True).repartition("frame").sortWithinPartitions("frame")
    schema = lanes.withColumn("area", F.lit(0).cast("long")).schema
    return rows.mapInArrow(_originals(area_min, iou_max), schema)


def _dedup_by_joins(lanes: DataFrame, cells: DataFrame, area_min: int, iou_max: float) -> DataFrame:
    """Only masks whose areas allow such a share meet on their cells."""
    area = cells.groupBy("frame", "lane").agg(F.count(F.lit(1)).alias("area")).where(F.col("area") >= area_min)
    live = durable(lanes.join(area, ["frame", "lane"]), "masks-live")
    mine = cells.join(live.hint("merge"), ["frame", "lane"])
    other = mine.select("frame", "cell", F.col("lane").alias("_by"), F.col("conf").alias("_conf"), F.col("area").alias("_area"))
    alike = (F.col("_conf") > F.col("conf")) & (F.least("area", "_area") > F.greatest("area", "_area") * iou_max)
    shared = mine.join(other.hint("merge"), ["frame", "cell"]).where(alike).groupBy("frame", "lane", "area", "_by", "_area").agg(
        F.count(F.lit(1)).alias("_n")
    )
    union = F.greatest(F.col("area") + F.col("_area") - F.col("_n"), F.lit(1))
    copies = shared.where(F.col("_n") / union > iou_max).select("frame", "lane").distinct()
    return live.join(copies, ["frame", "lane"], "left_anti").select("frame", "lane", "conf", "area")
