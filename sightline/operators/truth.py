"""Building and checking ground truth: objects, tracklets, merges, votes, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators import rules
from sightline.operators import voxels as vx
from sightline.operators.components import connected_components
from sightline.operators.grouped import Groups, changes
from sightline.operators.ordered import global_row_number
from sightline.session import durable

#: Points of a key that one task links.
KEY_POINTS = 1 << 18
#: The neighbours of a grid cell, one of each two that are opposite.
AHEAD = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]


# ------------------------------------------------------------------- objects

def object_rollup(px: DataFrame, vox: DataFrame, promote_px: int) -> DataFrame:
    """Pixel facts (object, frame, n_px) and voxel facts (object, x, y, z) per object."""
    per_frame = px.groupBy("object", "frame").agg(F.sum("n_px").alias("n_px"))
    p = per_frame.groupBy("object").agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.count(F.lit(1)).alias("n_frames_seen"),
        F.count_if(F.col("n_px") >= promote_px).alias("n_frames_promoting"),
        F.max("n_px").alias("max_px"),
        F.sum("n_px").alias("total_px"),
    )
    return p.join(vx.extents(vox, ["object"]), "object", "left")


def promoted(rollup: DataFrame, min_frames: int) -> DataFrame:
    return rollup.where(F.col("n_frames_promoting") >= min_frames)


def number_objects(rollup: DataFrame) -> DataFrame:
    """Object numbers from 1 in order of (first frame, colour, root)."""
    return global_row_number(rollup, ["first_frame", "colour", "object"], "gt_object_id")


def segment_rollup(px: DataFrame, near_m: float, stride: int) -> DataFrame:
    """Per (frame, object): pixels, depth facts, far flag."""
    return px.groupBy("frame", "object").agg(
        F.count(F.lit(1)).alias("n_points_strided"),
        (F.count(F.lit(1)) * stride * stride).alias("n_pixels"),
        F.avg("depth").alias("mean_depth_m"),
        (~F.bool_or(F.col("depth") <= near_m)).alias("is_far"),
    )


def tracklet_rollup(obs: DataFrame, max_range: float) -> DataFrame:
    """Two-level distance facts: mean of the per-frame means, points in and out of range."""
    near = F.col("dist") <= max_range
    per_frame = obs.groupBy("tracklet_id", "frame").agg(
        F.count_if(near).alias("_n"),
        F.count_if(~near).alias("_far"),
        F.min(F.when(near, F.col("dist"))).alias("_min"),
        F.avg(F.when(near, F.col("dist"))).alias("_mean"),
    )
    return per_frame.groupBy("tracklet_id").agg(
        F.sum("_n").alias("n_raw"),
        F.sum("_far").alias("n_far"),
        F.min("_min").alias("dist_min_m"),
        F.avg("_mean").alias("dist_mean_m"),
    )


def mean_embedding(rows: DataFrame, keys: Sequence[str], vector: str, dims: int) -> DataFrame:
    """Mean vector scaled to unit length; dimensions are summed map-side, not collected."""
    keys = list(keys)
    sums = [F.sum(F.element_at(vector, i + 1).cast("double")).alias(f"_{i}") for i in range(dims)]
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_embedded"), *sums)
    mean = F.array(*[F.col(f"_{i}") / F.col("n_embedded") for i in range(dims)])
    g = g.select(*keys, "n_embedded", mean.alias("_m"))
    n = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda a, x: a + x * x))
    return g.withColumn("_l", F.greatest(n, F.lit(1e-12))).select(
        *keys, "n_embedded", F.transform("_m", lambda x: x / F.col("_l")).alias("embedding")
    )


# ------------------------------------------------------------ extent filters

def dense_top(values: DataFrame, value: str, width: float, share: float, below: float) -> DataFrame:
    """Lower edge of the highest histogram bin holding ``share`` of the fullest bin, minus ``below``."""
    low = values.agg(F.min(value).alias("_lo")).withColumn("_k", F.lit(0))
    b = values.withColumn("_k", F.lit(0)).join(F.broadcast(low), "_k")  # one row
    bins = b.groupBy("_lo", F.floor((F.col(value) - F.col("_lo")) / width).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    bins = bins.withColumn("_k", F.lit(0))
    top = bins.groupBy("_k").agg(F.max("_c").alias("_m"))
    return (
        bins.join(top, "_k").where(F.col("_c") >= share * F.col("_m"))
        .agg(F.max(F.col("_lo") + F.col("_b") * width).alias("cut"))
        .select((F.col("cut") - below).alias("cut"))
    )


def drop_reason(min_extent: float, ceiling: Column, margin: float) -> Column:
    """Why a tracklet is filtered out, from its bounding box; NULL keeps it."""
    thin = None
    for c in vx.XYZ:
        t = (F.col(f"max_{c}") - F.col(f"min_{c}")) <= min_extent
        thin = t if thin is None else thin | t
    return F.when(thin, "thin").when(F.col("min_z") >= ceiling - margin, "ceiling")


# -------------------------------------------------------------------- merging

def merge_targets(vox: DataFrame, within: Sequence[str], threshold: float) -> DataFrame:
    """For each instance the other instance of its colour it touches most, if above the threshold.

    The largest instance of a colour stays; ties go to the larger, then lower, target.
    """
    within = list(within)
    size = vox.groupBy(*within, "instance").agg(F.count(F.lit(1)).alias("_n"))
    largest = size.groupBy(*within).agg(F.min_by("instance", F.struct(-F.col("_n"), F.col("instance"))).alias("_top"))
    share = vx.touch_share(vox, "instance", within, vx.NEAR_STEPS).join(
        size.select(*within, F.col("instance").alias("b"), F.col("_n").alias("_nb")), [*within, "b"]
    )
    best = share.groupBy(*within, "a").agg(
        F.min(F.struct((-F.col("n_touch")).alias("n"), (-F.col("_nb")).alias("s"), F.col("b"), F.col("share"))).alias("_b")
    )
    return (
        best.where(F.col("_b.share") >= threshold)
        .join(largest, within)
        .where(F.col("a") != F.col("_top"))
        .select(F.col("a").alias("instance"), F.col("_b.b").alias("target"), F.col("_b.share").alias("share"))
    )


def merge_instances(vox: DataFrame, within: Sequence[str], threshold: float, rounds: int | None = None) -> DataFrame:
    """Merge touching instances of one colour to a fixpoint; (instance, root) with root = smallest member.

    Every round measures all touching shares at once, merges along the best
    targets, and starts over with the merged sets until nothing merges. A
    round leaves fewer instances, so this ends; with ``rounds`` given, more is
    an error, never an unfinished result.
    """
    current = durable(vox.select(*within, "instance", "voxel").distinct(), "merge-voxels")
    roots = durable(current.select("instance", F.col("instance").alias("root")).distinct(), "merge-roots")
    for done in count():
        moves = durable(merge_targets(current, within, threshold).select("instance", "target"), "merge-moves")
        if moves.isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"instances still merge after {rounds} rounds")
        comp = connected_components(moves, "instance", "target")
        step = comp.select(F.col("v").alias("instance"), F.col("component").alias("_r"))
        current = durable(
            current.join(step, "instance", "left")
            .select(*within, F.coalesce("_r", "instance").alias("instance"), "voxel").distinct(),
            "merge-voxels",
        )
        roots = durable(
            roots.join(step.withColumnRenamed("instance", "root"), "root", "left")
            .select("instance", F.coalesce("_r", "root").alias("root")),
            "merge-roots",
        )
    return roots


def scale_edges(points: DataFrame, keys: Sequence[str], key_points: int = KEY_POINTS) -> DataFrame:
    """Edges that link points (keys, point_id, x, y, z, radius) at doubling grid sizes.

    Grid sizes of a key start at its smallest radius and double up to its
    largest; a point takes part in a grid while half the cell is within its
    radius. A point is linked to the lowest point of its cell, and that point
    to the lowest points of the cells around, so edges stay linear in points.
    Keys of up to ``key_points`` points are linked in one task, larger ones by
    joins; same edges. An edge is there once if ids are of one key only.
    """
    keys = list(keys)
    points = points.select(*keys, "point_id", *vx.XYZ, "radius")
    for c in points.columns:
        points = points.where(F.col(c).isNotNull())
    if dict(points.dtypes)["point_id"] != "bigint":
        return _scale_edges_by_joins(points, keys)
    sized = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = durable(sized.where(F.col("_n") > key_points).select(*keys), "scale-large")
    some = not large.isEmpty()
    few = points.join(large.hint("merge"), keys, "left_anti") if some else points
    few = few.withColumns({c: F.col(c).cast("double") for c in (*vx.XYZ, "radius")}).repartition(*keys).sortWithinPartitions(*keys)
    out = few.mapInArrow(_scale_links(keys), "a long, b long")
    if some:
        out = out.union(_scale_edges_by_joins(points.join(large.hint("merge"), keys, "left_semi"), keys))
    return out


def _scale_links(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges of whole keys, from points ordered by key; the arithmetic is that of the joins."""

    def links(table: pa.Table) -> pa.RecordBatch:
        starts = np.flatnonzero(changes(table, keys))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(table))))
        ident = table["point_id"].to_numpy()
        xyz = [table[c].to_numpy() for c in vx.XYZ]
        radius = table["radius"].to_numpy()
        small = np.minimum.reduceat(radius, starts)
        if (small <= 0).any():
            raise ValueError("a radius must be positive")
        top = np.maximum(np.ceil(np.log(np.maximum.reduceat(radius, starts) / small) / np.log(2.0) - 1e-12), 0)
        found = []
        for level in range(int(top.max()) + 1):
            cell = (small * 2.0**level)[group]
            at = np.flatnonzero((level <= top[group]) & (radius >= cell / 2))
            if not len(at):
                continue
            g, first = np.unique(group[at], return_inverse=True)[1], np.flatnonzero(np.diff(group[at], prepend=-1))
            index = [np.floor((x[at] - np.fmin.reduceat(x[at], first)[g]) / cell[at]) for x in xyz]
            # What is no number is in the first cell, as in the joins.
            index = [np.where(np.isnan(i), 0, np.clip(i, -(2.0**61), 2.0**61)).astype(np.int64) for i in index]
            found += _cell_links(ident[at], g, index)
        a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        # Ids of several keys are apart, so an edge is there twice only if two grids have it.
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        once = np.ones(len(a), bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Groups(keys)
        for batch in batches:
            for whole in groups.push(pa.Table.from_batches([batch])):
                yield links(whole)
        for whole in groups.rest():
            yield links(whole)

    return run


def _cell_links(ident: np.ndarray, group: np.ndarray, index: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges from points to the lowest point of their cell, and from there to those of the cells around."""
    # Cells count from 1, so that one step back is a number as well.
    wide = [int(i.max()) + 3 for i in index]
    total = int(group.max()) + 1
    for w in wide:
        total *= w
    if total < 1 << 62:
        number = lambda g, i: ((g * wide[0] + i[0] + 1) * wide[1] + i[1] + 1) * wide[2] + i[2] + 1
        cells, first, of = np.unique(number(group, index), return_index=True, return_inverse=True)
    else:
        rows, first, of = np.unique(np.column_stack([group, *index]), axis=0, return_index=True, return_inverse=True)
        of = of.ravel()
    rep = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(rep, of, ident)
    out = [(ident, rep[of])]
    g, at = group[first], [i[first] for i in index]
    for step in AHEAD:
        moved = [i + k for i, k in zip(at, step)]
        if total < 1 << 62:
            to = number(g, moved)
            place = np.minimum(np.searchsorted(cells, to), len(cells) - 1)
            hit = cells[place] == to
        else:
            both = np.unique(np.vstack([rows, np.column_stack([g, *moved])]), axis=0, return_inverse=True)[1].ravel()
            where = np.full(int(both.max()) + 1, -1)
            where[both[: len(rows)]] = np.arange(len(rows))
            place = where[both[len(rows) :]]
            hit = place >= 0
        out.append((rep[hit], rep[place[hit]]))
    return out


def _scale_edges_by_joins(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points often lie in a small file, whose size says little about their rows here, so no join is left to a broadcast."""
    span = points.groupBy(*keys).agg(F.min("radius").alias("_r0"), F.max("radius").alias("_r1"))
    top = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_r1") / F.col("_r0")) - 1e-12)).cast("int")
    el = (
        points.join(span.hint("merge"), keys)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), top)))
        .withColumn("_cell", F.col("_r0") * F.pow(F.lit(2.0), F.col("_k")))
        .where(F.col("radius") >= F.col("_cell") / 2)
    )
    grid = [*keys, "_k"]
    lows = el.groupBy(*grid).agg(*[F.min(c).alias(f"_{c}0") for c in vx.XYZ])
    idx = {f"i{c}": F.floor((F.col(c) - F.col(f"_{c}0")) / F.col("_cell")).cast("long") for c in vx.XYZ}
    el = el.join(lows.hint("merge"), grid).withColumns(idx).select(*grid, "point_id", *idx)
    reps = el.groupBy(*grid, *idx).agg(F.min("point_id").alias("rep"))
    inside = el.join(reps.hint("merge"), [*grid, *idx]).select(F.col("point_id").alias("a"), F.col("rep").alias("b"))
    offsets = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(s, "ijk")]) for s in AHEAD])
    moved = reps.select(*grid, *idx, F.col("rep").alias("a"), F.explode(offsets).alias("_o")).select(
        *grid, "a", *[(F.col(f"i{c}") + F.col(f"_o.{n}")).alias(f"i{c}") for c, n in zip(vx.XYZ, "ijk")]
    )
    across = moved.join(reps.hint("merge"), [*grid, *idx]).select("a", F.col("rep").alias("b"))
    return inside.union(across).distinct()


def order_components(points: DataFrame, comp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank components per key: largest first, then smallest (x, y, z)."""
    j = points.join(comp.withColumnRenamed("v", "point_id"), "point_id")
    s = j.groupBy(*keys, "component").agg(
        F.count(F.lit(1)).alias("n_points"), F.min(F.struct(*vx.XYZ)).alias("_p")
    )
    ranked = s.withColumn("_neg", -F.col("n_points"))
    num = global_row_number(ranked, [*keys, "_neg", "_p"], "_row")
    first = num.groupBy(*keys).agg(F.min("_row").alias("_first"))
    return num.join(first, list(keys)).select(
        *keys, "component", "n_points", (F.col("_row") - F.col("_first")).alias("rank")
    )


# --------------------------------------------------------------------- labels

def component_vote(votes: DataFrame, component: Sequence[str], dominant: float) -> DataFrame:
    """Winner of each component, its support share and whether it dominates."""
    component = list(component)
    n = votes.groupBy(*component, "label").agg(F.count(F.lit(1)).alias("_c"))
    return n.groupBy(*component).agg(
        F.sum("_c").alias("n_votes"), F.max_by("label", F.struct("_c", -F.col("label"))).alias("winner"),
        F.max("_c").alias("n_winner"),
    ).withColumn("support", F.col("n_winner") / F.col("n_votes")).withColumn(
        "dominates", F.col("support") >= dominant
    )


def visible_pixels(samples: DataFrame, keys: Sequence[str], in_crop: Column, stride: int) -> DataFrame:
    """Pixels per key, full and inside the crop; samples stand for stride x stride pixels."""
    area = stride * stride
    g = samples.groupBy(*keys).agg(
        (F.count(F.lit(1)) * area).alias("px_full"), (F.count_if(in_crop) * area).alias("px_crop")
    )
    return g.where("px_full > 0")


def occlusion(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Occluded share from (own label?, depth, expected z) samples."""
    tol = F.greatest(F.lit(0.05), F.lit(0.03) * F.col("z"))
    visible = F.col("same") & (F.col("depth") > 0)
    hidden = ~F.col("same") & (F.col("depth") > 0) & (F.col("depth") < F.col("z") - tol)
    g = samples.groupBy(*keys).agg(F.count_if(visible).alias("n_visible"), F.count_if(hidden).alias("n_hidden"))
    return g.withColumn(
        "occ", F.coalesce(rules.ratio(F.col("n_hidden"), F.col("n_hidden") + F.col("n_visible")), F.lit(0.0))
    )


# ------------------------------------------------------------------ reporting

def binned_rate(rows: DataFrame, value: str, hit: Column, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Rate per half-open bin; empty bins stay with a NULL rate."""
    bin_of = F.coalesce(
        *[
            F.when((F.col(value) >= lo) & (F.col(value) < hi), F.lit(b))
            for lo, hi, b in zip(edges[:-1], edges[1:], labels)
        ]
    )
    got = rows.groupBy(bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit.cast("int")).alias("rate")
    )
    names = rows.sparkSession.range(len(labels)).select(
        F.element_at(F.array(*[F.lit(b) for b in labels]), (F.col("id") + 1).cast("int")).alias("bin")
    )
    return names.join(got, "bin", "left").na.fill(0, ["n"])


def cumulative_levels(rows: DataFrame, level: str, hit: Column) -> DataFrame:
    """Rate per difficulty level; each level holds the easier ones too."""
    names = rules.LEVELS[:3]
    spread = rows.where(F.col(level).between(0, 2)).withColumn("_l", F.explode(F.sequence(F.col(level), F.lit(2))))
    pick = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_l").cast("int") + 1)
    return spread.groupBy(pick.alias("level_name")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_hit"), F.avg(hit.cast("int")).alias("rate")
    )


def populations(rows: DataFrame, tests: dict[str, Column], hit: Column) -> DataFrame:
    """Numerator, denominator and rate of several populations in one pass."""
    aggs = []
    for name, test in tests.items():
        aggs += [F.count_if(test).alias(f"{name}_n"), F.count_if(test & hit).alias(f"{name}_k")]
    wide = rows.agg(*aggs)
    pairs = F.array(
        *[F.struct(F.lit(n).alias("population"), F.col(f"{n}_n").alias("n"), F.col(f"{n}_k").alias("k")) for n in tests]
    )
    return wide.select(F.explode(pairs).alias("_p")).select("_p.*").withColumn(
        "rate", rules.ratio(F.col("k"), F.col("n"))
    )


def presence_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of both / only one and the Jaccard disagreement of two sets of keys."""
    j = a.select(*keys).distinct().withColumn("_a", F.lit(True)).join(
        b.select(*keys).distinct().withColumn("_b", F.lit(True)), list(keys), "full"
    )
    c = j.agg(
        F.count(F.lit(1)).alias("n_union"),
        F.count_if(F.col("_a") & F.col("_b")).alias("n_both"),
        F.count_if(F.col("_b").isNull()).alias("n_only_a"),
        F.count_if(F.col("_a").isNull()).alias("n_only_b"),
    )
    return c.withColumn("disagreement", rules.ratio(F.col("n_union") - F.col("n_both"), F.col("n_union")))


def top_k(rows: DataFrame, keys: Sequence[str], score: str, tie: str, k: int, salts: int = 64) -> DataFrame:
    """The k best rows per key: first inside salted parts of a key, then among the survivors.

    The rank filter also lets Spark cut each key to k rows before the shuffle.
    """
    order = [F.col(score).desc(), F.col(tie).asc()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
    part = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    part = part.where(F.col("_r") <= k).drop("_salt")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col("rank") <= k
    ).drop("_r")


def seeded_sample(rows: DataFrame, keys: Sequence[str], ident: str, n: int, seed: int) -> DataFrame:
    """n rows per key without replacement; the same seed gives the same rows."""
    mixed = rows.withColumn("_score", -F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), ident)), 1, 12), 16, 10).cast("long"))
    return top_k(mixed, keys, "_score", ident, n).drop("_score", "rank")


def stride_sample(numbered: DataFrame, position: str, total: Column, limit: int) -> DataFrame:
    """Every (total // limit + 1)-th row by its 0-based position when there are more than ``limit``."""
    step = F.when(total > limit, F.floor(total / limit) + 1).otherwise(1)
    return numbered.where(F.col(position) % step == 0)
