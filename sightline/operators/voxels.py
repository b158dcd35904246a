"""Voxel sets: occupancy, overlap, downsampling, neighbourhood shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as g

XYZ = ("x", "y", "z")

# The cell itself with its six face neighbours, and the steps
# shorter than 1.5 cells (self, faces, edges).
FACE_STEPS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
NEAR_STEPS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if i * i + j * j + k * k < 2.25]


def occupancy(points: DataFrame, keys: Sequence[str], size: float, mode: str = "clip") -> DataFrame:
    """Distinct (keys, voxel)."""
    key = g.voxel_key(*[F.col(c) for c in XYZ], size, mode)
    return points.select(*keys, key.alias("voxel")).distinct()


def pair_iou(vox: DataFrame, cloud: str, pairs: DataFrame) -> DataFrame:
    """Voxel IoU of each listed pair (a, b); 1 when both are empty.

    Work is proportional to the voxels of the listed clouds: a voxel of ``a``
    is looked up in ``b`` only, never against every cloud that holds it.
    """
    va = vox.select(F.col(cloud).alias("a"), "voxel")
    vb = vox.select(F.col(cloud).alias("b"), "voxel")
    shared = pairs.select("a", "b").join(va, "a").join(vb, ["b", "voxel"], "left_semi")
    shared = shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))
    sizes = vox.groupBy(F.col(cloud).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        pairs.join(shared, ["a", "b"], "left")
        .join(sizes.select(F.col("_c").alias("a"), F.col("_n").alias("n_a")), "a", "left")
        .join(sizes.select(F.col("_c").alias("b"), F.col("_n").alias("n_b")), "b", "left")
        .na.fill(0, ["n_shared", "n_a", "n_b"])
        .withColumn("_u", F.col("n_a") + F.col("n_b") - F.col("n_shared"))
        .withColumn("iou", F.when(F.col("_u") > 0, F.col("n_shared") / F.col("_u")).otherwise(F.lit(1.0)))
        .drop("_u")
    )


def downsample(points: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Mean point per cell of a grid that starts half a cell below each cloud's minimum."""
    keys = list(keys)
    lows = points.groupBy(*keys).agg(*[F.min(c).alias(f"_{c}0") for c in XYZ])
    cells = points.join(lows, keys)
    for c in XYZ:
        cells = cells.withColumn(f"i{c}", g.cell_index(F.col(c) - (F.col(f"_{c}0") - F.lit(size / 2)), size))
    return cells.groupBy(*keys, "ix", "iy", "iz").agg(
        *[F.avg(c).alias(c) for c in XYZ], F.count(F.lit(1)).alias("n_points")
    )


def touching(vox: DataFrame, cloud: str, within: Sequence[str], steps: Sequence[tuple[int, int, int]]) -> DataFrame:
    """For ordered pairs of clouds: voxels of ``a`` with a voxel of ``b`` at one of ``steps``."""
    moved = F.explode(F.array(*[g.shift_key(F.col("voxel"), *s) for s in steps]))
    a = vox.select(*within, F.col(cloud).alias("a"), "voxel", moved.alias("probe"))
    b = vox.select(*within, F.col(cloud).alias("b"), F.col("voxel").alias("probe"))
    hit = a.join(b, [*within, "probe"]).where(F.col("a") != F.col("b")).select(*within, "a", "b", "voxel").distinct()
    return hit.groupBy(*within, "a", "b").agg(F.count(F.lit(1)).alias("n_touch"))


def touch_share(vox: DataFrame, cloud: str, within: Sequence[str], steps: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Share of the voxels of ``a`` that touch ``b``."""
    sizes = vox.groupBy(*within, F.col(cloud).alias("a")).agg(F.count(F.lit(1)).alias("n_a"))
    return touching(vox, cloud, within, steps).join(sizes, [*within, "a"]).withColumn(
        "share", F.col("n_touch") / F.col("n_a")
    )


def exact_share(probe: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of probe voxels present in the reference set, per key."""
    keys = list(keys)
    hit = reference.select(*keys, "voxel", F.lit(1).alias("_hit")).distinct()
    return (
        probe.join(hit, [*keys, "voxel"], "left")
        .groupBy(*keys)
        .agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("exact_share"), F.count(F.lit(1)).alias("n_voxels"))
    )


def mean_colour(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean colour per voxel, rounded half to even."""
    return rows.groupBy(*keys).agg(*[F.rint(F.avg(c)).cast("int").alias(c) for c in ("r", "g", "b")])


def extents(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box, centroid and degenerate-axis flag inputs per cloud."""
    aggs: list[Column] = []
    for c in XYZ:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}")]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), *aggs)
