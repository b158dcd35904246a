"""Checks of ground truth and runs, and the remaining report operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import rules
from sightline.operators import voxels as vx
from sightline.operators.imaging import MATCH_TOL_M
from sightline.operators.nearest import nearest
from sightline.operators.ordered import global_row_number, prefix_sum, sliced
from sightline.operators.quantiles import exact_quantiles
from sightline.session import durable


def check_rows(checks: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(check, value, limit, passed) from one row of measured values; limits are (>= or <=, bound)."""
    cells = []
    for name, (op, bound) in limits.items():
        v = F.col(name).cast("double")
        ok = v >= bound if op == ">=" else v <= bound
        cells.append(
            F.struct(F.lit(name).alias("check"), v.alias("value"), F.lit(float(bound)).alias("bound"),
                     F.coalesce(ok, F.lit(False)).cast("int").alias("passed"))
        )
    return checks.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def structural(segments: DataFrame, objects: DataFrame, vectors: DataFrame, vector: str) -> DataFrame:
    """One row: segment ids without an object, most segments in a frame, vectors off unit length."""
    lost = segments.select("gt_object_id").distinct().join(objects, "gt_object_id", "left_anti")
    per = segments.groupBy("frame_idx").agg(F.countDistinct("gt_object_id").alias("n"))
    length = F.sqrt(g.vector_dot(F.col(vector), F.col(vector)))
    parts = [
        lost.agg(F.count(F.lit(1)).alias("unknown_ids")),
        per.agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_segments")),
        vectors.agg(F.count_if(F.abs(length - 1) > 1e-3).alias("off_unit")),
    ]
    keyed = [p.withColumn("_k", F.lit(0)) for p in parts]  # one row each
    return reduce(lambda a, b: a.join(b, "_k"), keyed).drop("_k")


def separation(vox: DataFrame, colour: str, allowed: float) -> DataFrame:
    """Pairs of instances of one colour whose smaller cloud touches the larger one too much."""
    size = vox.groupBy(colour, "instance").agg(F.count(F.lit(1)).alias("_n"))
    share = vx.touch_share(vox, "instance", [colour], vx.NEAR_STEPS)
    nb = size.select(colour, F.col("instance").alias("b"), F.col("_n").alias("n_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    return share.join(nb, [colour, "b"]).where(smaller & (F.col("share") > allowed)).select(colour, "a", "b", "share")


def cross_frame(obs: DataFrame, clouds: DataFrame, min_gap: int, min_points: int) -> DataFrame:
    """First and last observation of each object against its whole cloud: worse median per object.

    obs (object, frame, x, y, z); clouds (object, x, y, z).
    """
    n = obs.groupBy("object", "frame").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    ends = n.groupBy("object").agg(F.min("frame").alias("frame_a"), F.max("frame").alias("frame_b"))
    ends = ends.where(F.col("frame_b") - F.col("frame_a") >= min_gap)
    picked = obs.join(ends, "object").where((F.col("frame") == F.col("frame_a")) | (F.col("frame") == F.col("frame_b")))
    d = nearest(picked.select("object", *vx.XYZ), clouds.select("object", *vx.XYZ), ["object"], out="d")
    rows = picked.select("object", "frame", *vx.XYZ).join(d, ["object", *vx.XYZ])
    med = exact_quantiles(rows, ["object", "frame"], "d", {"median": 0.5, "p90": 0.9})
    return med.groupBy("object").agg(F.max("median").alias("median_nn_m"), F.max("p90").alias("p90_nn_m"))


def cloud_score(pred: DataFrame, gt: DataFrame, objects: DataFrame, size: float, max_dist: float) -> DataFrame:
    """Per predicted segment with a true partner: voxel IoU and share of outlying points.

    pred (frame, segment_id, x, y, z), gt the same with gt_object_id, objects (gt_object_id, x, y, z).
    """
    keys = ["frame", "segment_id"]
    a, b = vx.occupancy(pred, keys, size), vx.occupancy(gt, keys, size)
    both = a.join(b, [*keys, "voxel"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("_i"))
    na = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    nb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    iou = na.join(nb, keys).join(both, keys, "left").select(
        *keys, (F.coalesce("_i", F.lit(0)) / (F.col("_a") + F.col("_b") - F.coalesce("_i", F.lit(0)))).alias("voxel_iou")
    )
    owner = gt.select(*keys, "gt_object_id").distinct()
    pts = pred.join(owner, keys)
    # Only whether something lies within the distance is asked, so the search ends just behind it.
    near = nearest(pts.select("gt_object_id", *vx.XYZ), objects, ["gt_object_id"], bound=max_dist * (1 + 1e-9), out="d")
    there = objects.select("gt_object_id").distinct().withColumn("_there", F.lit(True))
    far = F.when(F.col("_there"), (F.coalesce("d", F.lit(math.inf)) > max_dist).cast("int"))
    out = pts.join(near, ["gt_object_id", *vx.XYZ], "left").join(there, "gt_object_id", "left").groupBy(*keys).agg(
        F.avg(far).alias("outlier_ratio")
    )
    return iou.join(out, keys, "left")


def cloud_summary(scores: DataFrame, gt: DataFrame, recorded: DataFrame) -> DataFrame:
    """Means over the scored segments and the share of the true segments of recorded frames that were scored."""
    seen = gt.join(recorded.select("frame").distinct(), "frame", "left_semi")
    total = seen.select("frame", "segment_id").distinct().agg(F.count(F.lit(1)).alias("_t")).withColumn("_k", F.lit(0))
    s = scores.agg(
        F.avg("voxel_iou").alias("voxel_iou_mean"), F.avg("outlier_ratio").alias("outlier_ratio_mean"),
        F.count(F.lit(1)).alias("segments_scored"),
    ).withColumn("_k", F.lit(0))
    return s.join(total, "_k").withColumn("segment_recall", rules.ratio(F.col("segments_scored"), F.col("_t"))).drop("_k", "_t")


def label_pixels(pixels: DataFrame, parts: DataFrame, hits: DataFrame, tested: DataFrame, max_range: float) -> DataFrame:
    """Label of every pixel of a 2D part from the decision made for the part; 0 = void.

    pixels (component, pixel, u, v, range_m or NULL without depth), parts with
    (component, mode, winner), hits (component, u, v, episode) of the samples,
    tested (pixel, episode): pixels that lie near a cloud themselves.
    """
    flat = ["component", F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"), F.lit(0.0).alias("z")]
    p = pixels.join(parts.select("component", "mode", "winner"), "component")
    ask = p.where("mode <> 'fill'").select(*flat)
    seed = nearest(ask, hits.select(*flat, "episode"), ["component"], payload=["episode"], leaf=2.0)
    seed = seed.select("component", F.col("x").cast("int").alias("u"), F.col("y").cast("int").alias("v"),
                       F.col("episode").alias("_seed"))
    p = p.join(seed, ["component", "u", "v"], "left").join(
        tested.select("pixel", F.col("episode").alias("_own")), "pixel", "left"
    )
    far = F.col("range_m") > max_range
    label = (
        F.when(F.col("range_m").isNull(), 0)
        .when(F.col("mode") == "fill", F.col("winner") + 1)
        .when(F.col("mode") == "seed", F.col("_seed") + 1)
        .when(far, F.col("_seed") + 1)
        .otherwise(F.coalesce(F.col("_own") + 1, F.lit(0)))
    )
    return p.withColumn("label", label).drop("_seed", "_own")


def nearest_episode(points: DataFrame, clouds: DataFrame, tol: float = MATCH_TOL_M) -> DataFrame:
    """Episode nearest to each pixel's world point within the tolerance, lowest number on ties."""
    d = nearest(points.select("colour", *vx.XYZ), clouds, ["colour"], bound=tol, payload=["episode"])
    return points.join(d.select("colour", *vx.XYZ, "episode"), ["colour", *vx.XYZ])


# ------------------------------------------------------------------- reports

def first_seen_ids(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Dense ids from 0 in order of first appearance."""
    first = rows.groupBy(key).agg(F.min(position).alias("_p"))
    return global_row_number(first, ["_p", key], "_n").select(key, (F.col("_n") - 1).alias("dense_id"))


def late_frames(rows: DataFrame, keys: Sequence[str], stamp: str, wall: str, rate: float, slack: int) -> DataFrame:
    """Frames played later than the stamps demand by more than ``slack``, per key."""
    start = rows.groupBy(*keys).agg(F.min(stamp).alias("_s0"), F.min(wall).alias("_w0"))
    due = F.col("_w0") + (F.col(stamp) - F.col("_s0")) / F.lit(rate)
    j = rows.join(start, list(keys))
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col(wall) - due > slack).alias("lag_frames")
    )


def scatter_vectors(dets: DataFrame, vectors: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """Vectors at their detections; detections without one get zeros."""
    zero = F.array_repeat(F.lit(0.0), dims)
    return dets.join(vectors.select(*keys, "embedding"), list(keys), "left").withColumn(
        "embedding", F.coalesce("embedding", zero)
    )


def type_vectors(objects: DataFrame, colour: str, dims: int) -> DataFrame:
    """One vector per colour: unit axes while colours fit, otherwise hashed unit directions."""
    rank = first_seen_ids(objects.withColumn("_c", F.col(colour)), colour, "_c")
    n = rank.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(0))
    axis = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (i == F.col("dense_id")).cast("double"))
    noise = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.pmod(F.xxhash64(F.col("dense_id"), i), F.lit(2_000_001)) / 1_000_000.0 - 1.0,
    )
    j = rank.withColumn("_k", F.lit(0)).join(F.broadcast(n), "_k")  # one row
    pick = F.when(F.col("_n") <= dims, axis).otherwise(g.unit_vector(noise))
    return objects.join(j.select(colour, pick.alias("embedding")), colour)


def reasons_text(counts: DataFrame, keys: Sequence[str], code: str, names: Column) -> DataFrame:
    """'label count, label count': most frequent first; labels are a closed set."""
    n = counts.groupBy(*keys, names.alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_l").alias("l"))))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["l"], F.lit(" "), (-p["n"]).cast("string"))), ", ")
    return n.groupBy(*keys).agg(text.alias("reasons"))


def credited(rows: DataFrame, credit: str) -> DataFrame:
    """Rows whose match counts; a missing credit counts."""
    return rows.where(F.coalesce(F.col(credit), F.lit(1)) != 0)


def object_metrics(obs: DataFrame, best: DataFrame) -> DataFrame:
    """Matched observations and their median distance per object, with its best keyframe.

    obs (object, credit, dist), best (object, kf, px): largest px, first keyframe on ties.
    """
    c = credited(obs, "credit").where("dist IS NOT NULL")
    n = c.groupBy("object").agg(F.count(F.lit(1)).alias("n_matched"))
    med = exact_quantiles(c, ["object"], "dist", {"dist_median": 0.5})
    b = best.groupBy("object").agg(
        F.min_by("kf", F.struct(-F.col("px"), F.col("kf"))).alias("best_kf"), F.max("px").alias("best_kf_px")
    )
    return b.join(n, "object", "left").join(med, "object", "left").na.fill(0, ["n_matched"])


def in_run(rows: DataFrame, first: str, last: str, lo: Column, hi: Column) -> DataFrame:
    """Episodes that overlap the run window [lo, hi)."""
    return rows.where((F.col(last) >= lo) & (F.col(first) < hi))


def every_kth(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """n rows at even steps of the sorted list."""
    s = prefix_sum(sliced(rows, [], order), [], order, F.lit(1).cast("long"), "_p", inclusive=False)
    s = durable(s, "numbered")
    total = s.agg(F.count(F.lit(1)).alias("_t")).withColumn("_k", F.lit(0))
    step = F.greatest(F.lit(1), F.floor(F.col("_t") / n))
    j = s.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k")  # one row
    return j.where((F.col("_p") % step == 0) & (F.col("_p") / step < n)).drop("_p", "_k", "_t", "_slice")


def same_value(a: Column, b: Column, rel: float = 1e-9) -> Column:
    """Equal parameters: numbers with tolerance, missing equals missing."""
    near = F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def outdated(labels: DataFrame, version: int) -> DataFrame:
    """Stored label sets made by another version of the algorithm."""
    return labels.where(~F.col("version").eqNullSafe(F.lit(version)))
