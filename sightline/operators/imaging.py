"""Operators on label and depth images held as long pixel tables.

A pixel table has (frame, v, u, colour, depth in metres or NULL). Poses are
(frame, tx, ty, tz, qx, qy, qz, qw), camera to world, one row per frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import truth as tr
from sightline.operators.components import connected_components, least_joined
from sightline.operators.matching3d import mode_reason
from sightline.operators.nearest import nearest
from sightline.operators.voxels import XYZ
from sightline.session import durable

# Fixed values
MATCH_TOL_M = 0.06
MAX_RANGE_M = 5.0
SPLIT_CELL_M = 0.10

PATCH = 128  # side of the image patches whose parts are found in one task


@dataclass(frozen=True)
class Camera:
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int


# ---------------------------------------------------------------- 3D from pixels

def unproject(pixels: DataFrame, cam: Camera, stride: int = 1, mask: Column | None = None) -> DataFrame:
    """Camera-frame points of the strided pixels with a depth reading."""
    keep = (F.col("v") % stride == 0) & (F.col("u") % stride == 0) & (F.col("depth") > 0)
    if mask is not None:
        keep = keep & mask
    xyz = g.back_project(F.col("u"), F.col("v"), F.col("depth"), cam.fx, cam.fy, cam.cx, cam.cy)
    return pixels.where(keep).withColumns({f"c{c}": e for c, e in zip(XYZ, xyz)})


def to_world(points: DataFrame, poses: DataFrame) -> DataFrame:
    """World coordinates of camera-frame points (cx, cy, cz); the camera distance is kept."""
    p = points.join(poses, "frame")
    rot = g.rotation_of([F.col(f"q{c}") for c in "xyzw"])
    t = [F.col(f"t{c}") for c in XYZ]
    cam = [F.col(f"c{c}") for c in XYZ]
    world = g.camera_to_world(cam, rot, t)
    drop = [f"q{c}" for c in "xyzw"] + [f"t{c}" for c in XYZ]
    return p.withColumns({**{c: e for c, e in zip(XYZ, world)}, "range_m": g.norm(cam)}).drop(*drop)


def reproject(points: DataFrame, poses: DataFrame, cam: Camera, rounding: str) -> DataFrame:
    """Pixel (pu, pv) and depth pz of world points; ``on_image`` says whether it is inside."""
    p = points.join(poses, "frame")
    rot = g.rotation_of([F.col(f"q{c}") for c in "xyzw"])
    c = g.world_to_camera([F.col(x) for x in XYZ], rot, [F.col(f"t{x}") for x in XYZ])
    u, v = g.project(c, cam.fx, cam.fy, cam.cx, cam.cy, rounding)
    drop = [f"q{x}" for x in "xyzw"] + [f"t{x}" for x in XYZ]
    p = p.withColumns({"pu": u, "pv": v, "pz": c[2]}).drop(*drop)
    ok = (F.col("pz") > 0) & F.col("pu").between(0, cam.width - 1) & F.col("pv").between(0, cam.height - 1)
    return p.withColumn("on_image", F.coalesce(ok, F.lit(False)))


# ------------------------------------------------------------------ components

def pixel_id(cam: Camera) -> Column:
    return F.col("frame") * (cam.width * cam.height) + F.col("v") * cam.width + F.col("u")


def _parts_of_patch(table: pa.Table) -> pa.Table:
    """Adds ``part``, the first pixel of the 8-connected part of one colour inside the patch."""
    ids, at = np.unique(table["pixel"].to_numpy(), return_inverse=True)
    v, u = (table[c].to_numpy().astype(np.int64) for c in ("v", "u"))
    known = table["colour"].is_valid().to_numpy()
    codes = table["colour"].combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy().astype(np.int64)
    v, u = v - v.min() + 1, u - u.min() + 1
    wide = u.max() + 2
    key = (codes * (v.max() + 2) + v) * wide + u
    order = np.flatnonzero(known)
    order = order[np.argsort(key[order], kind="stable")]
    sorted_key = key[order]
    a, b = [at[:0]], [at[:0]]
    for dv, du in ((0, 1), (1, -1), (1, 0), (1, 1)):
        to = sorted_key + dv * wide + du
        place = np.minimum(np.searchsorted(sorted_key, to), max(len(order) - 1, 0))
        hit = sorted_key[place] == to
        a.append(at[order[hit]])
        b.append(at[order[place[hit]]])
    root = least_joined(len(ids), np.concatenate(a), np.concatenate(b))
    return table.append_column("part", pa.array(ids[root[at]], pa.int64()))


def pixel_components(pixels: DataFrame, cam: Camera, patch: int = PATCH) -> DataFrame:
    """8-connected parts of one colour per frame; the part is named by its first pixel.

    The parts inside a patch of ``patch`` x ``patch`` pixels are found by one
    task; only pixels on the border of a patch meet those of other patches.
    """
    p = pixels.withColumn("pixel", pixel_id(cam).cast("long")).where("pixel IS NOT NULL")
    of = lambda v, u: F.struct(F.floor(v / patch), F.floor(u / patch))
    schema = p.withColumn("part", F.lit(0).cast("long")).schema
    parts = p.groupBy("frame", of(F.col("v"), F.col("u")).alias("_patch")).applyInArrow(_parts_of_patch, schema)
    parts = durable(parts, "pixel-parts")
    rim = F.lit(False)
    for c in ("v", "u"):
        rim = rim | F.pmod(F.col(c), F.lit(patch)).isin(0, patch - 1)
    border = parts.where(rim).select("frame", "colour", F.col("v").cast("long").alias("v"), F.col("u").cast("long").alias("u"), "part")
    steps = F.array(*[F.struct(F.lit(a).alias("dv"), F.lit(b).alias("du")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    to_v, to_u = F.col("v") + F.col("_s.dv"), F.col("u") + F.col("_s.du")
    moved = border.withColumn("_s", F.explode(steps)).where(of(F.col("v"), F.col("u")) != of(to_v, to_u)).select(
        "frame", "colour", to_v.alias("v"), to_u.alias("u"), F.col("part").alias("a")
    )
    edges = moved.join(border.withColumnRenamed("part", "b").hint("merge"), ["frame", "colour", "v", "u"]).select("a", "b")
    comp = durable(connected_components(edges, "a", "b"), "patch-links")
    linked = parts.join(comp.withColumnRenamed("v", "part"), "part", "left")
    return linked.select(*pixels.columns, "pixel", F.coalesce("component", "part").alias("component"))


def extract_blobs(pixels: DataFrame, poses: DataFrame, cam: Camera, stride: int, split_cell: float, gap_factor: float):
    """(pixels with blob, world points with blob).

    A 2D part of one colour is split further where its points do not connect in
    space; the link radius grows with depth so that sampling gaps do not split.
    Every pixel goes to the blob of the nearest sampled pixel of its part; parts
    without samples keep one blob.
    """
    comp = durable(pixel_components(pixels, cam), "pixel-components")
    pts = to_world(unproject(comp, cam, stride), poses).withColumn("point_id", F.col("pixel"))
    radius = F.greatest(F.lit(split_cell), F.lit(gap_factor * stride / cam.fx) * F.col("depth"))
    pts = durable(pts.withColumn("radius", radius), "blob-points")
    sub = connected_components(durable(tr.scale_edges(pts, ["component"]), "blob-edges"), "a", "b", contract=True)
    pts = durable(pts.join(sub.select(F.col("v").alias("point_id"), F.col("component").alias("blob")), "point_id"), "blob-points")
    flat = [F.col("u").alias("x"), F.col("v").alias("y"), F.lit(0).alias("z")]
    seeds = pts.select("component", *flat, "blob")
    # Pixels are handed through with their blob; column and row are their place.
    rest = [c for c in comp.columns if c not in ("component", "u", "v")]
    near = nearest(comp.select("component", *flat, *rest), seeds, ["component"], payload=["blob"], leaf=2.0, carry=rest)
    place = {c: F.col(x).cast(comp.schema[c].dataType) for c, x in (("u", "x"), ("v", "y"))}
    px = near.withColumns(place).withColumn("blob", F.coalesce("blob", "component")).select(*comp.columns, "blob")
    return px, pts


def blob_stats(px: DataFrame, pts: DataFrame) -> DataFrame:
    a = px.groupBy("frame", "colour", "blob").agg(F.count(F.lit(1)).alias("n_px"))
    b = pts.groupBy("blob").agg(F.count(F.lit(1)).alias("n_points"), F.avg("depth").alias("mean_depth"))
    return a.join(b, "blob", "left").na.fill(0, ["n_points"]).na.fill(0.0, ["mean_depth"])


# ----------------------------------------------------------------- visibility

def cloud_hits(points: DataFrame, clouds: DataFrame, tol: float = MATCH_TOL_M) -> DataFrame:
    """(frame, colour, point, episode, d) for every active episode within ``tol`` of a world point.

    clouds: (colour, episode, first_frame, last_frame, x, y, z). Points meet the
    clouds of their colour only where they come close in space.
    """
    d = nearest(points.select("colour", *XYZ), clouds.select("colour", "episode", *XYZ), ["colour"], bound=tol, per=["episode"], out="d")
    life = clouds.select("episode", "first_frame", "last_frame").distinct()
    j = points.join(d, ["colour", *XYZ]).join(life, "episode")
    return j.where((F.col("frame") >= F.col("first_frame")) & (F.col("frame") <= F.col("last_frame"))).drop(
        "first_frame", "last_frame"
    )


def visible_pixels(hits: DataFrame, stride: int, crop: tuple[int, int]) -> DataFrame:
    inside = (F.col("u") >= crop[0]) & (F.col("u") < crop[1])
    return tr.visible_pixels(hits, ["episode", "frame"], inside, stride)


def label_parts(samples: DataFrame, hits: DataFrame, support_min: float, dominant: float) -> DataFrame:
    """Decision per 2D part: support, winning episode, and how its pixels are labelled.

    ``fill``  one episode dominates and is supported: all pixels take it
    ``seed``  supported but mixed: pixels take the episode of the nearest hit
    ``test``  not supported: near pixels are tested one by one, far ones take the nearest hit
    """
    n = samples.groupBy("component").agg(F.count(F.lit(1)).alias("n_samples"))
    best = hits.groupBy("component", "pixel").agg(F.min(F.struct("d", "episode")).alias("_b"))
    votes = best.select("component", F.col("_b.episode").alias("label"))
    v = tr.component_vote(votes, ["component"], dominant)
    support = F.col("n_votes") / F.col("n_samples")
    return v.drop("support").join(n, "component").withColumn("support", support).withColumn(
        "mode",
        F.when(F.col("support") < support_min, "test").when(F.col("dominates"), "fill").otherwise("seed"),
    )


def verify_far(pixels: DataFrame, object_clouds: DataFrame, tol: float = MATCH_TOL_M) -> DataFrame:
    """Far pixels keep their label only near the union cloud of the object they were given."""
    d = nearest(pixels.select("object", *XYZ), object_clouds.select("object", *XYZ), ["object"], bound=tol, out="_d")
    ok = d.select("object", *XYZ, F.lit(True).alias("verified"))
    return pixels.join(ok, ["object", *XYZ], "left").na.fill(False, ["verified"])


# ---------------------------------------------------------------- silhouettes

def silhouettes(points: DataFrame, poses: DataFrame, cam: Camera, size: float = g.VOXEL_M, near: float = 0.1) -> DataFrame:
    """Image area of each episode's cloud inside the image and in total.

    Points are drawn as discs on a canvas three times the image; points behind
    the near plane or off the canvas add their footprint scaled by the ratio of
    drawn area to drawn footprints. points: (frame, episode, x, y, z).
    """
    p = points.join(poses, "frame")
    rot = g.rotation_of([F.col(f"q{c}") for c in "xyzw"])
    c = g.world_to_camera([F.col(x) for x in XYZ], rot, [F.col(f"t{x}") for x in XYZ])
    p = p.select("frame", "episode", *[e.alias(f"c{x}") for e, x in zip(c, XYZ)])
    front = F.col("cz") > near
    z = F.when(front, F.col("cz"))
    u = F.lit(cam.fx) * F.col("cx") / z + F.lit(cam.cx)
    v = F.lit(cam.fy) * F.col("cy") / z + F.lit(cam.cy)
    w, h = cam.width, cam.height
    p = p.withColumns({"_u": u, "_v": v, "foot": g.footprint_px(F.col("cz"), cam.fx, size, near)})
    on = front & (F.col("_u") > -w) & (F.col("_u") < 2 * w) & (F.col("_v") > -h) & (F.col("_v") < 2 * h)
    p = p.withColumn("drawn", F.coalesce(on, F.lit(False)))
    discs = p.where("drawn").select(
        "frame", "episode", (F.col("_u").cast("int") + w).alias("u"), (F.col("_v").cast("int") + h).alias("v"),
        g.splat_radius(F.col("cz"), cam.fx, size).alias("r"),
    ).distinct()
    row = discs.withColumn("dv", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    half = F.rint(F.sqrt((F.col("r") * F.col("r") - F.col("dv") * F.col("dv")).cast("double"))).cast("int")
    cell = row.select(
        "frame", "episode", (F.col("v") + F.col("dv")).alias("v"),
        F.explode(F.transform(F.sequence(-half, half), lambda k: k + F.col("u"))).alias("u"),
    ).distinct()
    inside = F.col("u").between(w, 2 * w - 1) & F.col("v").between(h, 2 * h - 1)
    area = cell.where(F.col("u").between(0, 3 * w - 1) & F.col("v").between(0, 3 * h - 1)).groupBy("frame", "episode").agg(
        F.count_if(inside).alias("sil_px"), F.count(F.lit(1)).alias("_canvas")
    )
    foot = p.groupBy("frame", "episode").agg(
        F.sum(F.when(F.col("drawn"), F.col("foot"))).alias("_fd"), F.sum(F.when(~F.col("drawn"), F.col("foot"))).alias("_fo")
    )
    j = foot.join(area, ["frame", "episode"], "left").na.fill(0)
    rho = F.when(F.col("_canvas") > 0, F.col("_canvas") / F.greatest(F.col("_fd"), F.lit(1e-9))).otherwise(1.0)
    total = F.rint(F.col("_canvas") + rho * F.coalesce("_fo", F.lit(0.0))).cast("long")
    j = j.withColumn("sil_total_px", total)
    trunc = F.when(F.col("sil_total_px") > 0, 1 - F.col("sil_px") / F.col("sil_total_px")).otherwise(0.0)
    return j.withColumn("trunc", trunc).select("frame", "episode", "sil_px", "sil_total_px", "trunc")


# ------------------------------------------------------------------- checking

def containment(points: DataFrame, masks: DataFrame, poses: DataFrame, cam: Camera) -> DataFrame:
    """Per frame: share of points that fall into their own mask grown by one pixel.

    points (frame, segment, x, y, z), masks (frame, segment, v, u).
    """
    p = reproject(points, poses, cam, "round")
    # A row of a mask is one array; it counts for the rows above and below it as well.
    rows = masks.groupBy("frame", "segment", "v").agg(F.collect_set(F.col("u").cast("long")).alias("_us"))
    lines = F.explode(F.array(*[(F.col("v") + k).cast("long") for k in (-1, 0, 1)]))
    grown = rows.select("frame", "segment", lines.alias("pv"), "_us").groupBy("frame", "segment", "pv").agg(
        F.array_distinct(F.flatten(F.collect_list("_us"))).alias("_us")
    )
    j = p.join(grown, ["frame", "segment", "pv"], "left")
    beside = F.array(*[(F.col("pu") + k).cast("long") for k in (-1, 0, 1)])
    ok = F.col("on_image") & F.coalesce(F.arrays_overlap("_us", beside), F.lit(False))
    return j.groupBy("frame").agg(F.count(F.lit(1)).alias("n_points"), F.avg(ok.cast("int")).alias("inside"))


def frame_shift(points: DataFrame, dense: DataFrame, within: float) -> DataFrame:
    """Share of points within ``within`` of the dense cloud of frames f-1, f and f+1.

    The right frame numbering shows as a clear maximum at shift 0.
    """
    shifts = F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)]))
    p = points.select("frame", *XYZ, shifts.alias("shift")).withColumn("target", F.col("frame") + F.col("shift"))
    ref = dense.select(F.col("frame").alias("target"), *XYZ)
    # The bound is strict, so it lies just above the limit; frames without a cloud do not count.
    d = nearest(p.select("target", *XYZ), ref, ["target"], bound=within * (1 + 1e-6), out="d")
    j = p.join(ref.select("target").distinct(), "target", "left_semi").join(d, ["target", *XYZ], "left")
    return j.groupBy("shift").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg(F.coalesce(F.col("d") <= within, F.lit(False)).cast("int")).alias("within_share")
    )


def merged_mates(covers: DataFrame) -> DataFrame:
    """For each (frame, pred, gt) the other truths the prediction covers; a frame has few truths."""
    g_ = covers.groupBy("frame", "pred").agg(F.sort_array(F.collect_set("gt")).alias("_all"))
    return covers.join(g_.where(F.size("_all") >= 2), ["frame", "pred"]).select(
        "frame", "pred", "gt", F.array_remove("_all", F.col("gt")).alias("mates")
    )


def object_verdicts(episodes: DataFrame, area_min: int, order: Sequence[str]) -> DataFrame:
    """detected / miss reason / ineligible per object from (object, max_px, detected, miss_reason)."""
    el = F.col("max_px") >= area_min
    base = episodes.groupBy("object").agg(
        F.count_if(el).alias("n_eligible"), F.bool_or(el & (F.col("detected") == 1)).alias("found"), F.max("max_px").alias("max_px")
    )
    why = mode_reason(episodes.where(el), ["object"], "miss_reason", order, "missed")
    status = (
        F.when((F.col("n_eligible") == 0) & (F.col("max_px") == 0), "not_visible")
        .when(F.col("n_eligible") == 0, "too_small")
        .when(F.col("found"), "detected")
        .otherwise(F.col("reason"))
    )
    return base.join(why, "object", "left").withColumn("verdict", status).drop("found", "reason")


def lane_stats(cells: DataFrame, pixels: DataFrame, z_min: float, z_max: float) -> DataFrame:
    """Area, valid depth count, centroid and valid share of each mask.

    cells (frame, lane, cell), pixels (frame, cell, depth, x, y, z in world).
    """
    j = cells.join(pixels, ["frame", "cell"], "left")
    ok = (F.col("depth") > z_min) & (F.col("depth") < z_max)
    return j.groupBy("frame", "lane").agg(
        F.count(F.lit(1)).alias("area"), F.count_if(ok).alias("n_points"),
        *[F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)).alias(f"mean_{c}") for c in XYZ],
    ).withColumn("depth_valid_ratio", F.col("n_points") / F.col("area"))
