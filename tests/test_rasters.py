import json
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.operators import imaging as im
from sightline.operators import rasters as ra
from sightline.operators import runs, temporal

CAM = im.Camera(20.0, 20.0, 10.0, 8.0, 20, 16)
POSE = "frame long, tx double, ty double, tz double, qx double, qy double, qz double, qw double"


def turned(yaw):
    return 0.0, float(np.sin(yaw / 2)), 0.0, float(np.cos(yaw / 2))


def matrix(q):
    x, y, z, w = q
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])


def scene(frames, seed):
    """A room that stands still for some frames and changes now and then, seen by a turning camera; holes in it."""
    rng = np.random.default_rng(seed)
    depth = rng.uniform(1, 4, (CAM.height, CAM.width))
    images, poses = {}, {}
    for f in range(frames):
        if rng.random() < 0.25:
            depth = rng.uniform(0.1, 5.5, depth.shape)
        image = depth.copy()
        image[rng.random(depth.shape) < 0.1] = 0
        images[f] = image
        poses[f] = ((0.03 * f, 0.01 * f, -0.02 * f), turned(0.02 * f))
    return images, poses


def plain_novelty(images, poses, f, a, stride):
    (t0, q0), (t1, q1) = poses[f], poses[a]
    r0, r1 = matrix(q0), matrix(q1)
    new = known = 0
    for v in range(0, CAM.height, stride):
        for u in range(0, CAM.width, stride):
            d = images[f][v, u]
            if d <= 0:
                continue
            world = r0 @ np.array([(u - CAM.cx) / CAM.fx * d, (v - CAM.cy) / CAM.fy * d, d]) + t0
            c = r1.T @ (world - t1)
            valid = 0.2 <= d <= 5
            inside, old_ok, old = False, False, 0.0
            if 0.2 <= c[2] <= 5:
                pu, pv = int(CAM.fx * c[0] / c[2] + CAM.cx), int(CAM.fy * c[1] / c[2] + CAM.cy)
                inside = 0 <= pu < CAM.width and 0 <= pv < CAM.height
                old = images[a][pv, pu] if inside else 0.0
                old_ok = inside and 0.2 <= old <= 5
            seen = old_ok and abs(old - c[2]) <= 0.1 * c[2]
            unknown = inside and not old_ok
            known += valid and not unknown
            new += valid and not unknown and not seen
    grid = -(-CAM.width // stride) * -(-CAM.height // stride)
    return new, known, new / max(known, 1), known / grid


def plain_anchors(images, poses, stride, tau, gap):
    out, anchor = [], 0
    for f in range(len(images)):
        if f:
            before = plain_novelty(images, poses, f - 1, anchor, stride)
            if before[2] > tau and before[3] >= ra.MIN_VALID and f - anchor >= gap:
                anchor = f
        new, known, share, valid = plain_novelty(images, poses, f, anchor, stride)
        out.append((f, anchor, "init" if not f else "cov" if f == anchor else "", new, known, round(share, 9), round(valid, 9)))
    return out


def tables(spark, scenes):
    pixels, poses, frames = [], [], []
    for s, (images, where) in enumerate(scenes):
        for f, image in images.items():
            frames.append((s, 1000 * s + f))
            poses.append((1000 * s + f, *where[f][0], *where[f][1]))
            pixels += [(1000 * s + f, v, u, float(image[v, u])) for v in range(CAM.height) for u in range(CAM.width) if image[v, u] > 0]
    return (
        spark.createDataFrame(frames, "sequence long, frame long"),
        spark.createDataFrame(pixels, "frame long, v int, u int, depth double"), spark.createDataFrame(poses, POSE),
    )


@pytest.mark.parametrize("window", [7, 64])
def test_anchors_move_as_in_a_plain_loop(spark, window):
    scenes = [scene(24, 1), scene(17, 2)]
    frames, images, poses = tables(spark, scenes)
    got = ra.anchored_novelty(frames, images, poses, CAM, 2, tau=0.3, window=window)
    rows = {(r["sequence"], r["frame"]): r for r in got.collect()}
    assert len(rows) == 41
    keyframes = 0
    for s, (pictures, where) in enumerate(scenes):
        for f, anchor, kind, new, known, share, valid in plain_anchors(pictures, where, 2, 0.3, ra.KEYFRAME_GAP):
            r = rows[s, 1000 * s + f]
            assert (r["anchor"] - 1000 * s, r["keyframe"]) == (anchor, kind)
            # Seen from itself, a pixel falls on the edge of two, and the last bit of a sum decides.
            if f != anchor:
                assert (r["n_new"], r["n_known"]) == (new, known)
                assert (round(r["novelty"], 9), round(r["valid_frac"], 9)) == (share, valid)
            keyframes += kind == "cov"
    assert keyframes >= 3
    empty = ra.anchored_novelty(frames.limit(0), images, poses, CAM, 2)
    assert empty.count() == 0 and set(empty.columns) == set(got.columns)


def test_occlusion_looks_points_up_in_the_images(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(1, 4, (CAM.height, CAM.width))
    depth = np.where(rng.random(label.shape) < 0.15, 0.0, rng.uniform(0.5, 4, label.shape))
    pixels = [(0, v, u, int(label[v, u]), float(depth[v, u])) for v in range(CAM.height) for u in range(CAM.width)]
    q = turned(0.2)
    points = [(0, int(e), *map(float, p)) for e, p in zip(rng.integers(1, 4, 900), rng.uniform(-2, 4, (900, 3)), strict=True)]
    want = {}
    for _, e, *p in points:
        c = matrix(q).T @ (np.array(p) - (0.1, 0, 0))
        if c[2] <= ra.NEAR_M:
            continue
        u, v = int(CAM.fx * c[0] / c[2] + CAM.cx), int(CAM.fy * c[1] / c[2] + CAM.cy)
        if 0 <= u < CAM.width and 0 <= v < CAM.height:
            n = want.setdefault(e, [0, 0])
            d, same = depth[v, u], label[v, u] == e
            n[0] += bool(same and d > 0)
            n[1] += bool(not same and 0 < d < c[2] - max(0.05, 0.03 * c[2]))
    images = spark.createDataFrame(pixels, "frame long, v int, u int, colour int, depth double")
    poses = spark.createDataFrame([(0, 0.1, 0.0, 0.0, *q)], POSE)
    surface = spark.createDataFrame(points, "frame long, label int, x double, y double, z double")
    got = ra.occlusion(surface, images, poses, CAM, ["label"]).collect()
    assert {r["label"]: [r["n_visible"], r["n_hidden"]] for r in got} == want and sum(n for _, n in want.values()) > 20
    assert ra.occlusion(surface.limit(0), images, poses, CAM, ["label"]).count() == 0
    alone = ra.occlusion(surface, images.limit(0), poses, CAM, ["label"]).collect()
    assert all((r["n_visible"], r["n_hidden"], r["occ"]) == (0, 0, 0) for r in alone) and len(alone) == 3


def test_tiles_hold_every_pixel_once(spark):
    pixels = [(0, 3, 17, 5.0), (0, 3, 17, 2.0), (0, 15, 0, 1.0), (1, 3, 17, None)]
    tiles = ra.tiled(spark.createDataFrame(pixels, "frame long, v int, u int, depth double"), ["depth"])
    assert tiles.count() == 3
    asked = spark.createDataFrame([(0, 3, 17), (0, 15, 0), (0, 15, 1), (1, 3, 17), (2, 0, 0)], "frame long, pv int, pu int")
    got = {(r["frame"], r["pv"], r["pu"]): r["d"] for r in ra.looked_up(asked, tiles, {"depth": "d"}).collect()}
    assert got == {(0, 3, 17): 2.0, (0, 15, 0): 1.0, (0, 15, 1): None, (1, 3, 17): None, (2, 0, 0): None}


# ----------------------------------------------------------------- intervals

def plain_pieces(lo, hi):
    out, level, first, stop = [], 0, lo, hi + 1
    while first < stop:
        if first % 2:
            out.append((level, first))
        if stop % 2:
            out.append((level, stop - 1))
        first, stop, level = -(-first // 2), stop // 2, level + 1
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.integers(-5000, 5000), st.integers(0, 3000))
def test_pieces_cover_an_interval_once(lo, length):
    covered = [t for level, place in plain_pieces(lo, lo + length) for t in range(place << level, (place + 1) << level)]
    assert sorted(covered) == list(range(lo, lo + length + 1))


def test_interval_join_equals_every_pair_and_long_lifetimes_make_few_rows(spark):
    rnd = random.Random(4)
    spans = [(k, i, lo, lo + rnd.choice([-1, 0, 1, 5, 40, 1_000_000])) for i in range(60) for k in [rnd.randrange(3)] for lo in [rnd.randint(-50, 50)]]
    times = [(rnd.randrange(3), rnd.randint(-60, 120)) for _ in range(200)] + [(1, 999_990), (2, 1_000_060)]
    a = spark.createDataFrame(spans, "key int, id int, lo long, hi long")
    b = spark.createDataFrame(times, "key int, t long")
    for margin in (0, 3):
        got = sorted((r["key"], r["t"], r["id"]) for r in temporal.interval_join(b, a, ["key"], "t", "lo", "hi", margin).collect())
        assert got == sorted((k, t, i) for k, t in times for key, i, lo, hi in spans if key == k and lo - margin <= t <= hi + margin)
    levels = F.sequence(F.lit(0), F.lit(20))
    pieces = a.where("hi >= lo").select("lo", "hi", temporal._dyadic_pieces(F.col("lo"), F.col("hi"), levels).alias("p")).collect()
    for r in pieces:
        assert sorted((p["level"], p["place"]) for p in r["p"]) == plain_pieces(r["lo"], r["hi"]) and len(r["p"]) <= 40
    assert temporal.interval_join(b, a.limit(0), ["key"], "t", "lo", "hi").count() == 0


# ------------------------------------------------------------------- reports

def leaves(value, path=""):
    out = {}
    for k, v in value.items():
        if isinstance(v, dict):
            out |= leaves(v, f"{path}{k}.")
        elif isinstance(v, int | float) and not isinstance(v, bool):
            out[path + k] = float(v)
    return out


def test_numbers_of_nested_reports(spark):
    reports = [
        {"a": 1, "b": {"c": 2.5, "d": {"e": -3, "ok": True, "list": [1, 2]}}, "t": "x", "n": None, "big": 12345678901234567890},
        {"a": 3, "b": {"c": 0.5, "d": {}}, "x.y": {"z": 7}}, {}, {"b": 4},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(reports)] + [(8, None), (9, "[1]"), (10, "no json"), (11, "5")]
    table = spark.createDataFrame(rows, "run int, report string")
    got = {(r["run"], r["metric"]): r["value"] for r in runs.numeric_leaves(table, ["run"], "report").collect()}
    assert got == {(i, k): v for i, r in enumerate(reports) for k, v in leaves(r).items()}
    medians = {r["metric"]: (r["median"], r["n_runs"]) for r in runs.report_medians(table, "run", "report").collect()}
    assert medians["a"] == (2.0, 2) and medians["b.c"] == (1.5, 2) and medians["b"] == (4.0, 1) and medians["b.d.e"] == (-3.0, 1)
    assert runs.report_medians(table.limit(0), "run", "report").count() == 0


def test_tiles_hold_every_pixel_and_sort_once(spark):
    """Pixels given twice and missing ones; 600 tiles took half a second each while lambdas sorted them again per pixel."""
    rows = [(f, v, u, (f + v * u) % 7, None if u == 3 else float(v)) for f in range(150) for v in range(32) for u in range(32) if (f, v, u) != (0, 1, 1)]
    rows += [(0, 2, 2, -5, 9.0), (0, 2, 2, -5, 8.0)]
    px = spark.createDataFrame(rows, "frame long, v int, u int, colour long, depth double").repartition(8)
    began = time.monotonic()
    got = ra.tiled(px, ["colour", "depth"]).collect()
    assert time.monotonic() - began < 15
    assert len(got) == 600
    held = {(r[0], r[1], r[2]): r[3:] for r in rows[:-2]} | {(0, 2, 2): (-5, 8.0)}
    for r in got:
        assert len(r.colour) == len(r.depth) == 256
        for k in range(256):
            at = (r.frame, r.ty * 16 + k // 16, r.tx * 16 + k % 16)
            assert (r.colour[k], r.depth[k]) == held.get(at, (None, None))
