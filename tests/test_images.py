"""Image and ground-truth operators against plain computations on small scenes."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import components as cc
from sightline.operators import imaging as im
from sightline.operators import suppression as sp
from sightline.operators import truth as tr
from sightline.operators import verify as vf
from sightline.operators import voxels as vx
from sightline.operators.nearest import nearest
from sightline.plans import ORACLE, QUERIES
from sightline.session import durable

CAM = im.Camera(20.0, 20.0, 8.0, 8.0, 16, 16)


def image(spark, colours, depth=1.0):
    rows = [
        (int(f), int(v), int(u), int(c), float(depth if np.isscalar(depth) else depth[f, v, u]))
        for (f, v, u), c in np.ndenumerate(colours)
    ]
    return spark.createDataFrame(rows, "frame long, v int, u int, colour long, depth double")


def still(spark, n=1):
    return spark.createDataFrame(
        [(f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for f in range(n)],
        "frame long, tx double, ty double, tz double, qx double, qy double, qz double, qw double",
    )


def flood(img):
    """First pixel of the 8-connected part of every pixel."""
    out = -np.ones(img.shape, int)
    for start in np.ndindex(img.shape):
        if out[start] >= 0:
            continue
        todo, name = [start], start[0] * img.shape[1] + start[1]
        out[start] = name
        while todo:
            v, u = todo.pop()
            for a in range(max(v - 1, 0), min(v + 2, img.shape[0])):
                for b in range(max(u - 1, 0), min(u + 2, img.shape[1])):
                    if out[a, b] < 0 and img[a, b] == img[v, u]:
                        out[a, b] = name
                        todo.append((a, b))
    return out


def test_pixel_components(spark):
    img = np.random.default_rng(2).integers(0, 3, (1, 16, 16))
    got = im.pixel_components(image(spark, img), CAM).select("v", "u", "component").collect()
    want = flood(img[0])
    assert len(got) == 256 and all(r.component == want[r.v, r.u] for r in got)


def test_blobs_split_in_depth(spark):
    """One image part at two depths becomes two blobs; pixels follow their nearest sample."""
    img = np.zeros((1, 16, 16), int)
    depth = np.ones((1, 16, 16))
    depth[0, :, 8:] = 3.0
    px, pts = im.extract_blobs(image(spark, img, depth), still(spark), CAM, 2, 0.1, 1.5)
    s = sorted((r.n_px, r.n_points, round(r.mean_depth, 6)) for r in im.blob_stats(px, pts).collect())
    assert [x[1:] for x in s] in ([(32, 1.0), (32, 3.0)], [(32, 3.0), (32, 1.0)])
    assert sum(x[0] for x in s) == 256


def test_project_back(spark):
    px = image(spark, np.zeros((1, 16, 16), int), 2.0)
    w = im.to_world(im.unproject(px, CAM), still(spark))
    back = im.reproject(w, still(spark), CAM, "rint")
    assert back.where("pu <> u OR pv <> v OR NOT on_image").count() == 0


def test_silhouette_of_one_point(spark):
    """Radius 2 disc at the image centre, half of it outside at the border."""
    z = 0.5 * 0.02 * 200.0 / 2
    cam = im.Camera(200.0, 200.0, 8.0, 8.0, 16, 16)
    pts = spark.createDataFrame([(0, 1, 0.0, 0.0, z), (0, 2, -8.0 / 200 * z, 0.0, z), (0, 3, 0.0, 0.0, -1.0)], "frame long, episode long, x double, y double, z double")
    got = {r.episode: r for r in im.silhouettes(pts, still(spark), cam).collect()}
    disc = sum(2 * int(round((4 - d * d) ** 0.5)) + 1 for d in range(-2, 3))
    assert (got[1].sil_px, got[1].sil_total_px, got[1].trunc) == (disc, disc, 0.0)
    assert got[2].sil_px < got[2].sil_total_px == disc
    assert got[3].sil_px == 0 and got[3].trunc == 1.0


def test_frame_shift_peaks_at_zero(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.random((60, 3)), columns=["x", "y", "z"]).assign(frame=np.repeat([0, 1, 2], 20))
    df = spark.createDataFrame(pdf)
    got = {r["shift"]: r.within_share for r in im.frame_shift(df.where("frame = 1"), df, 0.001).collect()}
    assert got[0] == 1.0 and got[1] == 0.0 and got[-1] == 0.0


def test_suppression(spark):
    b = [(0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.8, 1.0, 0.0, 11.0, 10.0), (0, 2, 0.7, 20.0, 0.0, 30.0, 10.0), (0, 3, 0.1, 50.0, 0.0, 60.0, 10.0)]
    df = spark.createDataFrame(b, "frame long, det long, conf double, x1 double, y1 double, x2 double, y2 double")
    assert [(r.det, r.lane) for r in sp.suppress_boxes(df, 0.2, 0.5).orderBy("lane").collect()] == [(0, 0), (2, 1)]
    lanes = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (0, 2, 0.7)], "frame long, lane long, conf double")
    cells = spark.createDataFrame(
        [(0, 0, c) for c in range(10)] + [(0, 1, c) for c in range(2, 12)] + [(0, 2, c) for c in range(50, 54)], "frame long, lane long, cell long"
    )
    assert sorted(r.lane for r in sp.dedup_masks(lanes, cells, 3, 0.5).collect()) == [0, 2]
    assert sorted(r.lane for r in sp.dedup_masks(lanes, cells, 5, 0.9).collect()) == [0, 1]


def box_frame(spark, rows):
    return spark.createDataFrame(rows, "frame long, det long, conf double, x1 double, y1 double, x2 double, y2 double")


def greedy(rows, conf_min, iou_max):
    """Kept detections, best first, by comparing with everything kept so far."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        def iou(k, r=r):
            w, h = min(k[5], r[5]) - max(k[3], r[3]), min(k[6], r[6]) - max(k[4], r[4])
            i = max(w, 0) * max(h, 0)
            return i / ((k[5] - k[3]) * (k[6] - k[4]) + (r[5] - r[3]) * (r[6] - r[4]) - i + 1e-9)
        if r[2] > conf_min and all(iou(k) <= iou_max for k in kept):
            kept.append(r)
    return [r[1] for r in kept]


def test_suppression_of_a_chain_and_of_many(spark):
    chain = [(0, i, 0.9 - i / 100, 3.0 * i, 0.0, 3.0 * i + 10, 10.0) for i in range(24)]
    apart = [(1, i, 0.5, 20.0 * i, 0.0, 20.0 * i + 10, 10.0) for i in range(300)]
    kept = sp.suppress_boxes(box_frame(spark, chain + apart), 0.2, 0.5)
    assert [r.det for r in kept.where("frame = 0").orderBy("lane").collect()] == greedy(chain, 0.2, 0.5) == list(range(0, 24, 2))
    assert kept.where("frame = 1").count() == 300
    over = {r.frame: r for r in sp.overflow(box_frame(spark, chain + apart), kept, 0.2, 100, 128).collect()}
    assert (over[1].over_candidates, over[1].over_lanes, over[0].over_lanes) == (200, 172, 0)


def test_suppression_of_random_boxes_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(250):
        x, y, w, h = rng.uniform(-30, 60), rng.uniform(-30, 60), 2 ** rng.uniform(-1, 6), 2 ** rng.uniform(-1, 6)
        rows.append((0, i, float(round(rng.random(), 1)), float(x), float(y), float(x + w), float(y + h)))
    for iou_max in (0.2, 0.5):
        got = [r.det for r in sp.suppress_boxes(box_frame(spark, rows), 0.1, iou_max).orderBy("lane").collect()]
        assert got == greedy(rows, 0.1, iou_max)


def test_merge_to_fixpoint(spark):
    """A chain of touching pieces of one colour ends up as one instance; other colours stay."""
    rows = []
    for inst, lo in ((1, 0), (2, 8), (3, 16), (4, 100)):
        rows += [(7, inst, (i + 0.5) * 0.1, 0.05, 0.05) for i in range(lo, lo + 10)]
    rows += [(8, 5, (i + 0.5) * 0.1, 0.05, 0.05) for i in range(0, 10)]
    df = spark.createDataFrame(rows, "colour long, instance long, x double, y double, z double")
    got = {r.instance: r.root for r in tr.merge_instances(vx.occupancy(df, ["colour", "instance"], 0.1), ["colour"], 0.3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_scale_edges_respect_radius(spark):
    xs = [0.0, 0.05, 0.1, 1.0, 1.05]
    pts = spark.createDataFrame([(0, i, x, 0.0, 0.0, 0.1) for i, x in enumerate(xs)] + [(1, 10, 0.0, 0.0, 0.0, 2.0), (1, 11, 1.0, 0.0, 0.0, 2.0)],
                                "k long, point_id long, x double, y double, z double, radius double")
    comp = cc.connected_components(durable(tr.scale_edges(pts, ["k"]), "e"), "a", "b")
    got = {r.v: r.component for r in comp.collect()}
    assert [got[i] for i in range(5)] == [0, 0, 0, 3, 3] and got[10] == got[11] == 10
    rank = {r.component: (r.n_points, r["rank"]) for r in tr.order_components(pts, comp, ["k"]).where("k = 0").collect()}
    assert rank == {0: (3, 0), 3: (2, 1)}


def test_top_k_and_sample(spark):
    df = spark.createDataFrame([(0, i, float(i % 7)) for i in range(300)] + [(1, 900, 1.0)], "k long, i long, s double")
    got = tr.top_k(df, ["k"], "s", "i", 3).where("k = 0").orderBy("rank").collect()
    assert [(r.i, r["rank"]) for r in got] == [(6, 1), (13, 2), (20, 3)]
    a = {r.i for r in tr.seeded_sample(df, ["k"], "i", 5, 1).collect()}
    assert a == {r.i for r in tr.seeded_sample(df.repartition(7), ["k"], "i", 5, 1).collect()} and len(a) == 6


def test_binned_rate_keeps_empty_bins(spark):
    df = spark.createDataFrame([(5.0, True), (10.0, False)], "v double, hit boolean")
    got = {r.bin: (r.n, r.rate) for r in tr.binned_rate(df, "v", F.col("hit"), [0, 10, 20, 30], ["a", "b", "c"]).collect()}
    assert got == {"a": (1, 1.0), "b": (1, 0.0), "c": (0, None)}


def test_every_kth_and_same_value(spark):
    df = spark.range(0, 95).toDF("i")
    assert sorted(r.i for r in vf.every_kth(df, ["i"], 10).collect()) == list(range(0, 90, 9))
    v = spark.createDataFrame([(1.0, 1.0 + 1e-12), (1.0, 1.1), (None, None), (1.0, None)], "a double, b double")
    assert [r.s for r in v.select(vf.same_value(F.col("a"), F.col("b")).alias("s")).collect()] == [True, False, True, False]


@pytest.mark.parametrize("name", ["flowtime_stats", "tracklets", "voxel_iou", "panoptic_summary", "pair_stats", "recall_by_level", "stale_groups"])
def test_registered_queries_agree_with_sql(spark, name):
    import oracle

    sf = "/root/testdata/sf0.001"
    ok, message, _, _ = oracle.compare(spark, oracle.connect(sf), name, sf)
    assert ok, message


def test_every_query_has_a_name_once():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) >= 180


def test_suppression_in_one_task_and_by_rounds(spark):
    rng = random.Random(3)
    rows = []
    for f in (0, 1, None):
        for i in range(60):
            x, y = rng.randrange(30), rng.randrange(30)
            rows.append((f, i, rng.randrange(1, 9) / 10, float(x), float(y), float(x + rng.randrange(0, 12)), float(y + rng.randrange(1, 12))))
    one = sorted(map(repr, sp.suppress_boxes(box_frame(spark, rows), 0.2, 0.4).collect()))
    assert one == sorted(map(repr, sp.suppress_boxes(box_frame(spark, rows), 0.2, 0.4, frame_boxes=10).collect()))
    assert len(one) < len(rows)


def test_cells_of_masks_are_not_broadcast(spark):
    """A file of few bytes may hold many masks of many cells each."""
    few = durable(spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8)], "frame long, lane long, conf double"), "lanes")
    cells = few.select("frame", "lane", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("cell"))
    got = sp.dedup_masks(few, cells, 3, 0.5)
    assert [r.lane for r in got.collect()] == [0]
    for cut in got._jdf.queryExecution().sparkPlan().toString().split("BroadcastHashJoin")[1:]:
        assert "cell" not in cut.split("\n")[0]


def test_pixel_components_over_patches(spark):
    """Parts that wind through patches are the same as in one piece; a null colour links nothing."""
    rng = np.random.default_rng(5)
    rows = [(f, v, u, int(rng.integers(2)) if rng.random() > 0.05 else None, 1.0) for f in range(2) for v in range(16) for u in range(16)]
    px = spark.createDataFrame(rows, "frame long, v int, u int, colour long, depth double")
    colour = {r[:3]: r[3] for r in rows}
    want = {}
    for at in sorted(colour):
        if at not in want:
            want[at], todo = at, [at]
            while todo:
                f, v, u = todo.pop()
                for n in [(f, v + i, u + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if n in colour and n not in want and colour[n] is not None and colour[n] == colour[at]:
                        want[n] = at
                        todo.append(n)
    for patch in (4, 5, 128):
        got = {(r.frame, r.v, r.u): r.component for r in im.pixel_components(px, CAM, patch).collect()}
        assert got == {at: (r[0] * 16 + r[1]) * 16 + r[2] for at, r in want.items()}


def test_copied_cells_are_not_broadcast(spark):
    px = durable(image(spark, np.zeros((1, 16, 16), int)), "pixels")
    seeds = px.select("frame", F.col("u").alias("x"), F.col("v").alias("y"), F.lit(0).alias("z"))
    near = nearest(seeds, seeds, ["frame"])
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().sparkPlan().toString()


def test_containment_is_that_of_every_pixel_around(spark):
    """Points against all mask pixels one by one; the mask is joined by rows, not as nine copies of its pixels."""
    rng = np.random.default_rng(5)
    masks = sorted({(int(f), int(s), int(v), int(u)) for f, s, v, u in rng.integers(0, (3, 2, 16, 16), (160, 4))})
    points = [
        (int(f), int(s), float(x), float(y), 1.0 if rng.random() < 0.9 else -1.0)
        for f, s, x, y in zip(rng.integers(0, 3, 200), rng.integers(0, 3, 200), *rng.uniform(-0.5, 0.5, (2, 200)))
    ]
    poses = spark.createDataFrame([(f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for f in range(3)],
                                  "frame long, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    p = spark.createDataFrame(points, "frame long, segment long, x double, y double, z double")
    m = spark.createDataFrame(masks, "frame long, segment long, v int, u int")
    seen = im.reproject(p, poses, CAM, "round").collect()
    want = {}
    for r in seen:
        near = any((r.frame, r.segment, r.pv + a, r.pu + b) in set(masks) for a in (-1, 0, 1) for b in (-1, 0, 1)) if r.on_image else False
        want.setdefault(r.frame, []).append(near)
    out = im.containment(p, m, poses, CAM)
    got = {r.frame: (r.n_points, round(r.inside, 9)) for r in out.collect()}
    assert got == {f: (len(w), round(sum(w) / len(w), 9)) for f, w in want.items()}
    assert 0 < sum(sum(w) for w in want.values()) < len(points)
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert any("Aggregate" in line for line in lines[at + 1 :])


def masks(spark, seed=7):
    """Lanes and cells of overlapping masks with gaps, a null cell, a null and a missing confidence, and keys without a partner."""
    rng = np.random.default_rng(seed)
    lanes, cells = [], []
    for f in (0, 1, 2, None):
        for lane in range(14):
            conf = (None, float("nan"), *[round(float(rng.random()), 1) for _ in range(12)])[lane]
            lanes.append((f, lane, conf))
            base = int(rng.integers(0, 30)) if lane % 3 else lanes[-1][1] * 5
            cells += [(f, lane, -40 + base + 3 * int(f == 2) * k + k) for k in range(int(rng.integers(2, 40))) if rng.random() < 0.9]
            if lane % 3 == 1:  # nearly a copy of the mask before
                cells += [(f, lane, c) for ff, l, c in list(cells) if ff == f and l == lane - 1 and (f, lane, c) not in cells]
    cells += [(0, 2, None), (0, 99, 5), (None, 3, 1), (1, None, 4)]
    lanes += [(1, 50, 0.99), (1, None, 0.5)]
    return (
        spark.createDataFrame(lanes, "frame long, lane long, conf double"),
        spark.createDataFrame(cells, "frame long, lane long, cell long").repartition(3),
        lanes, cells,
    )


def test_masks_by_frame_and_by_joins(spark):
    """Frames in one task, by joins, some of both, and a plain comparison of all pairs give the same masks."""
    lanes, cells, lane_rows, cell_rows = masks(spark)
    conf = {(f, l): c for f, l, c in lane_rows if f is not None and l is not None}
    area = {k: sum(r[:2] == k for r in cell_rows) for k in conf}
    of = {k: {r[2] for r in cell_rows if r[:2] == k and r[2] is not None} for k in conf}
    live = [k for k in conf if area[k] >= 4]

    def better(a, b):
        if conf[a] is None or conf[b] is None:
            return False
        return conf[a] > conf[b] or (conf[a] != conf[a] and conf[b] == conf[b])

    gone = {
        k for k in live for o in live
        if o[0] == k[0] and better(o, k) and (n := len(of[k] & of[o])) / max(area[k] + area[o] - n, 1) > 0.3
    }
    want = sorted((*k, area[k]) for k in live if k not in gone)
    assert gone and want
    for limits in ({}, {"frame_cells": 10}, {"frame_masks": 14}):
        got = sp.dedup_masks(lanes, cells, 4, 0.3, **limits).collect()
        assert sorted((r.frame, r.lane, r.area) for r in got) == want, limits
        assert all(repr(r.conf) == repr(conf[r.frame, r.lane]) for r in got)


def test_cells_of_masks_share_counts_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    mask, cell = rng.integers(0, 6, 400), rng.integers(-50, 50, 400) * 10**9
    want = np.array([[sum((cell[mask == i][:, None] == cell[mask == j]).ravel()) for j in range(6)] for i in range(6)])
    for block in (1 << 22, 60):
        monkeypatch.setattr(sp, "BLOCK", block)
        assert (sp._shared(mask, cell, 6) == want).all() and (sp._shared(mask, cell // 10**9, 6) == want).all()


def exchanges(df):
    return [x.split("\n")[0] for x in df._jdf.queryExecution().executedPlan().toString().split("Exchange ")[1:]]


def test_cells_of_masks_are_not_shuffled_one_by_one(spark):
    lanes, cells, _, _ = masks(spark)
    out = sp.dedup_masks(lanes, cells.coalesce(1), 4, 0.3)
    assert [x for x in exchanges(out) if "hashpartitioning" in x] and not any("cell" in x for x in exchanges(out))


def test_shuffle_files_go_with_the_write(spark):
    """A table that is written leaves no shuffle files behind, whatever the driver's garbage collector does."""
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    df = spark.range(5000).repartition(5, "id").groupBy((F.col("id") % 100).alias("k")).count()
    before = held()
    out = durable(df, "counts")
    for _ in range(20):  # files are removed in the background
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and out.count() == 100


def test_boxes_and_groups_of_frames(spark):
    """Frames that reach over batches are solved whole, in rank order."""
    rng = np.random.default_rng(9)
    rows = []
    for f in range(40):
        for i in range(int(rng.integers(1, 60))):
            x, y = rng.integers(0, 40, 2)
            rows.append((f, i, float(rng.integers(1, 9) / 10), float(x), float(y), float(x + 20), float(y + 20)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {}
        for r in sp.suppress_boxes(box_frame(spark, rows), 0.2, 0.3).orderBy("frame", "lane").collect():
            got.setdefault(r.frame, []).append(r.det)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {f: k for f in range(40) if (k := greedy([r for r in rows if r[0] == f], 0.2, 0.3))}
    assert got == want


def blob_scene(spark, n_frames=2):
    rng = np.random.default_rng(11)
    img = rng.integers(0, 3, (n_frames, 16, 16))
    depth = rng.choice([0.0, 1.0, 1.1, 3.0], (n_frames, 16, 16))
    return image(spark, img, depth), still(spark, n_frames)


def test_blobs_are_shuffled_by_part_not_by_cell(spark):
    """Pixels meet the samples of their part in one shuffle; no row for a pixel and a cell is ever dealt."""
    px, pts = im.extract_blobs(*blob_scene(spark), CAM, 2, 0.1, 1.5)
    plan = exchanges(px)
    assert any("component" in x for x in plan) and not any(c in x for x in plan for c in ("ix#", "q_x", "_salt"))
    assert not [x for x in exchanges(tr.scale_edges(pts, ["component"])) if "_k#" in x or "ix#" in x]


def test_scale_edges_by_key_and_by_joins(spark):
    """Keys in one task, by joins, and some of both give the same edges."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(12):
        for _ in range(int(rng.integers(1, 40))):
            rows.append((k, len(rows), *(float(x) for x in rng.uniform(-1, 1, 3)), float(rng.choice([0.05, 0.1, 0.11, 0.4, 1.7]))))
    rows += [(5, 10_000, None, 0.0, 0.0, 0.1), (None, 10_001, 0.0, 0.0, 0.0, 0.1), (20, 10_002, 0.0, 0.0, 0.0, 1e-6), (20, 10_003, 1e6, 1e6, 1e6, 1e-6)]
    pts = spark.createDataFrame(rows, "k long, point_id long, x double, y double, z double, radius double").repartition(3)
    want = sorted(tr._scale_edges_by_joins(pts, ["k"]).collect())
    assert (10_003, 10_003) in want
    for most in (1 << 18, 20, 0):
        assert sorted(tr.scale_edges(pts, ["k"], most).collect()) == want


def test_nearest_with_rows(spark):
    """Every query row comes back; groups in one task and by descent agree, ties take the smallest payload."""
    rng = np.random.default_rng(6)
    asks = [(int(g), *(float(x) for x in rng.integers(0, 9, 2)), 0.0, i) for i, g in enumerate(rng.integers(0, 6, 300))]
    asks += [(None, 1.0, 1.0, 0.0, 900), (1, None, 1.0, 0.0, 901), (77, 1.0, 1.0, 0.0, 902)]
    seeds = [(int(g), *(float(x) for x in rng.integers(0, 9, 2)), 0.0, int(b)) for g, b in zip(rng.integers(0, 5, 60), rng.permutation(60))]
    seeds += [(None, 1.0, 1.0, 0.0, 0), (88, 1.0, 1.0, 0.0, 0)]
    q = spark.createDataFrame(asks, "g long, x double, y double, z double, i long").repartition(3)
    r = spark.createDataFrame(seeds, "g long, x double, y double, z double, b long").repartition(2)
    want = {}
    for g, x, y, _, i in asks:
        near = [(((x - s[1]) ** 2 + (y - s[2]) ** 2) ** 0.5, s[4]) for s in seeds if None not in (g, x) and s[0] == g]
        want[i] = min(near) if near else (None, None)
    for pairs in (1 << 24, 700, 0):
        got = {x.i: (x.dist, x.b) for x in nearest(q, r, ["g"], payload=["b"], leaf=2.0, carry=["i"], group_pairs=pairs).collect()}
        assert got == want, pairs


def test_stretches_of_edges_become_stars(spark, monkeypatch):
    """Parts are those of all edges, however few of them a task contracts at once; a part seen whole takes one round."""
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(500, 500)]
    ids = np.array(sorted({x for p in pairs for x in p}))
    root = cc.least_joined(len(ids), *(np.searchsorted(ids, [p[k] for p in pairs]) for k in (0, 1)))
    want = dict(zip(ids.tolist(), ids[root].tolist()))
    edges = spark.createDataFrame(pairs, "a long, b long")
    made = []
    monkeypatch.setattr(cc, "durable", lambda df, name: made.append(name) or durable(df, name))
    for stretch, tasks in ((1 << 20, 1), (10, 1), (1 << 20, 7)):
        monkeypatch.setattr(cc, "STRETCH", stretch)
        made.clear()
        rows = cc.connected_components(edges.repartition(tasks), "a", "b", contract=True).collect()
        assert {r.v: r.component for r in rows} == want and len(rows) == len(want)
        if (stretch, tasks) == (1 << 20, 1):
            assert made.count("cc-parents") == 1
