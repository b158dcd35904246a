import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.sources import profiles, readers, sinks


def png(img, filters=None):
    """Encoder for tests: one filter type per line."""
    h, w = img.shape[:2]
    depth = 16 if img.dtype == np.uint16 else 8
    raw = img.astype(">u2").view(np.uint8).reshape(h, -1) if depth == 16 else img.reshape(h, -1)
    ch = img.shape[2] if img.ndim == 3 else 1
    bpp = ch * depth // 8
    lines = []
    for y in range(h):
        mode = (filters or [0] * h)[y]
        cur = raw[y].astype(int)
        up = raw[y - 1].astype(int) if y else np.zeros_like(cur)
        left = np.concatenate([np.zeros(bpp, int), cur[:-bpp]])
        ul = np.concatenate([np.zeros(bpp, int), up[:-bpp]])
        if mode == 4:
            p = left + up - ul
            d = np.stack([abs(p - left), abs(p - up), abs(p - ul)])
            pred = np.choose(d.argmin(0), [left, up, ul])
        else:
            pred = [0 * cur, left, up, (left + up) // 2][mode]
        lines.append(bytes([mode]) + ((cur - pred) & 255).astype(np.uint8).tobytes())

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, depth, {1: 0, 3: 2}[ch], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("dtype,ch", [(np.uint8, 1), (np.uint16, 1), (np.uint8, 3)])
def test_png_filters(dtype, ch):
    rng = np.random.default_rng(0)
    shape = (10, 7, ch) if ch > 1 else (10, 7)
    img = rng.integers(0, np.iinfo(dtype).max, shape).astype(dtype)
    assert np.array_equal(readers.png_array(png(img, [0, 1, 2, 3, 4] * 2)), img)


def test_rasters_and_clouds(spark, tmp_path):
    img = np.arange(12, dtype=np.uint16).reshape(3, 4) * 1000
    (tmp_path / "000007.png").write_bytes(png(img))
    got = readers.rasters(spark, str(tmp_path)).collect()
    assert {(r.frame, r.v, r.u, r.value) for r in got} == {(7, v, u, int(img[v, u])) for v in range(3) for u in range(4)}
    buf = io.BytesIO()
    np.savez(buf, segment_ids=[1, 2], gt_object_ids=[10, 20], offsets=[0, 1, 3], points=np.arange(9, dtype=np.float32).reshape(3, 3))
    (tmp_path / "000003.npz").write_bytes(buf.getvalue())
    c = readers.frame_clouds(spark, str(tmp_path)).orderBy("x").collect()
    assert [(r.frame, r.segment_id, r.gt_object_id, r.z) for r in c] == [(3, 1, 10, 2.0), (3, 2, 20, 5.0), (3, 2, 20, 8.0)]


def test_sequence_and_transforms(spark, tmp_path):
    for n in ("rgb", "depth", "seg"):
        (tmp_path / f"{n}.csv").write_text("stamp_ns,filename\n1,a.png\n2,b.png\n")
    assert readers.open_sequence(spark, str(tmp_path)).count() == 2
    (tmp_path / "seg.csv").write_text("stamp_ns,filename\n1,a.png\n")
    with pytest.raises(Exception, match="not in all indexes"):
        readers.open_sequence(spark, str(tmp_path)).collect()
    head = "frame_id,child_frame_id,tx,ty,tz,qx,qy,qz,qw\n"
    (tmp_path / "tf.csv").write_text(head + "a,b,1,0,0,0,0,0,1\na,c,5,0,0,0,0,0,1\na,b,2,0,0,0,0,0,1\n")
    tf = readers.static_transforms(spark, str(tmp_path / "tf.csv")).collect()
    assert {(r.child_frame_id, r.tx) for r in tf} == {("b", 2.0), ("c", 5.0)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "seg.csv").write_text(
        "frame_idx,segment_id,stamp_ns,gt_object_id,n_pixels,n_points_strided,mean_depth_m,is_dynamic,is_far\n"
        "0,1,5,9,4,1,,0,True\n1,1,6,9,0,1,2.5,0,1\n"
    )
    s = readers.entity(spark, str(tmp_path / "seg.csv"), "segments").orderBy("frame_idx").collect()
    assert (s[0].mean_depth_m, s[0].is_dynamic, s[0].is_far, s[1].is_far) == (None, False, True, True)
    assert readers.seen_segments(spark, str(tmp_path / "seg.csv")).count() == 1
    (tmp_path / "run.log").write_text("ok\noverflow: n_conf 3\noverflow: n_conf 4\n")
    assert readers.pattern_counts(spark, str(tmp_path / "run.log"), "overflow: n_conf").first().n == 2
    assert readers.optional_json(spark, str(tmp_path / "none.json"), "n_frames long") is None
    assert readers.settings("A=1\n# x\nexport B='2'\n", {"B": "9"}) == {"A": "1", "B": "9"}
    assert readers.topic_spec("/pose=pose_cov:be") == {"topic": "/pose", "kind": "pose_cov", "best_effort": True}


def test_binary_columns(spark):
    bits = np.zeros(16, np.uint8)
    bits[[1, 9, 15]] = 1
    pts = np.zeros((2, 20), np.uint8)
    pts[:, :12] = np.arange(6, dtype="<f4").reshape(2, 3).view(np.uint8)
    df = spark.createDataFrame([(1, bytearray(np.packbits(bits).tobytes()), bytearray(pts.tobytes()))], "obs long, m binary, d binary")
    assert [r.cell for r in readers.mask_cells(df, ["obs"], "m", 15).collect()] == [1, 9]
    assert [(r.x, r.z) for r in readers.message_points(df, ["obs"], "d", 20).collect()] == [(0.0, 2.0), (3.0, 5.0)]


def test_messages_round_trip(spark):
    rows = spark.createDataFrame(
        [(7, 2, 1, [1.0, 2.0, 3.0], 0.5, 0.9), (7, 1, 2, [0.0] * 6, 0.25, 0.8), (8, 3, 0, [], 0.0, 0.1)],
        "stamp_ns long, tracklet_id long, points_num long, points array<float>, depth_valid_ratio float, seg_conf float",
    )
    back = readers.tracklet_messages(sinks.tracklet_messages(rows)).select(*rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "id long, v double")
    p = str(tmp_path / "t")
    assert sinks.write_if_changed(df, p)
    assert not sinks.write_if_changed(df.orderBy(F.desc("id")), p)
    assert sinks.write_if_changed(df.where("id = 1"), p)
    assert spark.read.parquet(p).count() == 1
    sinks.write_document(df, str(tmp_path / "doc"))
    assert spark.read.schema("id long, v double").json(str(tmp_path / "doc")).where("v IS NULL").count() == 1
    sinks.archive(df, str(tmp_path / "hist"), "001", {"code": "abc"})
    with pytest.raises(Exception):
        sinks.archive(df, str(tmp_path / "hist"), "001", {"code": "abc"})
    assert sinks.history(spark, str(tmp_path / "hist")).count() == 2
    sinks.write_csv(df, str(tmp_path / "csv"), ["late", "id", "v", "none"], ["late"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "v", "none", "late"]
    wide = sinks.wide_by_tau(spark.createDataFrame([(1, 10, 0.5), (1, 20, 0.7)], "k long, tau int, iou double"), ["k"], "tau", [10, 20], ["iou"])
    assert wide.first().asDict() == {"k": 1, "iou@10": 0.5, "iou@20": 0.7}
    with pytest.raises(Exception, match="row counts differ"):
        sinks.with_new_column(df, df.where("id = 1").select("id", F.lit(1).alias("c")), ["id"]).collect()


def test_module_report(spark):
    a = spark.createDataFrame(
        [("/camera/rgb", 1, 100, 0), ("/camera/rgb", 2, 200, 1), ("/segment_image", 1, 600100, 2), ("/segment_image", 1, 700000, 3)],
        "topic string, stamp_ns long, recv_us long, seq long",
    )
    r = profiles.SCORERS["seg"](a).first()
    assert (r.frames_played, r.sets_received, r.frames_dropped, r.n) == (2, 2, 0, 1)
    assert r.median_s == pytest.approx(0.6)
    assert profiles.SCORERS["updater"](a).count() == 2
    empty = profiles.SCORERS["clip"](a).first()
    assert (empty.n, empty.median_s) == (0, None)


def test_camera_and_poses(spark, tmp_path):
    (tmp_path / "cam.yaml").write_text("K: [1, 0, 3, 0, 5, 6, 0, 0, 1]\nD: [0.1]\nwidth: 640\nheight: 480\nframe_id: left\n")
    got = readers.camera_info(str(tmp_path / "cam.yaml"))
    assert got == {"K": [1.0, 0, 3, 0, 5, 6, 0, 0, 1], "D": [0.1], "width": 640, "height": 480, "frame_id": "left"}
    (tmp_path / "opencv.yaml").write_text("camera_matrix: {rows: 3, data: [2, 0, 0, 0, 2, 0, 0, 0, 1]}\nwidth: 6\nheight: 4\n")
    assert readers.camera_info(str(tmp_path / "opencv.yaml"))["K"][0] == 2.0
    names = [f"{f}_{c}" for f in ("base", "cam") for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")]
    (tmp_path / "poses.csv").write_text(",".join(["frame_idx", *names]) + "\n7," + ",".join(map(str, range(14))) + "\n")
    path = str(tmp_path / "poses.csv")
    assert readers.poses(spark, path, "base").first().asDict() == dict(zip(["frame_idx", *(n[5:] for n in names[:7])], [7, *map(float, range(7))], strict=True))
    assert readers.poses(spark, path, "cam").first().tx == 7.0


def test_stored_tracklets_are_read_in_part(spark, tmp_path):
    schema = "tracklet_id long, gt_object_id long, color_hex string, extent_m double, points array<double>"
    df = spark.createDataFrame([(1, 9, "#ff0000", 0.5, [1.0]), (2, 9, "#00ff00", 1.5, [2.0]), (3, 8, "#0000ff", 2.5, [])], schema)
    sinks.write_entity(df, str(tmp_path / "t"))
    assert sorted(r.tracklet_id for r in readers.tracklets(spark, str(tmp_path / "t"), [1, 3]).collect()) == [1, 3]
    index = readers.tracklets(spark, str(tmp_path / "t"), None, ["tracklet_id", "color_hex", "extent_m"])
    assert index.columns == ["tracklet_id", "color_hex", "extent_m"] and index.count() == 3
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "points" not in plan.split("ReadSchema")[1]
    sinks.write_entity(df.withColumn("sequence", F.lit("a")), str(tmp_path / "by"), "sequence")
    assert spark.read.parquet(str(tmp_path / "by")).where("sequence = 'a'").count() == 3


def test_visibility_difficulty_and_labels(spark, tmp_path):
    sinks.write_entity(spark.createDataFrame([(1, 5, 40, 30)], "ep_index int, frame int, px_full int, px_crop int"), str(tmp_path / "vis"))
    assert readers.entity(spark, str(tmp_path / "vis"), "gt_vis").first().px_crop == 30
    (tmp_path / "diff.csv").write_text("frame,ep_index,trunc,occ,min_dim,sil_px,vis_px,level,at_border,sil_total_px\n5,1,0.5,0.25,30,90,80,1,1,100\n")
    r = readers.entity(spark, str(tmp_path / "diff.csv"), "difficulty").first()
    assert (r.frame, r.ep_index, r.level, r.at_border, r.sil_total_px) == (5, 1, 1, True, 100)
    labels = spark.createDataFrame([(5, 0, 0, 1), (5, 0, 1, 0), (6, 1, 1, 2)], "frame int, v int, u int, value int")
    sinks.write_entity(labels, str(tmp_path / "labels"))
    asked = spark.createDataFrame([(5,)], "frame int")
    assert readers.labels_of(spark, str(tmp_path / "labels"), asked).count() == 2
    with pytest.raises(Exception, match="no label image of frame 7"):
        readers.labels_of(spark, str(tmp_path / "labels"), asked.union(spark.createDataFrame([(7,)], "frame int"))).collect()
    digest = sinks.digest_of(labels)
    sinks.write_document(spark.createDataFrame([("v3", "x")], "version string, digest string"), str(tmp_path / "meta"))
    r = readers.label_provenance(spark, str(tmp_path / "labels"), str(tmp_path / "meta")).first()
    assert (r.version, r.recorded, r.intact) == ("v3", "x", False) and digest[0] == 3
    sinks.write_document(spark.createDataFrame([("v3", r.digest)], "version string, digest string"), str(tmp_path / "meta"))
    assert readers.label_provenance(spark, str(tmp_path / "labels"), str(tmp_path / "meta")).first().intact


def test_scores_of_an_old_layout_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "ep_index long, iou double")
    assert readers.require(df, ["ep_index", "iou"], "score") is df
    with pytest.raises(ValueError, match="gt_iou.*score the run again"):
        readers.require(df, ["ep_index", "gt_iou"], "score")
    up = sinks.with_defaults(df, {"iou": F.lit(0.0), "level": F.lit("easy")}).first()
    assert (up.iou, up.level) == (0.5, "easy")
    (tmp_path / "s.json").write_text('{"sequence": "a", "n": 3}\n{"sequence": "b"}\n')
    assert readers.summaries(spark, str(tmp_path / "s.json"), "sequence string, n long", ["sequence"]).count() == 2
    with pytest.raises(Exception, match="without required fields"):
        readers.summaries(spark, str(tmp_path / "s.json"), "sequence string, n long", ["sequence", "n"]).collect()


def test_capture_is_checked_whole(spark):
    kf = [(0, 10, 100, 2, 0), (1, 12, 120, 0, 2), (2, 14, 140, 1, 2)]
    obs = [(0, 0, 7, 3, 0), (1, 0, 8, 0, 3), (2, 2, 7, 2, 3)]
    kf_schema = "kf long, frame_idx long, stamp_ns long, n_obs long, obs_start long"
    obs_schema = "obs long, kf_index long, tracklet_id long, points_num long, points_start long"
    frames = spark.createDataFrame([(10, 100), (12, 120), (14, 140)], "frame_idx long, stamp_ns long")
    points = spark.createDataFrame([(i, float(i)) for i in range(5)], "at long, x double")

    def faults(kf, obs, points=points):
        found = sinks.check_capture(spark.createDataFrame(kf, kf_schema), spark.createDataFrame(obs, obs_schema), frames, points)
        return {(r.kf, r.fault) for r in found.collect()}

    assert faults(kf, obs) == set()
    assert faults([kf[0], kf[1], (2, 14, 140, 2, 2)], obs) == {(2, "n_obs")}
    assert faults([kf[0], (1, 12, 121, 0, 1), kf[2]], obs) == {(1, "stamp"), (1, "obs_start")}
    assert faults(kf, [obs[0], (1, 0, 8, 0, 4), obs[2]]) == {(0, "points")}
    assert faults(kf, obs, points.where("at < 4")) == {(2, "points")}
    got = readers.observed_points(spark.createDataFrame(obs, obs_schema), points).collect()
    assert sorted((r.obs, r.tracklet_id, r.at, r.x) for r in got) == [(0, 7, 0, 0.0), (0, 7, 1, 1.0), (0, 7, 2, 2.0), (2, 7, 3, 3.0), (2, 7, 4, 4.0)]
