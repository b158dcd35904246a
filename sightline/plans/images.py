"""Reports on label and depth images built from the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import imaging as im
from sightline.operators import suppression as sp
from sightline.operators import voxels as vx
from sightline.plans.registry import query
from sightline.plans.segmentation import PAIRS_SQL, scene
from sightline.plans.streams import event_stream
from sightline.plans.truthset import scale_sql
from sightline.session import durable
from sightline.sources import tables as t
from sightline.streaming import discovery

CAM = im.Camera(40.0, 40.0, 24.0, 24.0, t.IMAGE_W, t.IMAGE_H)


@query("unproject", f"""WITH {t.RGBD_SQL}
SELECT frame, colour, count(*) AS n, round(sum((u - 24.0) / 40.0 * depth + frame * 0.05), 6) AS sum_x, round(max((v - 24.0) / 40.0 * depth), 6) AS max_y
FROM rgbd WHERE v % 2 = 0 AND u % 2 = 0 AND depth > 0 GROUP BY ALL""")
def unproject(spark, sf):
    """World points of the strided pixels, summed up per frame and colour."""
    px = t.rgbd(spark, sf)
    w = im.to_world(im.unproject(px, CAM, 2), t.camera_poses(px))
    return w.groupBy("frame", "colour").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 6).alias("sum_x"), F.round(F.max("y"), 6).alias("max_y")
    )


# Labels spread from pixels without an earlier neighbour of their colour; the earliest that arrives names the part.
@query("pixel_components", f"""WITH RECURSIVE {t.RGBD_SQL},
px AS (SELECT frame, colour, v, u, frame * {t.IMAGE_W * t.IMAGE_H} + v * {t.IMAGE_W} + u AS id FROM rgbd),
ed AS (SELECT a.id AS a, b.id AS b FROM px a JOIN px b ON a.frame = b.frame AND a.colour = b.colour AND a.id <> b.id AND b.v BETWEEN a.v - 1 AND a.v + 1 AND b.u BETWEEN a.u - 1 AND a.u + 1),
re AS (SELECT id AS root, id FROM px WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.a = px.id AND ed.b < px.id)
  UNION SELECT re.root, ed.b FROM re JOIN ed ON ed.a = re.id)
SELECT frame, colour, component, count(*) AS n_px FROM px JOIN (SELECT id, min(root) AS component FROM re GROUP BY id) USING (id) GROUP BY ALL""")
def pixel_components(spark, sf):
    """Size of every 8-connected part of one colour."""
    c = im.pixel_components(t.rgbd(spark, sf), CAM)
    return c.groupBy("frame", "colour", "component").agg(F.count(F.lit(1)).alias("n_px"))


# A pixel of a part goes to the sampled pixel of the part that is nearest in the image, of equals to the smallest blob.
@query("blobs", f"""WITH RECURSIVE {t.RGBD_SQL},
px AS (SELECT frame, colour, v, u, depth, frame * {t.IMAGE_W * t.IMAGE_H} + v * {t.IMAGE_W} + u AS id FROM rgbd),
ed AS (SELECT a.id AS a, b.id AS b FROM px a JOIN px b ON a.frame = b.frame AND a.colour = b.colour AND a.id <> b.id AND b.v BETWEEN a.v - 1 AND a.v + 1 AND b.u BETWEEN a.u - 1 AND a.u + 1),
re AS (SELECT id AS root, id FROM px WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.a = px.id AND ed.b < px.id)
  UNION SELECT re.root, ed.b FROM re JOIN ed ON ed.a = re.id),
co AS (SELECT px.*, component FROM px JOIN (SELECT id, min(root) AS component FROM re GROUP BY id) USING (id)),
sa AS (SELECT component, id AS point_id, v, u, depth, (u - 24.0::DOUBLE) / 40.0::DOUBLE * depth + frame * 0.05::DOUBLE AS x, (v - 24.0::DOUBLE) / 40.0::DOUBLE * depth AS y, depth AS z,
  greatest({im.SPLIT_CELL_M}::DOUBLE, (3.0::DOUBLE * 2 / 40.0::DOUBLE) * depth) AS radius FROM co WHERE v % 2 = 0 AND u % 2 = 0 AND depth > 0),
{scale_sql("sa", "component")},
sb AS (SELECT sa.*, part AS blob FROM sa JOIN sc USING (point_id)),
nb AS (SELECT co.id, arg_min(sb.blob, ((co.v - sb.v) * (co.v - sb.v) + (co.u - sb.u) * (co.u - sb.u), sb.blob)) AS blob FROM co JOIN sb USING (component) GROUP BY co.id),
a AS (SELECT frame, colour, coalesce(nb.blob, component) AS blob, count(*) AS n_px FROM co LEFT JOIN nb USING (id) GROUP BY ALL),
b AS (SELECT blob, count(*) AS n_points, avg(depth) AS mean_depth FROM sb GROUP BY blob)
SELECT frame, colour, blob, n_px, coalesce(n_points, 0) AS n_points, coalesce(mean_depth, 0) AS mean_depth FROM a LEFT JOIN b USING (blob)""")
def blobs(spark, sf):
    px = durable(t.rgbd(spark, sf), "rgbd")
    out, pts = im.extract_blobs(px, t.camera_poses(px), CAM, 2, im.SPLIT_CELL_M, 3.0)
    return im.blob_stats(out, pts)


@query("reprojection_containment", f"""WITH {t.RGBD_SQL} SELECT frame, count(*) AS n_points, 1.0::DOUBLE AS inside
FROM rgbd WHERE v % 2 = 0 AND u % 2 = 0 GROUP BY frame""")
def reprojection_containment(spark, sf):
    """Back-projected points must fall into their own mask again."""
    px = durable(t.rgbd(spark, sf), "rgbd")
    poses = t.camera_poses(px)
    pts = im.to_world(im.unproject(px, CAM, 2), poses).select("frame", F.col("colour").alias("segment"), *vx.XYZ)
    masks = px.select("frame", F.col("colour").alias("segment"), "v", "u")
    return im.containment(pts, masks, poses, CAM)


@query("frame_shift", f"""WITH {t.RGBD_SQL},
de AS (SELECT frame, v, u, (u - 24.0) / 40.0 * depth + frame * 0.05 AS x, (v - 24.0) / 40.0 * depth AS y, depth AS z FROM rgbd WHERE depth > 0),
p AS (SELECT *, frame + shift AS target FROM de, (SELECT unnest([-1, 0, 1]) AS shift) WHERE v % 2 = 0 AND u % 2 = 0)
SELECT shift::BIGINT AS shift, count(*) AS n_points, avg((EXISTS (SELECT 1 FROM de d WHERE d.frame = p.target AND sqrt((d.x-p.x)*(d.x-p.x)+(d.y-p.y)*(d.y-p.y)+(d.z-p.z)*(d.z-p.z)) <= 0.001))::INT) AS within_share
FROM p WHERE target IN (SELECT frame FROM de) GROUP BY shift""")
def frame_shift(spark, sf):
    """Share of exact hits against the previous, same and next frame."""
    px = durable(t.rgbd(spark, sf), "rgbd")
    poses = t.camera_poses(px)
    dense = durable(im.to_world(im.unproject(px, CAM), poses).select("frame", *vx.XYZ), "dense")
    pts = im.to_world(im.unproject(px, CAM, 2), poses).select("frame", *vx.XYZ)
    return im.frame_shift(pts, dense, 0.001)


@query("silhouettes", f"""WITH {t.RGBD_SQL},
p AS (SELECT frame, colour AS episode, ((u - 24.0) / 40.0 * depth + frame * 0.05::DOUBLE) * 1.6::DOUBLE - frame * 0.05::DOUBLE AS cx, (v - 24.0) / 40.0 * depth AS cy, depth AS cz
  FROM rgbd WHERE v % 2 = 0 AND u % 2 = 0 AND depth > 0),
q AS (SELECT *, 40.0::DOUBLE * cx / cz + 24.0 AS pu, 40.0::DOUBLE * cy / cz + 24.0 AS pv, pow(0.02::DOUBLE * 40.0 / greatest(cz, 0.1), 2) AS foot, greatest(1, least(12, ceil(0.5::DOUBLE * 0.02 * 40.0 / cz)))::INT AS r FROM p),
d AS (SELECT *, cz > 0.1 AND pu > -{t.IMAGE_W} AND pu < {2 * t.IMAGE_W} AND pv > -{t.IMAGE_H} AND pv < {2 * t.IMAGE_H} AS drawn FROM q),
k AS (SELECT DISTINCT frame, episode, trunc(pu)::INT + {t.IMAGE_W} AS u, trunc(pv)::INT + {t.IMAGE_H} AS v, r FROM d WHERE drawn),
rw AS (SELECT frame, episode, u, v + dv AS v, round_even(sqrt(r * r - dv * dv), 0)::INT AS half FROM (SELECT *, unnest(generate_series(-r, r)) AS dv FROM k)),
ce AS (SELECT DISTINCT frame, episode, v, u + du AS u FROM (SELECT *, unnest(generate_series(-half, half)) AS du FROM rw)),
ar AS (SELECT frame, episode, count(*) FILTER (WHERE u BETWEEN {t.IMAGE_W} AND {2 * t.IMAGE_W - 1} AND v BETWEEN {t.IMAGE_H} AND {2 * t.IMAGE_H - 1}) AS sil_px, count(*) AS canvas
  FROM ce WHERE u BETWEEN 0 AND {3 * t.IMAGE_W - 1} AND v BETWEEN 0 AND {3 * t.IMAGE_H - 1} GROUP BY ALL),
fo AS (SELECT frame, episode, sum(foot) FILTER (WHERE drawn) AS fd, coalesce(sum(foot) FILTER (WHERE NOT drawn), 0) AS fo FROM d GROUP BY ALL),
tt AS (SELECT frame, episode, coalesce(sil_px, 0) AS sil_px, round_even(coalesce(canvas, 0) + CASE WHEN coalesce(canvas, 0) > 0 THEN canvas / greatest(coalesce(fd, 0), 1e-9) ELSE 1 END * fo, 0)::BIGINT AS sil_total_px
  FROM fo LEFT JOIN ar USING (frame, episode))
SELECT *, CASE WHEN sil_total_px > 0 THEN 1 - sil_px / sil_total_px ELSE 0 END AS trunc FROM tt""")
def silhouettes(spark, sf):
    px = durable(t.rgbd(spark, sf), "rgbd")
    poses = t.camera_poses(px)
    pts = im.to_world(im.unproject(px, CAM, 2), poses).select(
        "frame", F.col("colour").alias("episode"), (F.col("x") * 1.6).alias("x"), "y", "z"
    )
    return im.silhouettes(pts, poses, CAM)


def episode_clouds(spark, sf):
    p = t.points(spark, sf)
    return p.select(
        (F.col("cloud") % 3).alias("colour"), F.col("cloud").alias("episode"), (F.col("cloud") * 2).alias("first_frame"),
        (F.col("cloud") * 2 + 8).alias("last_frame"), *vx.XYZ,
    )


def sample_points(spark, sf):
    p = t.points(spark, sf)
    return p.select(
        F.col("point_id").alias("pixel"), (F.col("point_id") % 24).alias("frame"), (F.col("point_id") % 3).alias("colour"),
        (F.col("point_id") % 48).alias("u"), F.floor(F.col("point_id") / 12).alias("component"),
        (F.col("x") + 0.01).alias("x"), (F.col("y") - 0.01).alias("y"), F.col("z").alias("z"),
    )


_HITS = f"""WITH {t.POINTS_SQL},
cl AS (SELECT cloud % 3 AS colour, cloud AS episode, cloud * 2 AS f0, cloud * 2 + 8 AS f1, x, y, z FROM pts),
sm AS (SELECT point_id AS pixel, point_id % 24 AS frame, point_id % 3 AS colour, point_id % 48 AS u, point_id // 12 AS component,
  x + 0.01::DOUBLE AS x, y - 0.01::DOUBLE AS y, z FROM pts),
hits AS (SELECT sm.pixel, sm.frame, sm.u, sm.component, episode,
   min(sqrt((sm.x-cl.x)*(sm.x-cl.x)+(sm.y-cl.y)*(sm.y-cl.y)+(sm.z-cl.z)*(sm.z-cl.z))) AS d
  FROM sm JOIN cl ON sm.colour = cl.colour AND sm.frame BETWEEN f0 AND f1 GROUP BY ALL HAVING d < 0.06)"""


@query("cloud_visibility", _HITS + """
SELECT episode, frame, count(*) * 4 AS px_full, count(*) FILTER (WHERE u >= 4 AND u < 44) * 4 AS px_crop FROM hits GROUP BY ALL""")
def cloud_visibility(spark, sf):
    """Visible pixels per episode and frame from points near the episode clouds of their colour."""
    hits = im.cloud_hits(sample_points(spark, sf), episode_clouds(spark, sf))
    return im.visible_pixels(hits, 2, (4, 44))


@query("label_votes", _HITS + """,
b AS (SELECT component, pixel, arg_min(episode, (d, episode)) AS label FROM hits GROUP BY ALL),
v AS (SELECT component, label, count(*) AS c FROM b GROUP BY ALL),
w AS (SELECT component, sum(c)::BIGINT AS n_votes, arg_max(label, (c, -label)) AS winner, max(c) AS n_winner FROM v GROUP BY ALL),
n AS (SELECT component, count(*) AS n_samples FROM sm GROUP BY ALL)
SELECT component, n_votes, winner, n_samples, CASE WHEN n_votes / n_samples < 0.5 THEN 'test' WHEN n_winner / n_votes >= 0.9 THEN 'fill' ELSE 'seed' END AS mode
FROM w JOIN n USING (component)""")
def label_votes(spark, sf):
    s = durable(sample_points(spark, sf), "samples")
    hits = im.cloud_hits(s, episode_clouds(spark, sf))
    return im.label_parts(s, hits, 0.5, 0.9).select("component", "n_votes", "winner", "n_samples", "mode")


@query("verify_far", f"""WITH {t.POINTS_SQL}, q AS (SELECT point_id, (cloud + 1) % 10 AS object, x, y, z FROM pts)
SELECT point_id, object, EXISTS (SELECT 1 FROM pts p WHERE p.cloud = q.object
  AND sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) < 0.06)::INT AS verified FROM q""")
def verify_far(spark, sf):
    p = t.points(spark, sf)
    q = p.select("point_id", ((F.col("cloud") + 1) % 10).alias("object"), *vx.XYZ)
    v = im.verify_far(q, p.select(F.col("cloud").alias("object"), *vx.XYZ))
    return v.select("point_id", "object", F.col("verified").cast("int").alias("verified"))


@query("merged_mates", f"""WITH {PAIRS_SQL}, c AS (SELECT frame, pred, gt FROM pairs WHERE covers_gt)
SELECT a.frame, a.pred, a.gt, string_agg(b.gt::VARCHAR, ',' ORDER BY b.gt) AS mates FROM c a JOIN c b
  ON a.frame = b.frame AND a.pred = b.pred AND a.gt <> b.gt GROUP BY ALL""")
def merged_mates(spark, sf):
    pairs = scene(spark, sf)[2]
    m = im.merged_mates(pairs.where("covers_gt").select("frame", "pred", "gt"))
    return m.withColumn("mates", F.array_join(F.transform("mates", lambda x: x.cast("string")), ","))


@query("object_verdicts", """WITH e AS (SELECT l_suppkey AS object, l_partkey, sum(l_quantity)::BIGINT AS max_px, max((l_returnflag = 'R' AND l_tax > 0.07)::INT) AS detected,
  CASE l_partkey % 4 WHEN 0 THEN 'merged' WHEN 1 THEN 'split' WHEN 2 THEN 'low_iou' ELSE 'missed' END AS r FROM lineitem GROUP BY ALL),
b AS (SELECT object, count(*) FILTER (WHERE max_px >= 60) AS n_eligible, bool_or(max_px >= 60 AND detected = 1) AS found, max(max_px) AS max_px FROM e GROUP BY 1),
c AS (SELECT object, r, count(*) AS n FROM e WHERE max_px >= 60 GROUP BY ALL),
k AS (SELECT object, r FROM c QUALIFY row_number() OVER (PARTITION BY object ORDER BY n DESC, list_position(['merged','split','low_iou','missed'], r)) = 1)
SELECT object, n_eligible, max_px, CASE WHEN n_eligible = 0 THEN CASE WHEN max_px = 0 THEN 'not_visible' ELSE 'too_small' END
  WHEN found THEN 'detected' ELSE r END AS verdict FROM b LEFT JOIN k USING (object)""")
def object_verdicts(spark, sf):
    """One verdict per object from its episodes."""
    li = t.table(spark, sf, "lineitem")
    reason = F.element_at(F.array(*[F.lit(s) for s in ("merged", "split", "low_iou", "missed")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    e = li.groupBy(F.col("l_suppkey").alias("object"), "l_partkey").agg(
        F.sum("l_quantity").cast("long").alias("max_px"),
        F.max(((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07)).cast("int")).alias("detected"),
    ).withColumn("miss_reason", reason)
    return im.object_verdicts(e, 60, ("merged", "split", "low_iou", "missed"))


def boxes(spark, sf):
    li = t.table(spark, sf, "lineitem")
    # Rows go to their frame once; what is grouped within a frame after that stays there.
    rows = li.select(
        F.floor(F.col("l_orderkey") / 64).alias("frame"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("det"),
        "l_quantity", (F.col("l_partkey") % 60).alias("x"), (F.col("l_suppkey") % 60).alias("y"),
    ).repartition("frame")
    x, y = F.col("x"), F.col("y")
    return rows.groupBy("frame", "det").agg(
        F.max(F.col("l_quantity") / 50).alias("conf"), F.min(x).cast("double").alias("x1"), F.min(y).cast("double").alias("y1"),
        F.max(x + 20).cast("double").alias("x2"), F.max(y + 20).cast("double").alias("y2"),
    )


_BOXES = """RECURSIVE bx AS (SELECT l_orderkey // 64 AS frame, l_orderkey * 8 + l_linenumber AS det, max(l_quantity / 50) AS conf,
  min(l_partkey % 60)::DOUBLE AS x1, min(l_suppkey % 60)::DOUBLE AS y1, max(l_partkey % 60 + 20)::DOUBLE AS x2, max(l_suppkey % 60 + 20)::DOUBLE AS y2
  FROM lineitem GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, det) AS n FROM bx WHERE conf > 0.2),
sel AS (SELECT DISTINCT frame, 0::BIGINT AS n, []::STRUCT(det BIGINT, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept FROM rk
  UNION ALL
  SELECT s.frame, r.n, CASE WHEN len(list_filter(s.kept, lambda k: greatest(least(k.x2, r.x2) - greatest(k.x1, r.x1), 0) * greatest(least(k.y2, r.y2) - greatest(k.y1, r.y1), 0)
      / ((k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)
        - greatest(least(k.x2, r.x2) - greatest(k.x1, r.x1), 0) * greatest(least(k.y2, r.y2) - greatest(k.y1, r.y1), 0) + 1e-9) > 0.5)) > 0
    THEN s.kept ELSE list_append(s.kept, {'det': r.det, 'conf': r.conf, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}) END
  FROM sel s JOIN rk r ON r.frame = s.frame AND r.n = s.n + 1),
fin AS (SELECT frame, kept FROM sel QUALIFY row_number() OVER (PARTITION BY frame ORDER BY n DESC) = 1),
box AS (SELECT frame, unnest(kept) AS k, unnest(generate_series(0, len(kept) - 1)) AS lane FROM fin WHERE len(kept) > 0)"""


@query("suppressed_boxes", f"""WITH {_BOXES}
SELECT frame, k.det AS det, lane, k.conf AS conf, k.x1 AS x1, k.y1 AS y1, k.x2 AS x2, k.y2 AS y2 FROM box""")
def suppressed_boxes(spark, sf):
    """Best boxes of every frame without overlaps."""
    return sp.suppress_boxes(boxes(spark, sf), 0.2, 0.5)


@query("box_overflow", f"""WITH {_BOXES}
SELECT frame, n_confident, coalesce(len(kept), 0) AS n_kept, greatest(n_confident - 64, 0) AS over_candidates, greatest(coalesce(len(kept), 0) - 8, 0) AS over_lanes
FROM (SELECT frame, count(*) FILTER (WHERE conf > 0.2) AS n_confident FROM bx GROUP BY frame) LEFT JOIN fin USING (frame)""")
def box_overflow(spark, sf):
    """What limits of 64 candidates and 8 lanes would leave out of every frame."""
    b = boxes(spark, sf)
    return sp.overflow(b, sp.suppress_boxes(b, 0.2, 0.5), 0.2, 64, 8)


@query("deduplicated_masks", f"""WITH {_BOXES},
cl AS (SELECT frame, lane, k.conf AS conf, r * 100 + c AS cell FROM box,
  LATERAL (SELECT unnest(generate_series(floor(k.y1 / 4)::BIGINT, floor(k.y2 / 4)::BIGINT)) AS r) , LATERAL (SELECT unnest(generate_series(floor(k.x1 / 4)::BIGINT, floor(k.x2 / 4)::BIGINT)) AS c)),
ar AS (SELECT frame, lane, conf, count(*) AS area FROM cl GROUP BY ALL HAVING count(*) >= 20),
io AS (SELECT a.frame, a.lane, b.lane AS other, count(*) AS n FROM cl a JOIN cl b ON a.frame = b.frame AND a.cell = b.cell AND b.conf > a.conf GROUP BY ALL)
SELECT frame, lane, conf, area FROM ar a WHERE NOT EXISTS (SELECT 1 FROM io JOIN ar b ON b.frame = io.frame AND b.lane = io.other
  WHERE io.frame = a.frame AND io.lane = a.lane AND io.n / greatest(a.area + b.area - io.n, 1) > 0.3)""")
def deduplicated_masks(spark, sf):
    """Masks of the kept boxes with copies of more confident ones removed."""
    lanes = sp.suppress_boxes(boxes(spark, sf), 0.2, 0.5)
    rows = F.sequence(F.floor(F.col("y1") / 4), F.floor(F.col("y2") / 4))
    cols = F.sequence(F.floor(F.col("x1") / 4), F.floor(F.col("x2") / 4))
    cells = lanes.select("frame", "lane", F.explode(rows).alias("r"), cols.alias("_c")).select(
        "frame", "lane", "r", F.explode("_c").alias("c")
    ).select("frame", "lane", (F.col("r") * 100 + F.col("c")).alias("cell"))
    return sp.dedup_masks(lanes.select("frame", "lane", "conf"), cells, 20, 0.3)


@query("stream_discovery")
def stream_discovery(spark, sf):
    """Instances found blob by blob per sequence and colour."""
    e = event_stream(spark, sf)
    start = F.col("user_id") * 3 + F.floor(F.col("value") / 60) * 40
    voxels = F.sequence(start, start + F.lit(10) + F.floor(F.col("value") / 12))
    b = e.select(
        (F.col("user_id") % 10).alias("sequence"), F.length("event_type").cast("long").alias("colour"),
        F.floor(F.col("ts_us") / (6 * 3600 * 1_000_000)).alias("frame"), F.col("event_id").alias("blob"),
        F.floor("value").alias("n_px"), voxels.alias("voxels"),
    )
    out = discovery.discover(b)
    return out.select("sequence", "colour", "frame", "blob", "instance", F.size("merged").alias("n_merged"))
