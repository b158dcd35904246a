"""Reports that look points up in tiled label and depth images, and medians of nested reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import imaging as im
from sightline.operators import rasters as ra
from sightline.operators import runs
from sightline.operators.voxels import XYZ
from sightline.plans.images import CAM
from sightline.plans.registry import query
from sightline.session import durable
from sightline.sources import tables as t

AHEAD = 3  # frames a surface is looked for in
#: The test images are noise, so most of a frame is new; this share of it parts the frames.
NEW_SHARE = 0.8
SEQUENCE = 30  # frames of a sequence

# A pixel of frame f as a point of the world, seen from frame g; the order of operations is that of the query.
_SEEN = """(40.0::DOUBLE * (((u - 24.0::DOUBLE) / 40.0::DOUBLE * depth + p.frame * 0.05::DOUBLE) - g * 0.05::DOUBLE) / depth + 24.0::DOUBLE)"""
_SEEN_V = "(40.0::DOUBLE * ((v - 24.0::DOUBLE) / 40.0::DOUBLE * depth) / depth + 24.0::DOUBLE)"


@query("occlusion_from_rasters", f"""WITH {t.RGBD_SQL},
s AS (SELECT p.frame, p.colour AS label, g, depth AS z, trunc({_SEEN})::BIGINT AS pu, trunc({_SEEN_V})::BIGINT AS pv
  FROM (SELECT * FROM rgbd WHERE v % 2 = 0 AND u % 2 = 0 AND depth > 0) p, LATERAL (SELECT unnest(generate_series(p.frame, p.frame + {AHEAD})) AS g)),
k AS (SELECT s.frame, s.label, s.g, s.z, coalesce(r.colour = s.label, FALSE) AS same, coalesce(r.depth, 0) AS depth
  FROM s LEFT JOIN rgbd r ON r.frame = s.g AND r.v = pv AND r.u = pu
  WHERE pu BETWEEN 0 AND {t.IMAGE_W - 1} AND pv BETWEEN 0 AND {t.IMAGE_H - 1} AND s.g IN (SELECT frame FROM rgbd)),
c AS (SELECT frame, label, g AS seen_from, count(*) FILTER (WHERE same AND depth > 0) AS n_visible,
  count(*) FILTER (WHERE NOT same AND depth > 0 AND depth < z - greatest(0.05::DOUBLE, 0.03::DOUBLE * z)) AS n_hidden FROM k GROUP BY ALL)
SELECT *, CASE WHEN n_visible + n_hidden > 0 THEN n_hidden / (n_visible + n_hidden) ELSE 0 END AS occ FROM c""")
def occlusion_from_rasters(spark, sf):
    """How much of each surface is hidden in its own frame and the next ones, by the label and depth images."""
    images = durable(t.rgbd(spark, sf), "rgbd")
    poses = t.camera_poses(images)
    own = im.to_world(im.unproject(images, CAM, 2), poses).select("frame", F.col("colour").alias("label"), *XYZ)
    ahead = own.select(
        F.col("frame").alias("own"), "label", *XYZ, F.explode(F.sequence("frame", F.col("frame") + AHEAD)).alias("frame")
    )
    out = ra.occlusion(ahead, images, poses, CAM, ["own", "label", "frame"])
    return out.select(F.col("own").alias("frame"), "label", F.col("frame").alias("seen_from"), "n_visible", "n_hidden", "occ")


@query("anchored_novelty", f"""WITH RECURSIVE {t.RGBD_SQL},
fr AS (SELECT DISTINCT frame, frame // {SEQUENCE} AS sequence FROM rgbd),
pr AS (SELECT a.sequence, a.frame AS g, b.frame AS frame FROM fr a JOIN fr b ON a.sequence = b.sequence AND b.frame >= a.frame),
s AS (SELECT pr.sequence, p.frame, g, depth, trunc({_SEEN})::BIGINT AS pu, trunc({_SEEN_V})::BIGINT AS pv
  FROM pr JOIN rgbd p ON p.frame = pr.frame AND v % 2 = 0 AND u % 2 = 0 AND depth > 0),
k AS (SELECT s.*, pu BETWEEN 0 AND {t.IMAGE_W - 1} AND pv BETWEEN 0 AND {t.IMAGE_H - 1} AND s.depth BETWEEN 0.2 AND 5.0 AS inside, r.depth AS old
  FROM s LEFT JOIN rgbd r ON r.frame = s.g AND r.v = pv AND r.u = pu),
m AS (SELECT *, inside AND coalesce(old BETWEEN 0.2 AND 5.0, FALSE) AND coalesce(abs(old - depth) <= 0.10::DOUBLE * depth, FALSE) AS seen,
  depth BETWEEN 0.2 AND 5.0 AND NOT (inside AND NOT coalesce(old BETWEEN 0.2 AND 5.0, FALSE)) AS known FROM k),
c AS (SELECT pr.sequence, pr.g AS anchor, pr.frame, count(*) FILTER (WHERE known AND NOT seen) AS n_new, count(*) FILTER (WHERE known) AS n_known
  FROM pr LEFT JOIN m ON m.g = pr.g AND m.frame = pr.frame GROUP BY ALL),
n AS (SELECT *, n_new / greatest(n_known, 1) AS novelty, n_known / 576::DOUBLE AS valid_frac FROM c),
nx AS (SELECT sequence, anchor, min(frame + 1) AS nxt FROM n WHERE novelty > {NEW_SHARE}::DOUBLE AND valid_frac >= 0.10 AND frame + 1 - anchor >= 5 GROUP BY ALL),
an AS (SELECT sequence, min(frame) AS anchor, min(frame) AS first FROM fr GROUP BY sequence
  UNION ALL SELECT an.sequence, nxt, first FROM an JOIN nx ON nx.sequence = an.sequence AND nx.anchor = an.anchor
  WHERE nxt <= (SELECT max(frame) FROM fr WHERE fr.sequence = an.sequence)),
sp AS (SELECT *, lead(anchor) OVER (PARTITION BY sequence ORDER BY anchor) AS until FROM an)
SELECT n.sequence, n.frame, n.anchor, n_new, n_known, novelty, valid_frac,
  CASE WHEN n.frame = first THEN 'init' WHEN n.frame = n.anchor THEN 'cov' ELSE '' END AS keyframe
FROM sp JOIN n ON n.sequence = sp.sequence AND n.anchor = sp.anchor AND (until IS NULL OR n.frame < until)""")
def anchored_novelty(spark, sf):
    """New share of every frame against an anchor that moves on where the view has changed enough."""
    images = durable(t.rgbd(spark, sf), "rgbd")
    frames = images.select(F.floor(F.col("frame") / SEQUENCE).alias("sequence"), "frame").distinct()
    return ra.anchored_novelty(frames, images, t.camera_poses(images), CAM, 2, tau=NEW_SHARE)


@query("report_medians", """WITH r AS (SELECT o_orderpriority AS run, o_orderstatus AS st, count(*)::DOUBLE AS n, max(o_totalprice) AS most, min(o_totalprice) AS least
  FROM orders GROUP BY ALL),
l AS (SELECT run, 'orders.' || st || '.n' AS metric, n AS value FROM r UNION ALL
  SELECT run, 'orders.' || st || '.price.most', most FROM r UNION ALL SELECT run, 'orders.' || st || '.price.least', least FROM r WHERE run <> '5-LOW' UNION ALL
  SELECT run, 'total', sum(n) FROM r GROUP BY run)
SELECT metric, quantile_cont(value, 0.5) AS median, count(*) AS n_runs FROM l GROUP BY metric""")
def report_medians(spark, sf):
    """Median of every number in nested reports, one report a run; one run lacks a leaf, truth values and texts are left out."""
    o = t.table(spark, sf, "orders")
    of = o.groupBy(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("st")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"), F.min("o_totalprice").alias("least")
    )
    least = F.when(F.col("run") != "5-LOW", F.col("least")).alias("least")
    part = F.struct("n", F.struct("most", least).alias("price"), F.lit(True).alias("complete"), F.lit("text").alias("note"))
    per_run = of.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("st", part))).alias("orders"), F.sum("n").alias("total"))
    reports = per_run.select("run", F.to_json(F.struct("orders", "total", F.array(F.lit(1)).alias("list"))).alias("report"))
    return runs.report_medians(reports, "run", "report")
