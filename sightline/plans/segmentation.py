"""2D segmentation scores over the line-item rasters."""

from __future__ import annotations


from pyspark.sql import functions as F

from sightline.operators import masks as mk
from sightline.operators import rules
from sightline.plans.registry import query
from sightline.session import durable
from sightline.sources import tables as t

THETA = 0.5
AREA_MIN = 105
HUMAN_GT = (3, 5)

PAIRS_SQL = f"""{t.RASTER_SQL},
hit AS (SELECT frame, pred, cell, gt FROM msk JOIN gtc USING (frame, cell)),
n AS (SELECT frame, pred, gt, count(*) AS inter FROM hit GROUP BY ALL),
pp AS (SELECT frame, pred, sum(inter)::BIGINT AS area_pred, coalesce(sum(inter) FILTER (WHERE gt = 0), 0)::BIGINT AS void
  FROM n GROUP BY ALL),
pg AS (SELECT frame, gt, count(*) AS area_gt FROM gtc WHERE gt > 0 GROUP BY ALL),
pairs AS (SELECT *, CASE WHEN area_pred + area_gt - inter - void > 0
    THEN inter / (area_pred + area_gt - inter - void) ELSE 0 END AS iou,
    2 * inter >= area_gt AS covers_gt, 2 * inter >= area_pred AS inside_gt
  FROM n JOIN pp USING (frame, pred) JOIN pg USING (frame, gt) WHERE gt > 0),
th AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS theta),
cand AS (SELECT *, row_number() OVER (PARTITION BY frame, theta, pred ORDER BY iou DESC) AS rp,
    row_number() OVER (PARTITION BY frame, theta, gt ORDER BY iou DESC) AS rg
  FROM pairs, th WHERE iou > theta),
matches AS (SELECT frame, theta, pred, gt, iou FROM cand WHERE rp = 1 AND rg = 1),
own AS (SELECT * FROM matches WHERE theta = {THETA}),
mergers AS (SELECT frame, pred FROM pairs WHERE covers_gt GROUP BY ALL HAVING count(*) >= 2),
frag AS (SELECT frame, gt, count(DISTINCT pred) AS n_frags, count(DISTINCT cell) AS frag_cells
  FROM hit JOIN (SELECT frame, pred, gt FROM pairs WHERE inside_gt) USING (frame, pred, gt) GROUP BY ALL),
facts AS (SELECT frame, gt, max(iou) AS best_iou, arg_min(pred, (-iou, pred)) AS best_pred,
    bool_or(covers_gt AND m.pred IS NOT NULL) AS merged
  FROM pairs LEFT JOIN mergers m USING (frame, pred) GROUP BY ALL),
gts AS (SELECT pg.frame, pg.gt, area_gt, coalesce(best_iou, 0) AS best_iou, coalesce(best_pred, -1) AS best_pred,
    coalesce(n_frags, 0) AS n_frags, coalesce(own.pred, -1) AS matched_pred, area_gt >= {AREA_MIN} AS eligible,
    CASE WHEN n_frags >= 2 THEN frag_cells / area_gt ELSE 0 END AS split_cover,
    CASE WHEN own.pred IS NOT NULL THEN 'tp' WHEN merged THEN 'merged'
      WHEN n_frags >= 2 AND 2 * frag_cells >= area_gt THEN 'split'
      WHEN coalesce(best_iou, 0) BETWEEN 0.1 - 2.220446049250313e-16 AND {THETA} + 2.220446049250313e-16 THEN 'low_iou'
      ELSE 'missed' END AS status
  FROM pg LEFT JOIN facts USING (frame, gt) LEFT JOIN frag USING (frame, gt) LEFT JOIN own USING (frame, gt)),
pfacts AS (SELECT frame, pred, max(iou) AS best, arg_min(gt, (-inter, gt)) AS most,
    count(*) FILTER (WHERE covers_gt) >= 2 AS merger FROM pairs GROUP BY ALL),
preds AS (SELECT pp.frame, pp.pred, area_pred, void, own.gt AS matched_gt, coalesce(merger, false) AS merger,
    coalesce(own.iou, best, 0) AS iou, coalesce(own.gt, most) AS assigned_gt,
    CASE WHEN own.gt IS NOT NULL AND area_gt >= {AREA_MIN} THEN 'tp' WHEN own.gt IS NOT NULL THEN 'tp_small'
      WHEN 2 * void > area_pred THEN 'ignore' ELSE 'fp' END AS status
  FROM pp LEFT JOIN pfacts USING (frame, pred) LEFT JOIN own USING (frame, pred) LEFT JOIN pg
    ON pg.frame = pp.frame AND pg.gt = own.gt)"""


def scene(spark, sf):
    """Hits, labels and pairs of all frames.

    Hits and labels feed several reports and are written once; pairs are a few
    rows per frame.
    """
    r = t.rasters(spark, sf)
    labels = durable(t.label_cells(r), "labels")
    hits = durable(mk.mask_hits(t.mask_cells(r), labels), "mask-hits")
    pairs = durable(mk.mask_pairs(hits, labels), "mask-pairs")
    return hits, labels, pairs


def scored(spark, sf, thetas=(THETA,)):
    """Pairs, matches at the given thresholds, and the outcomes at ``THETA``, one of them."""
    hits, labels, pairs = scene(spark, sf)
    matches = durable(mk.match_thetas(pairs, thetas), "mask-matches")
    gts = mk.gt_rows(hits, labels, pairs, matches, THETA, AREA_MIN)
    preds = mk.pred_rows(hits, pairs, matches, THETA, AREA_MIN)
    return pairs, matches, gts, preds


@query("label_iou_matrix", f"""WITH {t.RASTER_SQL},
n AS (SELECT frame, pred, gt, count(*) AS n FROM raster GROUP BY ALL),
ap AS (SELECT frame, pred, sum(n)::BIGINT AS area_pred FROM n WHERE pred <> 0 GROUP BY ALL),
ag AS (SELECT frame, gt, sum(n)::BIGINT AS area_gt FROM n WHERE gt <> 0 GROUP BY ALL)
SELECT frame, pred, gt, n, area_pred, area_gt, n / (area_pred + area_gt - n) AS iou
FROM n JOIN ap USING (frame, pred) JOIN ag USING (frame, gt)""")
def label_iou_matrix(spark, sf):
    return mk.label_pairs(mk.label_counts(t.rasters(spark, sf), ["frame"]), ["frame"])


@query("mask_overlap", f"WITH {PAIRS_SQL} SELECT frame, pred, gt, inter, area_pred, area_gt, void, iou FROM pairs")
def mask_overlap(spark, sf):
    return scene(spark, sf)[2].drop("covers_gt", "inside_gt")


@query("mask_matches", f"WITH {PAIRS_SQL} SELECT frame, theta, pred, gt, iou FROM matches")
def mask_matches(spark, sf):
    return mk.match_thetas(scene(spark, sf)[2], rules.THETAS)


@query("seg2d_gt", f"""WITH {PAIRS_SQL}
SELECT frame, gt, area_gt, best_iou, best_pred, n_frags, matched_pred, eligible::INT AS eligible, split_cover, status FROM gts""")
def seg2d_gt(spark, sf):
    g = scored(spark, sf)[2]
    return g.select(
        "frame", "gt", "area_gt", "best_iou", "best_pred", "n_frags", "matched_pred",
        F.col("eligible").cast("int").alias("eligible"), "split_cover", "status",
    )


@query("seg2d_pred", f"""WITH {PAIRS_SQL}
SELECT frame, pred, area_pred, void, matched_gt, merger::INT AS merger, iou, assigned_gt, status FROM preds""")
def seg2d_pred(spark, sf):
    p = scored(spark, sf)[3]
    return p.select(
        "frame", "pred", "area_pred", "void", "matched_gt", F.col("merger").cast("int").alias("merger"),
        "iou", "assigned_gt", "status",
    )


_SUMMARY = """SELECT {by} n_gt, n_tp, n_pred, n_fp, n_gt - n_tp AS n_fn, n_tp / greatest(counted, 1) AS precision,
  round(sq, 9) AS sq, CASE WHEN n_tp + 0.5 * n_fp + 0.5 * (n_gt - n_tp) > 0
    THEN n_tp / (n_tp + 0.5 * n_fp + 0.5 * (n_gt - n_tp)) ELSE 0 END AS rq,
  round(sq * CASE WHEN n_tp + 0.5 * n_fp + 0.5 * (n_gt - n_tp) > 0
    THEN n_tp / (n_tp + 0.5 * n_fp + 0.5 * (n_gt - n_tp)) ELSE 0 END, 9) AS pq, round(miss, 9) AS mean_best_iou_fn
FROM (SELECT {by} coalesce(n_gt, 0) AS n_gt, coalesce(n_tp, 0) AS n_tp, coalesce(n_pred, 0) AS n_pred,
    coalesce(n_fp, 0) AS n_fp, coalesce(counted, 0) AS counted, coalesce(sq, 0) AS sq, miss
  FROM (SELECT {by} count(*) AS n_gt, count(*) FILTER (WHERE status = 'tp') AS n_tp,
        avg(best_iou) FILTER (WHERE status <> 'tp') AS miss FROM gts WHERE eligible {group}) g
  {join} (SELECT {by} count(*) AS n_pred, count(*) FILTER (WHERE status = 'fp') AS n_fp,
        count(*) FILTER (WHERE status IN ('tp', 'fp')) AS counted,
        coalesce(avg(iou) FILTER (WHERE status = 'tp'), 0) AS sq FROM preds {group}) p {using})"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("sq", "pq", "mean_best_iou_fn")})


@query("panoptic_summary", f"WITH {PAIRS_SQL} " + _SUMMARY.format(by="", group="", join="CROSS JOIN", using=""))
def panoptic_summary(spark, sf):
    _, _, gts, preds = scored(spark, sf)
    return _rounded(mk.summary(gts, preds))


@query("panoptic_by_frame", f"WITH {PAIRS_SQL} "
       + _SUMMARY.format(by="frame,", group="GROUP BY frame", join="FULL JOIN", using="USING (frame)"))
def panoptic_by_frame(spark, sf):
    _, _, gts, preds = scored(spark, sf)
    return _rounded(mk.summary(gts, preds, ["frame"]))


_HUMAN = f"gt IN {HUMAN_GT}"


@query("panoptic_by_group", f"""WITH {PAIRS_SQL},
top AS (SELECT frame, pred, max(inter) AS mx FROM pairs GROUP BY ALL),
side AS (SELECT frame, pred, bool_or(inter = mx AND {_HUMAN}) AS th, bool_or(inter = mx AND NOT {_HUMAN}) AS ts,
  coalesce(sum(inter) FILTER (WHERE {_HUMAN}), 0) AS sh, coalesce(sum(inter) FILTER (WHERE NOT {_HUMAN}), 0) AS ss
  FROM pairs JOIN top USING (frame, pred) GROUP BY ALL),
pgrp AS (SELECT preds.*, CASE WHEN matched_gt IS NOT NULL THEN matched_gt IN {HUMAN_GT}
  WHEN th AND ts THEN sh > ss ELSE coalesce(th, false) END AS human FROM preds LEFT JOIN side USING (frame, pred))
SELECT CASE WHEN human THEN 'human' ELSE 'static' END AS "group", status, count(*) AS n FROM pgrp GROUP BY ALL""")
def panoptic_by_group(spark, sf):
    """Prediction outcomes split into people and static things."""
    pairs, _, _, preds = scored(spark, sf)
    grouped = mk.pred_group(pairs, preds, F.col("gt").isin(*HUMAN_GT))
    return grouped.groupBy("group", "status").agg(F.count(F.lit(1)).alias("n"))


@query("recall_by_theta", f"""WITH {PAIRS_SQL}
, th_hit AS (SELECT theta, count(*) AS n FROM matches JOIN gts USING (frame, gt) WHERE eligible GROUP BY theta),
al AS (SELECT count(*) AS n_gt FROM gts WHERE eligible)
SELECT theta, coalesce(n, 0) AS n_hit, n_gt, coalesce(n, 0) / greatest(n_gt, 1) AS recall FROM th CROSS JOIN al LEFT JOIN th_hit USING (theta)""")
def recall_by_theta(spark, sf):
    _, matches, gts, _ = scored(spark, sf, rules.THETAS)
    return mk.recall_at(gts, matches, rules.THETAS)


@query("gt_status_counts", f"WITH {PAIRS_SQL} SELECT status, count(*) AS n FROM gts WHERE eligible GROUP BY status")
def gt_status_counts(spark, sf):
    return scored(spark, sf)[2].where("eligible").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# Pairs of a frame are visited best first, ties by prediction and truth; a pair is taken if neither side is.
_GREEDY_SQL = f"""RECURSIVE {t.RASTER_SQL},
n AS (SELECT frame, pred, gt, count(*) AS n FROM raster GROUP BY ALL),
ap AS (SELECT frame, pred, sum(n) AS area_pred FROM n WHERE pred <> 0 GROUP BY ALL), ag AS (SELECT frame, gt, sum(n) AS area_gt FROM n WHERE gt <> 0 GROUP BY ALL),
rk AS (SELECT frame, pred, gt, n / (area_pred + area_gt - n) AS iou, row_number() OVER (PARTITION BY frame ORDER BY n / (area_pred + area_gt - n) DESC, pred, gt) AS k
  FROM n JOIN ap USING (frame, pred) JOIN ag USING (frame, gt)),
gr AS (SELECT DISTINCT frame, 0::BIGINT AS k, []::BIGINT[] AS ps, []::BIGINT[] AS gs, 0.0::DOUBLE AS s FROM n
  UNION ALL
  SELECT g.frame, r.k, CASE WHEN list_contains(g.ps, r.pred) OR list_contains(g.gs, r.gt) THEN g.ps ELSE list_append(g.ps, r.pred) END,
    CASE WHEN list_contains(g.ps, r.pred) OR list_contains(g.gs, r.gt) THEN g.gs ELSE list_append(g.gs, r.gt) END,
    CASE WHEN list_contains(g.ps, r.pred) OR list_contains(g.gs, r.gt) THEN g.s ELSE g.s + r.iou END
  FROM gr g JOIN rk r ON r.frame = g.frame AND r.k = g.k + 1),
fi AS (SELECT frame, arg_max(len(ps), k) AS n_matched, arg_max(s, k) AS s FROM gr GROUP BY frame),
fs AS (SELECT frame, count(DISTINCT gt) FILTER (WHERE gt <> 0) AS n_gt, count(DISTINCT pred) FILTER (WHERE pred <> 0) AS n_pred FROM n GROUP BY frame),
fr AS (SELECT frame, n_gt, n_pred, n_matched, CASE WHEN n_gt > 0 THEN s / n_gt ELSE 1 END AS mean_matched_iou FROM fs JOIN fi USING (frame))"""


@query("frame_mask_iou", f"WITH {_GREEDY_SQL} SELECT * REPLACE (round(mean_matched_iou, 9) AS mean_matched_iou) FROM fr")
def frame_mask_iou(spark, sf):
    """Greedy matching of label images, frame by frame."""
    f = mk.frame_mask_iou(t.rasters(spark, sf), ["frame"])
    return f.withColumn("mean_matched_iou", F.round("mean_matched_iou", 9))


@query("seg_run_score", f"""WITH {_GREEDY_SQL} SELECT round(avg(mean_matched_iou), 9) AS mask_iou_mean, count(*) AS frames_scored,
  sum(n_matched)::BIGINT AS n_matched FROM fr""")
def seg_run_score(spark, sf):
    """Mean of the frame scores over all scored frames."""
    f = mk.frame_mask_iou(t.rasters(spark, sf), ["frame"])
    return f.agg(
        F.round(F.avg("mean_matched_iou"), 9).alias("mask_iou_mean"),
        F.count(F.lit(1)).alias("frames_scored"),
        F.sum("n_matched").alias("n_matched"),
    )


GRID_W = 60


@query("label_boxes", f"""WITH {t.RASTER_SQL}, c AS (SELECT frame, gt, (cell % 3600) // {GRID_W} AS v, cell % {GRID_W} AS u
  FROM gtc WHERE gt > 0)
SELECT frame, gt, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1, count(*) AS vis_px,
  least(max(u) - min(u) + 1, max(v) - min(v) + 1) AS min_dim FROM c GROUP BY ALL""")
def label_boxes(spark, sf):
    labels = t.label_cells(t.rasters(spark, sf)).withColumn("cell", F.col("cell") % 3600)
    return mk.boxes(labels, GRID_W)


@query("label_resample", f"""WITH {t.RASTER_SQL}, c AS (SELECT frame, gt, (cell % 3600) // {GRID_W} AS v, cell % {GRID_W} AS u
  FROM gtc), ax AS (SELECT i, CAST(floor((i + 0.5) * 2.5) AS BIGINT) AS s FROM range(24) r(i))
SELECT frame, a.i * 24 + b.i AS cell, gt FROM c JOIN ax a ON a.s = c.v JOIN ax b ON b.s = c.u""")
def label_resample(spark, sf):
    """Labels read at the centres of cells 2.5 pixels wide."""
    labels = t.label_cells(t.rasters(spark, sf)).withColumn("cell", F.col("cell") % 3600)
    return mk.resample_cells(labels, GRID_W, 60, 24, 24)
